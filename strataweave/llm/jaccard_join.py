"""Operator 7: exact n-gram Jaccard self-join by set-relation skipping, reported as components.

Method. Equal sets are one node. Every node indexes its prefix: the first ``n - ceil(0.8 n) + 1`` shingles in a global order,
rare shingles first. Two sets that link share a shingle there. Two kinds of skipping keep the lists cheap:

* *Index level.* A list is sorted by set size and cut into blocks with the range of their sizes and prefix positions; block
  pairs whose bounds cannot reach the overlap needed are skipped, and so are single pairs. A pair met in too few lists for its
  two prefixes is dropped before any set is fetched.
* *Answer level.* In the lists of frequent shingles one typical set is the pivot and only its answers are computed by
  comparing sets. The answers of the sets found highly similar to it are derived: they share its component, so pairs inside a
  component are never formed. What remains are pairs across components.

Frequent shingles are those with a count of at least ``max(64, repeats / 1e6)``, so at most a million are broadcast. The order
decides speed only: every pair across components that shares a prefix shingle is judged exactly, on whole sets.

Nulls and empty texts have an empty set and link with nothing. A row without ``doc_id`` takes no part and has no component.
Rows that repeat an id are judged each by its own text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.components import components
from strataweave.llm.words import mix, shingle_sets, slices
from strataweave.session import release, stage

#: Similarity of a link, as a fraction of integers: 100 * intersection >= 80 * union.
NUMERATOR, DENOMINATOR = 80, 100
FREQUENT = 64
FREQUENT_LIMIT = 1_000_000
#: Entries of one list that one task takes at once.
LIST_BLOCK = 256
_COUNTED = 2 << 20
#: Pairs of entries that are compared at once.
_CELLS = 1 << 20


def overlap_needed(left, right):
    """Least intersection of two linked sets of these sizes."""
    total = NUMERATOR * (left + right)
    return -(-total // (NUMERATOR + DENOMINATOR))


def prefix_length(n):
    return n + (NUMERATOR * n) // -DENOMINATOR + 1


def _repeats(size: int):
    """Shingles met at least twice within a stretch of texts, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def counted():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            many = n > 1
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(n[many])], ["shingle", "n"])

        for part in slices(batches):
            sets = [s for s in shingle_sets(part.column("text"), size) if len(s)]
            held += sets
            rows += sum(map(len, sets))
            if rows > _COUNTED:
                yield counted()
                held, rows = [], 0
        if held:
            yield counted()

    return run


def _sketches(size: int, frequent):
    """Size, signature, share of rare shingles and ordered prefix of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        for part in slices(batches):
            n, one, two, rare, prefix = [], [], [], [], []
            for s in shingle_sets(part.column("text"), size):
                n.append(len(s))
                one.append(s.sum(dtype=np.uint64))
                two.append(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                if not len(s):
                    rare.append(0.0)
                    prefix.append(np.zeros(0, np.int64))
                    continue
                values = s.view(np.int64)
                weight = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                    weight = np.where(known[at] == values, counts[at], 0)
                rare.append(float((weight == 0).mean()))
                p = prefix_length(len(s))
                prefix.append(s[np.lexsort((s, weight))[:p]].view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(one, np.uint64).view(np.int64)),
                    pa.array(np.array(two, np.uint64).view(np.int64)),
                    pa.array(rare, pa.float64()),
                    lists,
                ],
                ["doc_id", "n", "one", "two", "rare", "prefix"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), size)
            sums = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            two = np.array([mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sums), pa.array(two), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc_id", "one", "two", "shingles"],
            )

    return run


def _pairs_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs inside the lists of one task, or between two blocks of a long one, by block and position skipping.

    Rows come sorted by list; a row of a long list names the block pair and its side.
    """
    rest = None
    for batch in batches:
        table = batch.to_pandas()
        if rest is not None:
            table = pd.concat([rest, table], ignore_index=True)
        keys = table[["shingle", "left", "right"]].to_numpy()
        same = (keys == keys[-1]).all(axis=1)
        whole = int(len(table) - same[::-1].argmin()) if not same.all() else 0
        yield from _judged(table.iloc[:whole])
        rest = table.iloc[whole:]
    if rest is not None:
        yield from _judged(rest)


def _judged(table: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    if not len(table):
        return
    keys = table[["shingle", "left", "right"]].to_numpy()
    edges = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    ends = np.append(edges[1:], len(table))
    node, n, pos = (table[c].to_numpy() for c in ("node", "n", "pos"))
    component, block = table["component"].to_numpy(), table["block"].to_numpy()
    outs, held = ([], [], [], [], []), 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in outs], ["a", "b", "na", "nb", "reach"])

    for lo, hi in zip(edges.tolist(), ends.tolist()):
        if hi - lo < 2:
            continue
        i = np.arange(lo, hi)
        left, right = int(keys[lo, 1]), int(keys[lo, 2])
        x, y = (i, i) if left == right else (i[block[lo:hi] == left], i[block[lo:hi] == right])
        if not len(x) or not len(y):
            continue
        if left != right:  # skip the block pair if even its best sizes and positions cannot meet
            small, large = min(n[x].max(), n[y].max()), max(n[x].min(), n[y].min())
            if small * DENOMINATOR < large * NUMERATOR:
                continue
            before = min(pos[x].max(), pos[y].max())
            if before + min((n[x] - pos[x]).max(), (n[y] - pos[y]).max()) < overlap_needed(n[x].min(), n[y].min()):
                continue
        rows = max(1, _CELLS // len(y))
        for first in range(0, len(x), rows):
            u = x[first : first + rows]
            na, nb = n[u][:, None], n[y][None, :]
            px, py = pos[u][:, None], pos[y][None, :]
            reach = np.minimum(na - px, nb - py)  # what can still be shared from here on
            good = (np.minimum(px, py) + reach >= overlap_needed(na, nb)) & (component[u][:, None] != component[y][None, :])
            if left == right:
                good &= (first + np.arange(len(u)))[:, None] < np.arange(len(y))[None, :]
            p, q = np.nonzero(good)
            if not len(p):
                continue
            reached = reach[p, q]
            u, v = u[p], y[q]
            swap = node[u] > node[v]
            u, v = np.where(swap, v, u), np.where(swap, u, v)
            for out, part in zip(outs, (node[u], node[v], n[u], n[v], reached)):
                out.append(part)
            held += len(p)
            if held > 200_000:
                yield flush()
                outs, held = ([], [], [], [], []), 0
    if held:
        yield flush()


def _overlap(left: pd.Series, right: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(left, right):
        a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = np.concatenate((a, b))
        both.sort(kind="stable")
        out.append(int((both[1:] == both[:-1]).sum()))
    return pd.Series(out, dtype="int64")


def links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Of candidate pairs ``a, b`` of nodes those that link, judged on the whole sets of their texts.

    The sets are built again from the texts of the nodes in question; pairs with one hub are salted by their other side.
    """
    overlap = F.pandas_udf(_overlap, "long")
    wanted = stage(pairs.select("a", "b").distinct())
    used = wanted.select(F.col("a").alias("node")).unionByName(wanted.select(F.col("b").alias("node"))).distinct()
    texts = docs.select("doc_id", "text").join(nodes.join(used, "node").select(F.col("root").alias("doc_id")).distinct(), "doc_id", "left_semi")
    built = texts.mapInArrow(_sets(size), "doc_id long, one long, two long, shingles binary").withColumnRenamed("doc_id", "root")
    found = nodes.select("node", "root", "one", "two", "n").join(built, ["root", "one", "two"]).dropDuplicates(["node"])
    sets = stage(found.select("node", "n", "shingles"))
    first = wanted.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("left")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("right")), "b")
    shared = both.select("a", "b", "na", "nb", overlap("left", "right").alias("shared"))
    out = stage(shared.filter(f"{DENOMINATOR} * shared >= {NUMERATOR} * (na + nb - shared)").select("a", "b"))
    release(wanted, sets)
    return out


def jaccard_components(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    repeats = stage(docs.mapInArrow(_repeats(size), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(f"n >= {FREQUENT}"))
    least = max(FREQUENT, -(-(repeats.agg(F.sum("n")).first()[0] or 0) // FREQUENT_LIMIT))
    table = repeats.filter(F.col("n") >= least).toArrow()  # at most FREQUENT_LIMIT rows
    known, counts = table.column("shingle").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[order], counts[order]))
    release(repeats)

    schema = "doc_id long, n long, one long, two long, rare double, prefix array<long>"
    sketches = stage(docs.mapInArrow(_sketches(size, frequent), schema))
    groups = (
        sketches.filter("doc_id IS NOT NULL AND n > 0")
        .groupBy("one", "two")
        .agg(F.min("doc_id").alias("root"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix"))
    )
    nodes = stage(groups.withColumn("node", F.monotonically_increasing_id()))
    rows = stage(sketches.select("doc_id", F.col("n").alias("n_shingles"), "one", "two"))
    release(sketches)

    entries = nodes.select("node", "n", "rare", F.posexplode("prefix").alias("pos", "shingle"))
    many = known[order]

    def is_frequent(values: pd.Series) -> pd.Series:
        if not len(frequent.value[0]):
            return pd.Series(np.zeros(len(values), bool))
        at = np.minimum(np.searchsorted(frequent.value[0], values.to_numpy()), len(frequent.value[0]) - 1)
        return pd.Series(frequent.value[0][at] == values.to_numpy())

    if len(many):
        crowded = stage(entries.filter("rare < 1").filter(F.pandas_udf(is_frequent, "boolean")("shingle")))
        pivots = crowded.groupBy("shingle").agg(F.min(F.struct("rare", "node", "n")).alias("p"))
        star = crowded.join(pivots, "shingle").filter("node != p.node AND least(n, p.n) * 100 >= greatest(n, p.n) * 80")
        first = links(docs, nodes, star.select(F.col("node").alias("a"), F.col("p.node").alias("b")), size)
        known_parts = components(first)
        release(crowded)
    else:
        first = spark.createDataFrame([], "a long, b long")
        known_parts = spark.createDataFrame([], "node long, component long")

    placed = nodes.select("node", "n", "prefix").join(known_parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.select("node", "n", "component", F.posexplode("prefix").alias("pos", "shingle"))
    second = links(docs, nodes, _across(placed, frequent), size)
    parts = components(first.unionByName(second))

    ids = nodes.join(parts, "node", "left").select("one", "two", "root", F.coalesce("component", "node").alias("component"))
    least_id = ids.groupBy("component").agg(F.min("root").alias("component_id"))
    answer = ids.join(least_id, "component").select("one", "two", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(answer, ["one", "two"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def _across(placed: DataFrame, frequent) -> DataFrame:
    """Pairs of nodes in different components that may link, from the lists of ``placed``.

    A list longer than a block is dealt out as pairs of blocks, sorted by set size.
    """
    schema = "a long, b long, na long, nb long, reach long"

    def flagged(values: pd.Series) -> pd.Series:
        known = frequent.value[0]
        if not len(known):
            return pd.Series(np.zeros(len(values), bool))
        at = np.minimum(np.searchsorted(known, values.to_numpy()), len(known) - 1)
        return pd.Series(known[at] == values.to_numpy())

    plain = placed
    crowded = None
    if len(frequent.value[0]):
        known = F.pandas_udf(flagged, "boolean")
        marked = placed.withColumn("crowded", known("shingle"))
        plain = marked.filter("NOT crowded").drop("crowded")
        crowded = marked.filter("crowded").drop("crowded")
    zero = F.lit(0).cast("long")
    plain = plain.select("shingle", "node", "n", "pos", "component", zero.alias("block"), zero.alias("left"), zero.alias("right"))
    dealt = plain.repartition("shingle")
    pairs = dealt.sortWithinPartitions("shingle", "left", "right").mapInArrow(_pairs_of_lists, schema)
    if crowded is not None:
        lists = crowded.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"))
        mixed = lists.filter("lo < hi").select("shingle", F.ceil(F.col("m") / LIST_BLOCK).alias("blocks"))
        split = crowded.join(mixed, "shingle").withColumn("block", F.pmod(F.hash("node"), F.col("blocks").cast("int")).cast("long"))
        ways = F.transform(
            F.sequence(zero, F.col("blocks") - 1),
            lambda k: F.struct(F.least(k, F.col("block")).alias("left"), F.greatest(k, F.col("block")).alias("right")),
        )
        wide = split.select("shingle", "node", "n", "pos", "component", "block", F.inline(ways))
        wide = wide.repartition("shingle", "left", "right").sortWithinPartitions("shingle", "left", "right")
        pairs = pairs.unionByName(wide.mapInArrow(_pairs_of_lists, schema))
    met = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"), F.max("reach").alias("reach"))
    need = F.ceil(F.lit(NUMERATOR) * (F.col("na") + F.col("nb")) / (NUMERATOR + DENOMINATOR))
    prefix = lambda c: F.col(c) - F.ceil(F.lit(NUMERATOR) * F.col(c) / DENOMINATOR) + 1
    enough = F.least(prefix("na") - F.col("na") + need, prefix("nb") - F.col("nb") + need)
    return met.filter((F.col("met") >= enough) & (F.col("reach") >= need)).select("a", "b")


#: Ids that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row of each component, that of the smallest ``doc_id``; all rows without words or id stay.

    Where ids repeat, rows are numbered in a staged copy, and the first of that order stays.
    """
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    rows = docs
    if repeated:
        rows = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("doc_id"), F.col("text").alias("text")))
        rows = rows.filter("doc.doc_id IS NOT NULL")
    found = jaccard_components(rows, size)
    lost = stage(found.filter("component_id != doc_id").select("doc_id").distinct())
    small = lost.count() <= BROADCAST_IDS
    kept = rows.join(F.broadcast(lost) if small else lost, "doc_id", "left_anti")
    if repeated:
        return kept.select("doc.*").unionByName(docs.filter("doc_id IS NULL"))
    return kept.select(*(docs[c] for c in docs.columns))
