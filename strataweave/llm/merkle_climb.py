"""Operator 12: a Merkle manifest of a table, checked by a recursive query that climbs from every leaf.

Each row is a leaf digest over its columns. Leaves are ordered by key within their group (one tree a group); every ``FAN``
neighbours become one node until one is left, the group's subroot. Subroots, ordered by group, become the root the same way.

Building: leaf digests are staged, range-partitioned by group, key and a number of the row, and numbered by partition counts, so
neither a hot group nor repeated rows meet in one task. Each level is one grouped table of at most ``FAN`` children a row, staged;
its children are the node rows, which name their parent and their slot in it.

Climbing: one recursive query joins the rows of the last step to their parent's node row, folds every leaf's digest into
the parent's run and appends the other digests of the run. The leaves of one run share all parents, so they ride in one row of at
most ``FAN`` digests with one common list of siblings. A node row exists once for every ``MEET`` runs below it, and a run joins
the copy of its number: no key of the join is hot, and the copies add one row to ``MEET`` runs at each level.

Defined cases: null columns are ``-``; null keys come first and are never hot by themselves; a null group is a group of its own,
first in order; rows equal in group and key are ordered by digest, and rows equal in all columns are leaves of their own; a group of one
leaf has it as subroot; one group alone has its subroot as root; an empty table gives no rows. Other columns of the table
are ignored, whatever their names. A text of any length is hashed in its own row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import fits_broadcast, stage

#: Children of a node; runs that meet one copy of a node row.
FAN = 16
MEET = 4096
#: Bytes of a digest in the tables; hashes are taken over hex text.
_WIDTH = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _hash(digests: Column) -> Column:
    """Digest over concatenated digests, taken as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, b: F.concat(a, b))


def _before(run: Column, slot: Column) -> Column:
    return F.substring(run, F.lit(1), slot * _WIDTH)


def _after(run: Column, slot: Column) -> Column:
    return F.substring(run, (slot + 1) * _WIDTH + 1, F.lit(FAN * _WIDTH))


def leaf_digests(rows: DataFrame, columns: Sequence[str], group: str, key: str, changed: Mapping[str, Column] | None = None) -> DataFrame:
    """``tree, key, digest, start``: leaf digests of the rows as they are, and with some columns changed."""

    def digest(replaced: Mapping[str, Column]) -> Column:
        fields = []
        for name in columns:
            value = replaced.get(name, F.col(f"`{name}`")).cast("string")
            fields.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
        return F.unhex(F.sha2(F.concat(*fields), 256))

    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))  # sorts null first
    return rows.select(tree.alias("tree"), F.col(f"`{key}`").alias("key"), digest({}).alias("digest"), digest(changed or {}).alias("start"))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the place of a row within its group, and ``size``, the rows of the group."""
    by = [group, *order]
    spread = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stage(spread.withColumn("_part", F.spark_partition_id()).withColumn("_spot", F.monotonically_increasing_id()))
    parts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_spot").alias("_first"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        parts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size"))
    )
    starts = F.broadcast(starts) if fits_broadcast(starts) else starts
    pos = F.col("_spot") - F.col("_first") + F.col("_before")
    return placed.join(starts, [group, "_part"]).withColumn("pos", pos).drop("_part", "_spot", "_first", "_before")


_NODE = ("tree", "level", "idx", "digest", "weight", "run", "folded")


def _climb_level(nodes: DataFrame, up_level: int) -> tuple[DataFrame, DataFrame]:
    """Parents of the nodes ``_NODE, up_tree, pos, size``, and the nodes with the link to their parent."""
    child = F.struct(F.pmod("pos", F.lit(FAN)).cast("int").alias("slot"), *_NODE)
    up = F.expr(f"pos DIV {FAN}").alias("up_idx")
    families = nodes.groupBy("up_tree", up, "size").agg(F.sort_array(F.collect_list(child)).alias("children"))
    families = stage(families.withColumn("run", _joined(F.transform("children", lambda c: c["digest"]))))
    weight = F.aggregate("children", F.lit(0).cast("long"), lambda a, c: a + c["weight"])
    linked = families.select("up_tree", F.lit(up_level).alias("up_level"), "up_idx", weight.alias("up_weight"), F.explode("children").alias("c"))
    parents = families.select(
        F.col("up_tree").alias("tree"),
        F.lit(up_level).alias("level"),
        F.col("up_idx").alias("idx"),
        _hash(F.col("run")).alias("digest"),
        weight.alias("weight"),
        "run",
        F.lit(None).cast("array<binary>").alias("folded"),
        "up_tree",
        F.col("up_idx").alias("pos"),
        F.expr(f"(size + {FAN - 1}) DIV {FAN}").alias("size"),
    )
    return parents, linked.select("up_tree", "up_level", "up_idx", "up_weight", "c.*")


def _levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """All linked levels above ``nodes``, and the last nodes of each tree; ``most`` is the size of the widest tree."""
    linked, last, level = [], [nodes.filter("size = 1")], 1
    while most > 1:
        level += 1
        nodes, links = _climb_level(nodes.filter("size > 1"), level)
        linked.append(links)
        last.append(nodes.filter("size = 1"))
        most = -(-most // FAN)
    return linked, last


def _recursive(spark, runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree, idx, folded, trail, subroot`` of each run of leaves once it has reached the root."""
    before, after = f"substring(n.run, 1, c.slot * {_WIDTH})", f"substring(n.run, (c.slot + 1) * {_WIDTH} + 1, {FAN * _WIDTH})"
    climbed = spark.sql(
        f"""
        WITH RECURSIVE climb AS (
          SELECT tree, idx, folded, CAST(X'' AS BINARY) AS trail, CAST(NULL AS BINARY) AS subroot, up_tree, up_level, up_idx, up_copies, slot FROM {{runs}}
          UNION ALL
          SELECT c.tree, c.idx,
            transform(c.folded, f -> unhex(sha2(lower(hex(concat({before}, f, {after}))), 256))),
            concat(c.trail, {before}, {after}),
            CASE WHEN c.subroot IS NULL AND n.tree = '' THEN substring(n.run, c.slot * {_WIDTH} + 1, {_WIDTH}) ELSE c.subroot END,
            n.up_tree, n.up_level, n.up_idx, n.up_copies, n.slot
          FROM climb c JOIN {{nodes}} n
            ON n.tree = c.up_tree AND n.level = c.up_level AND n.idx = c.up_idx AND n.copy = pmod(c.idx, c.up_copies))
        SELECT tree, idx, folded, trail, subroot FROM climb WHERE up_tree IS NULL""",
        runs=runs,
        nodes=nodes,
    )
    limit = "spark.sql.cteRecursionRowLimit"  # counts rows of all steps; the climb ends by itself at the root
    kept = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return stage(climbed)
    finally:
        spark.conf.set(limit, kept)


def manifest(
    rows: DataFrame, columns: Sequence[str], group: str, key: str, changed: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row a leaf: ``key, leaf, subroot, root, siblings, folded_root``, digests as binary.

    ``siblings`` holds the sibling digests in order, from the leaf's run to the root. ``folded_root`` folds them around the digest
    of the row with ``changed`` columns; it equals ``root`` just where nothing in a hashed column has changed.
    """
    spark = rows.sparkSession
    leaves = stage(leaf_digests(rows, columns, group, key, changed).withColumn("row", F.monotonically_increasing_id()))
    leaf = F.struct(F.pmod("pos", F.lit(FAN)).cast("int").alias("slot"), "key", "digest", "start")
    placed = numbered(leaves, "tree", ["key", "digest", "row"])
    grouped = placed.groupBy("tree", F.expr(f"pos DIV {FAN}").alias("idx"), "size").agg(F.sort_array(F.collect_list(leaf)).alias("leaves"))
    runs = stage(grouped.withColumn("run", _joined(F.transform("leaves", lambda x: x["digest"]))))
    most = runs.agg(F.max("size")).first()[0]
    alone = F.col("size") == 1
    whole = lambda x: F.concat(_before(F.col("run"), x["slot"]), x["start"], _after(F.col("run"), x["slot"]))
    first = runs.select(
        "tree",
        F.lit(1).alias("level"),
        "idx",
        F.when(alone, F.col("run")).otherwise(_hash(F.col("run"))).alias("digest"),
        F.lit(1).cast("long").alias("weight"),
        "run",
        F.transform("leaves", lambda x: F.when(alone, x["start"]).otherwise(_hash(whole(x)))).alias("folded"),
        F.col("tree").alias("up_tree"),
        F.col("idx").alias("pos"),
        F.expr(f"(size + {FAN - 1}) DIV {FAN}").alias("size"),
    )
    linked, last = _levels(first, -(-(most or 0) // FAN))
    trees = stage(reduce(DataFrame.unionByName, last).select(*_NODE))
    n_trees = trees.count()
    if n_trees > 1:
        tops = numbered(trees.withColumn("up_tree", F.lit("")), "up_tree", ["tree"])
        top_linked, top = _levels(tops, n_trees)
        linked += top_linked
        head = reduce(DataFrame.unionByName, top)
    else:
        head = trees
    links = ("up_tree string", "up_level int", "up_idx long", "up_weight long", "slot int")
    head = stage(head.select(*_NODE, *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in links]))
    root = head.select("digest").first()
    root = F.lit(bytes(root[0]) if root else None).cast("binary")
    copies = lambda weight: F.expr(f"({weight} + {MEET - 1}) DIV {MEET}")
    nodes = reduce(DataFrame.unionByName, linked, head).withColumn("up_copies", copies("up_weight"))
    inner = nodes.filter("folded IS NULL").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies("weight") - 1)))
    climbed = _recursive(spark, nodes.filter("folded IS NOT NULL"), stage(inner.drop("folded", "digest", "weight", "up_weight")))
    every = runs.drop("size").join(climbed, ["tree", "idx"]).withColumn("x", F.explode(F.arrays_zip("leaves", "folded")))
    slot = F.col("x.leaves.slot")
    return every.select(
        F.col("x.leaves.key").alias("key"),
        F.col("x.leaves.digest").alias("leaf"),
        F.coalesce("subroot", root).alias("subroot"),
        root.alias("root"),
        F.concat(_before(F.col("run"), slot), _after(F.col("run"), slot), "trail").alias("siblings"),
        F.col("x.folded").alias("folded_root"),
    )


def verify_manifest(docs: DataFrame, columns: Sequence[str], group: str, key: str, changed: Mapping[str, Column]) -> DataFrame:
    """The digests of ``manifest`` as lowercase hex, the hash of the proof, and whether the changed row still folds to the root."""
    found = manifest(docs, columns, group, key, changed)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select(
        F.col("key").alias(key),
        text("leaf"),
        text("subroot"),
        text("root"),
        F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256"),
        text("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
