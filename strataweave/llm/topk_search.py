"""Operator 10: exact top-k inner-product search by norm order and rotated partial sums.

Every component is turned into ``floor(64 * x)``. The right singular vectors of all vectors (from their Gram matrix, summed in
Spark) rotate them so that the first coordinates carry most of each product. Candidates are processed by descending length in
every task. For a block of candidates and a block of queries, three bounds prune before any whole product is formed: the
product of lengths against the query's k-th best score so far, which ends the scan once no shorter vector can do; the partial
sum over the first ``HEAD`` rotated coordinates plus the product of the residual lengths (Cauchy-Schwarz); then the exact
integer product of what is left.

Queries are read in blocks of ``QUERY_BLOCK`` and broadcast block by block. The k-th best scores of a block are first taken
from the longest vectors, so tasks start with good thresholds and send back only what can still be among the best.

Vectors that are null or hold a null or non-finite component take no part. Shorter vectors count as padded with zeros, so an
empty one scores 0 with all. Ties go to the smaller ``vec_id``, rows without an id last. Every row is known by a number of its own:
rows that repeat an id are queries and candidates each by itself. Other columns are ignored; an empty table gives an empty one. Scores are exact while they
are below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import stage

K = 20
QUERY_BLOCK = 4096
HEAD = 16
_BLOCK = 2048
_SEED_ROWS = 4096


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``row`` (a number of its own), ``vec_id, v`` (array of whole doubles), ``length`` of the vectors that take part."""
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    kept = vectors.filter(x.isNotNull() & ~bad)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * 64).cast("double"))
    out = kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v"))
    return out.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    size = np.diff(at)
    row = np.repeat(np.arange(len(column)), size)
    place = np.arange(at[0], at[-1]) - np.repeat(at[:-1], size)
    out[row, place] = flat[at[0] : at[-1]]
    return out


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("v"), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "x"])

    return run


class Vectors(NamedTuple):
    row: np.ndarray
    id: np.ndarray
    void: np.ndarray  # rows without an id
    matrix: np.ndarray


def _vectors(table: pa.RecordBatch | pa.Table, width: int) -> Vectors:
    v, ids = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column("v"), table.column("vec_id")))
    return Vectors(table.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), _matrix(v, width))


class Block:
    """Query vectors with their rotated heads, residual lengths and thresholds."""

    def __init__(self, own: Vectors, rotation: np.ndarray, least: np.ndarray):
        self.row, self.ids, _, matrix = own
        self.matrix, self.rotation, self.least = matrix, rotation, least
        self.length = np.sqrt((matrix * matrix).sum(axis=1))
        self.head = matrix @ rotation[:, :HEAD]
        self.rest = np.sqrt(np.maximum(self.length**2 - (self.head**2).sum(axis=1), 0.0))


def scan(queries: Block, rows: Vectors, k: int, found: dict, least: np.ndarray) -> None:
    """Bring candidates, longest first, to the queries' best lists; ``least`` are the thresholds and rise."""
    matrix = rows.matrix
    length = np.sqrt((matrix * matrix).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), _BLOCK):
        part = order[lo : lo + _BLOCK]
        slack = 1e-9 * length[part[0]] * queries.length + 1e-6
        live = np.flatnonzero(queries.length * length[part[0]] + slack >= least)
        if not len(live):
            return
        own = matrix[part]
        head = own @ queries.rotation[:, :HEAD]
        rest = np.sqrt(np.maximum(length[part] ** 2 - (head**2).sum(axis=1), 0.0))
        bound = queries.head[live] @ head.T + queries.rest[live][:, None] * rest[None, :] + slack[live][:, None]
        open_ = bound >= least[live][:, None]
        for row in np.flatnonzero(open_.any(axis=1)).tolist():
            q = live[row]
            at = np.flatnonzero(open_[row])
            at = at[rows.row[part[at]] != queries.row[q]]
            score = np.rint(own[at] @ queries.matrix[q])
            good = score >= least[q]
            if not good.any():
                continue
            old = found.get(q, (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)))
            new = part[at[good]]
            ids, void, scores = map(np.concatenate, zip(old, (rows.id[new], rows.void[new], score[good])))
            top = np.lexsort((ids, void, -scores))[:k]  # ties to the smaller id, none last
            found[q] = (ids[top], void[top], scores[top])
            if len(top) == k:
                least[q] = max(least[q], scores[top[-1]])


def _search(block, width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, found = block.value, {}
        least = queries.least.copy()
        for batch in batches:
            scan(queries, _vectors(batch, width), k, found, least)
        for q, (ids, void, scores) in found.items():
            own = [pa.array(np.full(len(ids), x[q])) for x in (queries.row, queries.ids)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(ids, mask=void), pa.array(scores.astype(np.int64))], ["query_row", "query_id", "vec_id", "score"])

    return run


def topk(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest products of each query row with the other rows."""
    spark = vectors.sparkSession
    numbers = stage(whole_numbers(vectors))
    head = numbers.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n"), F.max("length").alias("m")).first()
    schema = "query_row long, query_id long, vec_id long, score long"
    if not head.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, int(head.w))
    cells = numbers.mapInArrow(_gram(width), "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    gram = np.zeros(width * width)
    gram[cells.column("cell").to_numpy()] = cells.column("x").to_numpy()
    values, axes = np.linalg.eigh(gram.reshape(width, width))
    rotation = axes[:, ::-1]

    longest = numbers.orderBy(F.desc("length"), "vec_id").limit(_SEED_ROWS).toArrow()
    seed = _vectors(longest, width)
    # every task has a share of the candidates, longest first
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = stage(numbers.repartition(parts, F.xxhash64("row")).sortWithinPartitions(F.desc("length")))

    queries = stage(numbers.filter(is_query))
    asked = queries.count()
    blocks = 1 if asked <= QUERY_BLOCK else -(-2 * asked // QUERY_BLOCK)
    found = None
    for b in range(blocks):
        own = (queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).toArrow()
        if not own.num_rows:
            continue
        block = Block(_vectors(own, width), rotation, np.full(own.num_rows, -np.inf))
        first: dict = {}
        least = block.least.copy()
        scan(block, seed, k, first, least)
        block.least = least
        part = ordered.mapInArrow(_search(spark.sparkContext.broadcast(block), width, k), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
