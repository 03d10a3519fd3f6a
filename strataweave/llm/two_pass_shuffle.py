"""Operator 9: shuffled shards by a two-pass external shuffle.

First pass: every row is scattered to one of many buckets by a seeded hash of its ``doc_id``; the number of buckets follows
from the bytes of all texts so that a bucket fits a task's memory. Ids that more than a fraction of a bucket share (and null ids)
are scattered by their place in the input instead, so no bucket is hot. Second pass: each bucket is read by one task, put in a
fixed order, shuffled by a seeded Fisher-Yates pass and written. With the bucket counts (one number for each bucket) every
row knows its place in the whole shuffle; places are dealt to the shards in turn, so their row counts differ by one at most
(law ``rows``).

The written table holds all columns of the input as ``doc`` beside ``shard`` and ``slot``, so clashing names do no harm. Null
texts count 8 bytes and have the checksum of an empty text. Repeated rows are kept, each with a slot of its own. Empty tables
give empty shards. The input is read three times, so it should be a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.session import stage

SHARDS = 24
#: Bytes of text that one task shuffles in memory.
BUCKET_BYTES = 24 << 20
SEED = 20_071


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation: each place, from the last, swaps with one before it or itself."""
    random = np.random.Generator(np.random.Philox(seed))
    order = np.arange(n).tolist()
    picks = random.integers(0, np.arange(1, n + 1)).tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def scatter(docs: DataFrame, buckets: int, seed: int, heavy: list) -> DataFrame:
    """``bucket``, ``mark`` (a fixed order within the bucket) and the row as ``doc``."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    spread = F.col("doc_id").isNull()
    if heavy:
        spread = spread | F.col("doc_id").isin(heavy)
    bucket = F.pmod(F.when(spread, place).otherwise(key), F.lit(buckets)).cast("int")
    mark = F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text"))
    return docs.select(bucket.alias("bucket"), mark.alias("mark"), F.struct("*").alias("doc"))


def _shuffle_buckets(seed: int, offsets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = offsets.value

        def done(parts: list[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            by_mark = np.argsort(table.column("mark").to_numpy(), kind="stable")
            order = by_mark[fisher_yates(len(by_mark), seed * 1_000_003 + bucket)]
            places = first[bucket] + np.arange(len(order))
            for lo in range(0, len(order), 2_000):
                rows = table.select(["doc"]).take(pa.array(order[lo : lo + 2_000])).combine_chunks()
                own = places[lo : lo + 2_000]
                for batch in rows.to_batches():
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array((own % SHARDS).astype(np.int32)), pa.array(own // SHARDS)], ["doc", "shard", "slot"]
                    )

        held, current = [], None
        for batch in batches:
            ids = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if held and ids[lo] != current:
                    yield from done(held, current)
                    held = []
                current = int(ids[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done(held, current)

    return run


def two_pass_shuffle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The written shuffle: ``doc`` (the row), ``shard``, ``slot``."""
    spark = docs.sparkSession
    total, rows = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // BUCKET_BYTES))
    # ids of so many rows number at most 16 for each bucket
    least = max(64, -(-rows // (16 * buckets)))
    ids = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count()
    heavy = [r.doc_id for r in ids.filter(F.col("count") > least).select("doc_id").collect()]
    placed = scatter(docs, buckets, seed, heavy)
    counts = placed.groupBy("bucket").count().collect()  # one row for each bucket
    sizes = np.zeros(buckets + 1, np.int64)
    for r in counts:
        sizes[r["bucket"] + 1] = r["count"]
    offsets = spark.sparkContext.broadcast(np.cumsum(sizes))
    dealt = placed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    schema = T.StructType([placed.schema["doc"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return stage(dealt.mapInArrow(_shuffle_buckets(seed, offsets), schema))


def shard_digest(written: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every written row."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    return written.select(
        F.col("doc.doc_id").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
