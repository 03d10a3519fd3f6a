"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.oracles import ORACLES  # noqa: F401

QUERIES = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reach_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started; a cluster has it installed."""
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH", "")]))


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        reach_package(spark)
        return fn(spark, sf)

    QUERIES[fn.__name__] = run
    return run


@query
def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf, "documents"))


@query
def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.llm.decontaminate import scan

    found = scan(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


@query
def op1_lattice_score(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.llm.lattice_score import lattice_scores

    return lattice_scores(_table(spark, sf, "documents"))


@query
def op6_piece_codec(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.llm.piece_codec import encode

    coded = encode(_table(spark, sf, "documents").select("doc_id", "text"), check="round_trip")
    return coded.select("doc_id", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), "token_ids", "round_trip")


@query
def op9_two_pass_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.llm.two_pass_shuffle import shard_digest, two_pass_shuffle

    return shard_digest(two_pass_shuffle(_table(spark, sf, "documents")))


@query
def op10_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.llm.topk_search import topk

    return topk(_table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_zip_archive(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.llm.zip_archive import read_archives, write_archives

    records = read_archives(write_archives(_table(spark, sf, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@query
def op8_co_training(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.llm.co_training import score, train

    docs = _table(spark, sf, "documents")
    return score(docs, train(docs, _table(spark, sf, "labels")))


@query
def op2_link_trust(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.llm.link_trust import url_verdicts

    return url_verdicts(_table(spark, sf, "pages"))


@query
def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Paths are made from source, language and id; every 64th document is the licence file of its directory."""
    from strataweave.llm.license_scan import scan_licences

    docs = _table(spark, sf, "documents")
    source, lang, block = F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.expr("CAST(doc_id DIV 64 AS STRING)")
    name = F.concat(F.lit("LICENSE-"), "doc_id")
    path = (
        F.when(F.col("doc_id") % 4096 == 0, F.concat_ws("/", source, name))
        .when(F.col("doc_id") % 512 == 0, F.concat_ws("/", source, lang, name))
        .when(F.col("doc_id") % 64 == 0, F.concat_ws("/", source, lang, block, name))
        .otherwise(F.concat_ws("/", source, lang, block, F.concat("doc_id", F.lit(".txt"))))
    )
    return scan_licences(docs.select("doc_id", path.alias("path"), "text"))


@query
def op11_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.llm.best_fit_packing import pack_documents

    return pack_documents(_table(spark, sf, "documents"))


@query
def op12_merkle_climb(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth document by checksum of its id has its text lower-cased after the manifest was made."""
    from strataweave.llm.merkle_climb import lower_ascii, verify_manifest

    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    text = F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    return verify_manifest(_table(spark, sf, "documents"), columns, "source", "doc_id", {"text": text})


@query
def op13_toivonen(spark: SparkSession, sf: str) -> DataFrame:
    from strataweave.llm.toivonen import collocations

    return collocations(_table(spark, sf, "documents"))
