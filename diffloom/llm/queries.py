"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm.byte_bpe import round_trip
from diffloom.llm.chat_format import perspectives
from diffloom.llm.exact_dedup import ascii_lower, exact_duplicates
from diffloom.llm.fill_middle import fill_in_middle, restored
from diffloom.llm.license_scan import NOTICES, license_scan
from diffloom.llm.line_dedup import line_components
from diffloom.llm.merkle import folded, manifest, node_hash, proof_text, record_leaf
from diffloom.llm.minhash_dedup import near_duplicates
from diffloom.llm.packing import pack
from diffloom.llm.sharding import shard_table
from diffloom.llm.token_counts import unigram_counts
from diffloom.llm.toxicity import toxicity
from diffloom.llm.vector_dedup import near_vectors

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_metric_join(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"), similarity=0.95)


def op2_chat_perspectives(spark, sf_dir):
    return perspectives(table(spark, sf_dir, "conversations"))


def op3_minhash_tensored(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, similarity=0.8)


def op4_exact_stream(spark, sf_dir):
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")


def op5_toxicity_neighbours(spark, sf_dir):
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    training = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    scored = toxicity(table(spark, sf_dir, "documents"), training)
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op6_fuzzy_lines(spark, sf_dir):
    return line_components(table(spark, sf_dir, "documents"))


def op7_nnls_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), window=2048, terminator=1).drop("cut")


def op8_unigram_counts(spark, sf_dir):
    return unigram_counts(table(spark, sf_dir, "documents"))


def op9_license_digests(spark, sf_dir):
    known = spark.createDataFrame(NOTICES, "license_id string, text string")
    found = license_scan(table(spark, sf_dir, "documents"), known)
    return found.withColumn("notices", F.array_join("notices", ","))


def op10_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


def op11_rendezvous_shards(spark, sf_dir):
    """16 shards of equal weight, and where each record goes with one more."""
    sharded = shard_table(table(spark, sf_dir, "documents"), [1.0] * 16, grown=[1.0] * 17)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op12_merkle_butterfly(spark, sf_dir):
    """Manifest of documents by language, checked with every third record tampered with."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tampered = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in columns]
    found = manifest(
        docs, columns, "lang", "doc_id",
        tampered=F.when(number % 3 == 0, record_leaf(*tampered)),
    )
    root = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", node_hash(proof_text(F.col("path"))).alias("proof_sha256"),
        root.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_fill_middle(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_rate=50)
    text = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        node_hash(F.col("output")).alias("output_sha256"), node_hash(text).alias("restored_sha256"),
    )


QUERIES: dict[str, Query] = {
    name: value for name, value in list(globals().items()) if name.startswith("op") and callable(value)
}
