"""Registered queries of the corpus operators; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofferlake.llm.common import table
from cofferlake.llm.hilbert_ann import nearest
from cofferlake.llm.minhash import near_duplicates
from cofferlake.llm.mixing import MIXTURE_SQL, mixture
from cofferlake.llm.oracle import NEAR_SQL, REPAIR_SQL, REPEATS_SQL, SHARDS_SQL, WARC_SQL
from cofferlake.llm.packing import packed_documents
from cofferlake.llm.pii import personal_data
from cofferlake.llm.quality import quality_scores
from cofferlake.llm.repair import conversation_repairs, damaged
from cofferlake.llm.secrets import secret_spans
from cofferlake.llm.sharding import sharded
from cofferlake.llm.suffix_dedup import remove_repeats
from cofferlake.llm.toxicity import in_training, toxicity_scores
from cofferlake.llm.warc import round_trip
from cofferlake.llm.whitening import whitened


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents")).drop("found")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (~F.coalesce(in_training("doc_id"), F.lit(True))).alias("held_out"), "score", "predicted", "offending")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repairs(damaged(rows), rows)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_secrets": op1_secrets, "op2_mixing": op2_mixing, "op3_suffix": op3_suffix, "op4_warc": op4_warc, "op5_minhash": op5_minhash, "op6_hilbert": op6_hilbert, "op7_toxicity": op7_toxicity, "op8_pii": op8_pii, "op9_quality": op9_quality, "op10_packing": op10_packing, "op11_sharding": op11_sharding, "op12_repair": op12_repair, "op13_whitening": op13_whitening}
ORACLE_SQL: dict[str, str] = {"op2_mixing": MIXTURE_SQL, "op3_suffix": REPEATS_SQL, "op4_warc": WARC_SQL, "op5_minhash": NEAR_SQL, "op11_sharding": SHARDS_SQL, "op12_repair": REPAIR_SQL}
