"""Corpus pipeline: toxicity, near-duplicates, personal data, mixture, packing; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofferlake.llm.common import discard, fresh, materialise, release, table
from cofferlake.llm.minhash import near_duplicates
from cofferlake.llm.mixing import mixed_documents
from cofferlake.llm.packing import packed_documents
from cofferlake.llm.pii import redacted
from cofferlake.llm.toxicity import toxicity_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; columns may have any names."""
    names = {c: fresh(docs, c) for c in ("score", "offending", "predicted")}
    scored = toxicity_scores(docs, table(spark, sf_dir, "labels"), keep=docs.columns, renamed=names)
    return scored.where(F.col(names["predicted"]) == 0).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows that repeat a doc_id stay or go together, null ones stay."""
    kept = near_duplicates(docs, width=5, percent=80, bands=48, rows_per_band=6).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind."""
    return redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences."""
    return packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: the first stages are trained models and sketches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
