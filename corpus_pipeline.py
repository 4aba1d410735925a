"""Corpus pipeline: five stages over ``documents``, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared checkpoint folder and reads it back as the
next stage's documents. Stages keep the columns of ``documents``; the last
returns the mix's manifest: one row per document it takes, with the number of
copies and the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snipflow.llm import decontaminate, line_dedup, minhash_dedup, mixing, quality
from snipflow.session import Scratch
from snipflow.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (probability of 0.3 or more)."""
    scores = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    bad = scores.where(F.col("score") < quality.THRESHOLD).select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(bad, docs.doc_id == bad.bad, "left_anti").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source leave the texts; emptied texts go."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    had = F.col("n_dropped") > 0
    return (out.where(~had | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
            .withColumn("n_chars", F.when(had, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest id."""
    gone = (minhash_dedup.near_duplicates(docs, width=5, threshold=80).where("NOT kept")
            .select(F.col("doc_id").alias("gone")).distinct())
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    out = decontaminate.contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return out.where("NOT contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the mix: documents taken, their copies and words."""
    return (mixing.mix_sources(docs, keep=("lang", "n_chars")).where("copies > 0")
            .select("doc_id", "lang", "source", "n_chars", "size", "source_size", "target", "copies", "taken"))


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", drop_boilerplate),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix),
]

# A trained classifier and subset sums have no SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
