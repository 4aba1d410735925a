"""Sources and sinks.

The reference keeps its corpus as one JSON array document and its features as
one CSV file. We read those formats, but write directories of part files
(JSON lines / CSV / Parquet) so that writing scales with the cluster.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snipflow.operators.corpus import validated
from snipflow.schemas import FEATURE_NAMES, FEATURES_SCHEMA, TRACE_STEPS_SCHEMA
from snipflow.session import delete_path
from snipflow.sources.records import CORRUPT, read_records

CORPUS_DEBUG_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), True),
    T.StructField("label", T.StringType(), True),
    T.StructField("source_template_idx", T.IntegerType(), True),
    T.StructField("variant", T.IntegerType(), True),
    T.StructField("original_algorithm", T.StringType(), True),
])

SUBMISSION_SCHEMA = T.StructType([
    T.StructField("sub_id", T.StringType(), True),
    T.StructField("code", T.StringType(), True),
    T.StructField("entry_call", T.StringType(), True),
])


def _reader(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet, or JSON records of any layout (see ``records``)."""
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path).withColumn(CORRUPT, F.lit(None).cast("string"))
    return read_records(spark, path, schema)


def read_corpus(spark: SparkSession, *paths: str, debug: bool = False, keep_bad: bool = False) -> DataFrame:
    """A1: the first path that exists wins; none -> FileNotFoundError.

    A record that does not parse fails the job, with its text; with ``keep_bad`` it is a
    row whose text stands in ``corrupt_record``, and all rows carry ``row_id`` (JSON
    only), their number in file order. Debug columns are also read with a leading
    underscore in their names."""
    fields = CORPUS_DEBUG_SCHEMA.fields if debug else CORPUS_DEBUG_SCHEMA.fields[:2]
    other = [T.StructField(f"_{f.name}", f.dataType, True) for f in fields[2:]]
    schema = T.StructType([*fields, *other])
    for p in paths:
        try:
            df = _reader(spark, p, schema)
            df.schema  # noqa: B018 — resolves the path now
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
                continue
            raise
        for f in other:
            df = df.withColumn(f.name[1:], F.coalesce(f.name[1:], f.name)).drop(f.name)
        if keep_bad:
            return df
        bad = F.raise_error(F.concat(F.lit("corpus record does not parse: "), F.substring(CORRUPT, 1, 200)))
        code = F.when(F.col(CORRUPT).isNotNull(), bad.cast("string")).otherwise(F.col("code"))
        return df.select(code.alias("code"), *[f.name for f in fields[1:]])
    raise FileNotFoundError(f"no corpus at any of: {', '.join(paths)}")


def write_corpus(df: DataFrame, out_dir: str) -> None:
    """A2: debug corpus (all columns) and clean corpus (code, label)."""
    df.write.mode("overwrite").json(f"{out_dir}/dataset_debug")
    df.select("code", "label").write.mode("overwrite").json(f"{out_dir}/dataset")


def write_validated(corpus: DataFrame, out_dir: str, shown: int = 20) -> int:
    """Write the corpus, rejects apart with their message (``rejected=true``), and
    fail if there are any; returns the number of rows.

    One pass: the counts are observed while the rows are written."""
    rows = validated(corpus)
    seen = Observation("validated")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count("parse_error").alias("n_rejected"))
    (rows.withColumn("rejected", F.col("parse_error").isNotNull()).drop("sample_id")
     .write.mode("overwrite").partitionBy("rejected").json(out_dir))
    if seen.get["n_rejected"]:
        first = corpus.sparkSession.read.json(f"{out_dir}/rejected=true").select("parse_error").limit(shown).collect()
        raise ValueError(f"{seen.get['n_rejected']} of {seen.get['n']} snippets do not parse (written to {out_dir}/rejected=true): "
                         + "; ".join(r[0] for r in first))
    return seen.get["n"]


def write_features(df: DataFrame, path: str) -> None:
    """A3: header, features in order then label; refuse to write nothing (the rows are
    counted while they are written). Quotes inside values are doubled, as Python's csv
    module does."""
    seen = Observation("features")
    (df.select(*FEATURE_NAMES, "label").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
     .option("header", True).option("escape", '"').csv(path))
    if not seen.get.get("n"):
        delete_path(df.sparkSession, path)
        raise ValueError("no feature rows to write; fix the failed extractions first")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A4: feature table with the explicit schema; returns (all columns, X only)."""
    df = (spark.read.schema(FEATURES_SCHEMA).option("header", True).option("escape", '"')
          .option("multiLine", True).csv(path))         # labels may hold line breaks
    return df, df.drop("label")


def read_submissions(spark: SparkSession, path: str, stream: bool = False, max_files: int = 1000) -> DataFrame:
    """Snippets to analyse, as a table or as a stream of JSON files (``max_files`` a batch)."""
    if stream:
        return spark.readStream.schema(SUBMISSION_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)
    return spark.read.schema(SUBMISSION_SCHEMA).json(path)


def read_steps(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Step records (run_id, seq, event, ...) from Parquet, batch or stream."""
    if stream:
        return spark.readStream.schema(TRACE_STEPS_SCHEMA).parquet(path)
    return spark.read.schema(TRACE_STEPS_SCHEMA).parquet(path)


def write_steps(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def features_as_map(df: DataFrame) -> DataFrame:
    """F43 helper for sinks that want name -> value."""
    return df.withColumn("features", F.create_map(*[x for n in FEATURE_NAMES
                                                    for x in (F.lit(n), F.col(n))]))
