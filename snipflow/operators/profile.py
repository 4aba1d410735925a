"""Corpus-level feature analytics (F40-F44) over a feature table.

All are aggregations with map-side combine; the only wide intermediate is the
unpivot of F42, which is linear in the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipflow.schemas import FEATURE_NAMES


def feature_profile(df: DataFrame, label: str = "label") -> DataFrame:
    """mean of every feature per class (separability at a glance)."""
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.round(F.avg(c), 6).alias(c) for c in FEATURE_NAMES])


def signature_collisions(df: DataFrame, label: str = "label") -> DataFrame:
    """identical 39-vectors shared by more than one class."""
    return (df.groupBy(*FEATURE_NAMES).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_set(label)).alias("_labels"))
        .where(F.size("_labels") > 1)
        .withColumn("n_labels", F.size("_labels"))
        .withColumn("labels", F.array_join("_labels", ","))
        .drop("_labels"))


def nonzero_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """sparse view — one row per non-zero feature of a row."""
    return (df.unpivot(keys, FEATURE_NAMES, "feature", "value")
            .where(F.col("value") != 0))


def feature_map(df: DataFrame) -> DataFrame:
    """the features as a name -> value map and as a vector in saved order."""
    from pyspark.ml.feature import VectorAssembler
    m = F.create_map(*[x for n in FEATURE_NAMES for x in (F.lit(n), F.col(n))])
    vec = VectorAssembler(inputCols=FEATURE_NAMES, outputCol="features_vec").transform(df)
    return vec.withColumn("features_map", m)


def naming_sensitivity(df: DataFrame, template: str = "template_key") -> DataFrame:
    """templates whose feature vector changes across renderings, and which
    features move (distinct values > 1)."""
    # Unpivot then dedupe: one narrow row per (template, feature, value), so
    # 39 distinct counts cost two small aggregations instead of a 39-way Expand.
    long = df.select(template, *FEATURE_NAMES).unpivot(template, FEATURE_NAMES, "feature", "value")
    distinct_vals = long.select(template, "feature", "value").distinct()
    return (distinct_vals.groupBy(template, "feature").agg(F.count(F.lit(1)).alias("n_values"))
            .where(F.col("n_values") > 1))
