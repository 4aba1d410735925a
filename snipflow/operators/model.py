"""The classifier (J3, J4, J6) on Spark ML.

Pipeline = StringIndexer (labels sorted alphabetically) -> VectorAssembler (the
39 features in their saved order) -> RandomForestClassifier with balanced
class weights. Training is distributed by Spark ML; the fitted forest is
broadcast once by ``transform``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipflow.operators.evaluation import with_class_weight
from snipflow.schemas import FEATURE_NAMES

# --- fixed values: forest settings -------------------------------------------
NUM_TREES = 200
MAX_DEPTH = 10
SEED = 42
# -----------------------------------------------------------------------------


def pipeline(num_trees: int = NUM_TREES, max_depth: int = MAX_DEPTH, seed: int = SEED,
             max_bins: int = 32) -> Pipeline:
    """``max_bins``: distinct split values kept per feature; raise it for features
    with more distinct counts, which are binned otherwise."""
    indexer = StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc",
                            handleInvalid="keep")
    assembler = VectorAssembler(inputCols=FEATURE_NAMES, outputCol="features")
    rf = RandomForestClassifier(labelCol="label_idx", featuresCol="features", weightCol="weight",
                                numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                featureSubsetStrategy="sqrt", maxBins=max_bins)
    return Pipeline(stages=[indexer, assembler, rf])


def fit(train: DataFrame, **kw) -> PipelineModel:
    """M3 + M4: balanced weights from the training rows, then the forest.

    The forest samples rows per partition, so the same seed gives the same
    forest only if rows land in the same partitions in the same order. Rows
    are therefore hash-partitioned and sorted by their content (equal rows are
    interchangeable) — one shuffle of the training set buys reproducibility.
    """
    cols = [*FEATURE_NAMES, "label"]
    d = with_class_weight(train.select(*cols))
    n = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    d = d.repartition(n, *cols).sortWithinPartitions(*cols)
    return pipeline(**kw).fit(d)


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M5 + M6: predicted class name and max class probability (rounded to 4).
    Equal probabilities go to the alphabetically first class (lowest index)."""
    out = model.transform(df)
    out = IndexToString(inputCol="prediction", outputCol="predicted_label",
                        labels=labels_of(model)).transform(out)
    return out.withColumn("confidence", F.round(F.array_max(vector_to_array("probability")), 4))


def importances(spark: SparkSession, model: PipelineModel, top: int = 15) -> DataFrame:
    """The forest's feature importances, largest first (a 39-row table)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(FEATURE_NAMES, imp)]
    from snipflow.session import literal_df
    df = literal_df(spark, rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top)


def save(model: PipelineModel, path: str) -> None:
    """A5: the pipeline directory holds the forest and the feature order."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except Exception as exc:  # missing or unreadable model directory
        raise RuntimeError(f"no trained model at {path}; train first") from exc


def cross_validate(df: DataFrame, fold_col: str = "fold", k: int = 3, **kw) -> DataFrame:
    """Fit on k-1 folds, predict the held-out fold, for each fold."""
    parts = []
    for f in range(k):
        m = fit(df.where(F.col(fold_col) != f), **kw)
        p = predict(m, df.where(F.col(fold_col) == f))
        parts.append(p.select(F.lit(f).alias("fold"), F.col("label").alias("y"),
                              F.col("predicted_label").alias("pred")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
