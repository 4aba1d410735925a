"""A5 + J3: one saved model from text to class, and the training job.

The bundle is a PipelineModel whose first stage parses snippets into the 39 features,
followed by the fitted forest's stages and the class names; loading it is all that
scoring raw code needs.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipflow.operators import evaluation, features, model
from snipflow.operators.parse import parse_nodes, sample_ids
from snipflow.session import materialize


class CodeFeatures(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the 39 features of the code in ``inputCol``; rows that do not parse are left out."""

    def __init__(self, inputCol: str = "code"):
        super().__init__()
        self._setDefault(inputCol="code")
        self._set(inputCol=inputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        code = self.getInputCol()
        feats = features.compute_features(parse_nodes(dataset, code, features.READ_COLUMNS, features.read_by_features))
        return sample_ids(dataset, code).join(feats, "sample_id").drop("sample_id")


def bundle(fitted: PipelineModel, code: str = "code") -> PipelineModel:
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=model.labels_of(fitted))
    return PipelineModel(stages=[CodeFeatures(code), *fitted.stages, names])


def score(saved: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows of raw code that parse, with predicted_label and confidence."""
    out = saved.transform(df)
    return out.withColumn("confidence", F.round(F.array_max(vector_to_array("probability")), 4))


def train(corpus: DataFrame, model_dir: str, split_key: str, tiebreak: list[str], **forest) -> dict[str, DataFrame | int]:
    """Features, stratified split, balanced forest, report, saved bundle.

    ``split_key``: SQL expression spread over [0, 2**31). Returns report, confusion,
    importances, rejects (rows that do not parse) and the number of training rows."""
    good, rejects = features.build_features(corpus)
    rows = materialize(evaluation.stratified_split(good.withColumn("split_key", F.expr(split_key)), "split_key", tiebreak), "split")
    learn = rows.where("split = 'train'")
    fitted = model.fit(learn, **forest)
    model.save(bundle(fitted), model_dir)
    test = model.predict(fitted, rows.where("split = 'test'"))
    test = test.select(F.col("label").alias("y"), F.col("predicted_label").alias("pred"))
    return {"report": evaluation.classification_report(test), "confusion": evaluation.confusion_long(test),
            "importances": model.importances(corpus.sparkSession, fitted), "rejects": rejects, "n_train": learn.count()}
