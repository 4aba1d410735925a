"""Scoring jobs (J6): snippet -> features -> class + confidence -> rules.

H1 is one composition over a table of submissions; H2 turns the request
errors of a service into rows with a status; H3 (streaming/score_stream.py)
runs H1 per micro-batch.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipflow.functions.text import is_blank
from snipflow.operators import features, model, rules
from snipflow.operators.parse import parse_nodes, sample_ids
from snipflow.schemas import FEATURE_NAMES
from snipflow.session import materialize
from snipflow.schemas import SYNTAX_ERRORS

# --- fixed values: request error texts -----------------------------------------
MSG_EMPTY = "`code` field is empty."
MSG_PARSE = "Could not parse code: "
MSG_EXTRACT = "Feature extraction failed: "
# -------------------------------------------------------------------------------


def analyse(subs: DataFrame, fitted: PipelineModel, id_col: str = "sub_id") -> DataFrame:
    """H1 + H2: one row per submission.

    ok rows carry algorithm, confidence, the complexity estimate and the
    feature map; error rows carry status and detail and never fail the job.
    """
    s = sample_ids(subs.withColumn("_blank", is_blank(F.col("code"))))
    todo = s.where(~F.col("_blank"))
    nodes = materialize(features.wide_nodes(parse_nodes(todo, columns=features.READ_COLUMNS, keep=features.read_by_features)), "wide_nodes")
    feats = features.features_of(nodes)
    errs = nodes.where(F.col("kind") == "ParseError").select("sample_id", "error_type", "parse_error")
    scored = model.predict(fitted, feats).withColumnRenamed("confidence", "model_confidence")
    est = rules.estimate(scored)
    fmap = F.create_map(*[x for n in FEATURE_NAMES for x in (F.lit(n), F.col(n))])
    ok = est.select("sample_id",
                    F.col("predicted_label").alias("algorithm"),
                    F.col("model_confidence").alias("confidence"),
                    F.struct("time_complexity", "space_complexity", "reasoning", "confidence")
                    .alias("complexity"),
                    fmap.alias("features"))
    out = (s.join(ok, "sample_id", "left").join(errs, "sample_id", "left"))
    status = (F.when(F.col("_blank"), "empty")
              .when(F.col("error_type").isin(*SYNTAX_ERRORS), "parse_error")
              .when(F.col("error_type").isNotNull(), "extraction_error")
              .when(F.col("algorithm").isNotNull(), "ok")
              .otherwise("extraction_error"))
    detail = (F.when(status == "empty", F.lit(MSG_EMPTY))
              .when(status == "parse_error", F.concat(F.lit(MSG_PARSE), F.col("parse_error")))
              .when(status == "extraction_error",
                    F.concat(F.lit(MSG_EXTRACT), F.coalesce(F.col("parse_error"), F.lit("unknown")))))
    return out.select(id_col, status.alias("status"), detail.alias("detail"), "algorithm",
                      "confidence", "complexity", "features")
