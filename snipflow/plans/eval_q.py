"""Registered dataset/evaluation queries: M1-M3, M6-M9, M11-M13, M15 and
F40-F44, on X4 feature rows and X5 predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipflow.operators import evaluation as ev
from snipflow.operators import profile
from snipflow.schemas import FEATURE_NAMES
from snipflow.sources import fixtures as fx

KEYS = fx.X4_KEYS


def _x4(spark, sf_dir):
    return fx.x4_features(spark, sf_dir).withColumn("split_key", F.expr(fx.X4_SPLIT_KEY))


def _split(spark, sf_dir):
    return ev.stratified_split(_x4(spark, sf_dir), "split_key", fx.X4_TIEBREAK)


def dataset_summary(spark, sf_dir):
    return ev.dataset_summary(fx.x4_features(spark, sf_dir).select(*FEATURE_NAMES, "label"))


def class_counts(spark, sf_dir):
    return ev.class_counts(fx.x4_features(spark, sf_dir))


def split_rows(spark, sf_dir):
    return _split(spark, sf_dir).select(*KEYS, "label", "split")


def split_summary(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("split") == "test", 1)).alias("n_test"),
        F.count(F.when(F.col("split") == "train", 1)).alias("n_train"))


def train_class_weights(spark, sf_dir):
    train = _split(spark, sf_dir).where(F.col("split") == "train")
    return ev.class_weights(train).withColumn("weight", F.round("weight", 6))


def fold_rows(spark, sf_dir):
    return ev.stratified_folds(_x4(spark, sf_dir), "split_key", fx.X4_TIEBREAK).select(
        *KEYS, "label", "fold")


def fold_summary(spark, sf_dir):
    return fold_rows(spark, sf_dir).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def feature_profile(spark, sf_dir):
    return profile.feature_profile(fx.x4_features(spark, sf_dir))


def signature_collisions(spark, sf_dir):
    return profile.signature_collisions(fx.x4_features(spark, sf_dir))


def nonzero_features(spark, sf_dir):
    return profile.nonzero_features(fx.x4_features(spark, sf_dir).select(*KEYS, *FEATURE_NAMES),
                                    KEYS)


def feature_vector(spark, sf_dir):
    """the assembled vector in saved feature order (as text) and the
    name -> value map (its size and one looked-up entry)."""
    from pyspark.ml.functions import vector_to_array
    m = profile.feature_map(fx.x4_features(spark, sf_dir))
    vec = F.array_join(F.transform(vector_to_array("features_vec"), lambda v: v.cast("string")), ",")
    return m.select(*KEYS, vec.alias("features_text"),
                    F.size(F.map_keys("features_map")).alias("n_features"),
                    F.element_at("features_map", F.lit("max_loop_depth")).alias("max_loop_depth"))


def naming_sensitivity(spark, sf_dir):
    return profile.naming_sensitivity(fx.x4_features(spark, sf_dir))


def _x5(spark, sf_dir):
    p = fx.x5_predictions(spark, sf_dir)
    return p.withColumn("confidence", ev.confidence(F.col("probability")))


def eval_confidence(spark, sf_dir):
    p = _x5(spark, sf_dir)
    top = F.array_position("probability", F.array_max("probability")).cast("int") - 1
    return p.select("doc_id", "pred", "confidence", top.alias("top_index"))


def eval_accuracy(spark, sf_dir):
    return ev.accuracy(_x5(spark, sf_dir))


def eval_class_report(spark, sf_dir):
    return ev.classification_report(_x5(spark, sf_dir))


def eval_confusion(spark, sf_dir):
    return ev.confusion_long(_x5(spark, sf_dir))


def eval_cv(spark, sf_dir):
    return ev.cv_accuracy(_x5(spark, sf_dir))


def eval_heldout(spark, sf_dir):
    return ev.heldout_status(_x5(spark, sf_dir)).select("doc_id", "y", "pred", "status")


def eval_confidence_summary(spark, sf_dir):
    return ev.confidence_summary(_x5(spark, sf_dir))


def eval_class_weights(spark, sf_dir):
    return ev.class_weights(_x5(spark, sf_dir).withColumnRenamed("y", "label")) \
        .withColumn("weight", F.round("weight", 6))


# ------------------------------------------------------------- oracles -----
def _x4_sql():
    return f"SELECT *, {fx.X4_SPLIT_KEY} AS split_key FROM ({fx.x4_sql()}) x"


def _split_sql():
    tb = ", ".join(fx.X4_TIEBREAK)
    return f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY split_key, {tb})
        <= ceil(0.2 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split,
  CAST((row_number() OVER (PARTITION BY label ORDER BY split_key, {tb}) - 1) % 3 AS INT) AS fold
FROM ({_x4_sql()}) x"""


def _x5_sql():
    return (f"SELECT *, round(greatest(p1, p2, p3), 4) AS confidence FROM ({fx.x5_sql()}) p")


def _report_sql():
    return f"""
WITH p AS ({_x5_sql()}),
t AS (SELECT y AS cls, count(*) AS support, sum(CASE WHEN y = pred THEN 1 ELSE 0 END) AS tp
      FROM p GROUP BY y),
q AS (SELECT pred AS cls, count(*) AS n_pred FROM p GROUP BY pred),
per AS (SELECT coalesce(t.cls, q.cls) AS cls, coalesce(support, 0) AS support,
               coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred
        FROM t FULL OUTER JOIN q ON t.cls = q.cls),
m AS (SELECT *, CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                     ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m),
s AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr,
             avg(f1) AS mf, sum(precision * support) / sum(support) AS wp,
             sum(recall * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM f)
SELECT cls AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(tp / n, 6), CAST(n AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(n AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), CAST(n AS BIGINT) FROM s"""


def oracle():
    keys = ", ".join(KEYS)
    feats = ", ".join(FEATURE_NAMES)
    avgs = ", ".join(f"round(avg({c}), 6) AS {c}" for c in FEATURE_NAMES)
    cds = ", ".join(f"count(DISTINCT {c}) AS {c}" for c in FEATURE_NAMES)
    return {
        "dataset_summary": f"SELECT count(*) AS n_rows, 39 AS n_features, count(DISTINCT label) AS n_classes "
                           f"FROM ({fx.x4_sql()}) x",
        "class_counts": f"SELECT label, count(*) AS n FROM ({fx.x4_sql()}) x GROUP BY label",
        "split_rows": f"SELECT {keys}, label, split FROM ({_split_sql()}) s",
        "split_summary": f"""SELECT label, count(*) AS n, count(*) FILTER (WHERE split = 'test') AS n_test,
  count(*) FILTER (WHERE split = 'train') AS n_train FROM ({_split_sql()}) s GROUP BY label""",
        "train_class_weights": f"""SELECT label, n_c,
  round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight
FROM (SELECT label, count(*) AS n_c FROM ({_split_sql()}) s WHERE split = 'train' GROUP BY label) c""",
        "fold_rows": f"SELECT {keys}, label, fold FROM ({_split_sql()}) s",
        "fold_summary": f"SELECT label, fold, count(*) AS n FROM ({_split_sql()}) s GROUP BY label, fold",
        "feature_profile": f"SELECT label, count(*) AS n_rows, {avgs} FROM ({fx.x4_sql()}) x GROUP BY label",
        "signature_collisions": f"""SELECT {feats}, count(*) AS n_rows, CAST(count(DISTINCT label) AS INT) AS n_labels,
  array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
FROM ({fx.x4_sql()}) x GROUP BY ALL HAVING count(DISTINCT label) > 1""",
        "nonzero_features": f"""SELECT * FROM (UNPIVOT (SELECT {keys}, {feats} FROM ({fx.x4_sql()}) x)
  ON {feats} INTO NAME feature VALUE value) u WHERE value <> 0""",
        "feature_vector": f"""SELECT {keys},
  concat_ws(',', {", ".join(f"CAST({c} AS VARCHAR)" for c in FEATURE_NAMES)}) AS features_text,
  39 AS n_features, max_loop_depth FROM ({fx.x4_sql()}) x""",
        "naming_sensitivity": f"""SELECT * FROM (UNPIVOT (SELECT template_key, {cds} FROM ({fx.x4_sql()}) x
  GROUP BY template_key) ON {feats} INTO NAME feature VALUE n_values) u WHERE n_values > 1""",
        "eval_confidence": f"""SELECT doc_id, pred, confidence,
  CAST(CASE WHEN p1 >= p2 AND p1 >= p3 THEN 0 WHEN p2 >= p3 THEN 1 ELSE 2 END AS INT) AS top_index
FROM ({_x5_sql()}) p""",
        "eval_accuracy": f"""SELECT count(*) AS n, CAST(sum(CASE WHEN y = pred THEN 1 ELSE 0 END) AS BIGINT) AS hits,
  round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_x5_sql()}) p""",
        "eval_class_report": _report_sql(),
        "eval_confusion": f"""WITH p AS ({_x5_sql()}), lab AS (SELECT DISTINCT y AS l FROM p),
c AS (SELECT y, pred, count(*) AS n FROM p GROUP BY y, pred)
SELECT a.l AS true_label, b.l AS pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM lab a CROSS JOIN lab b LEFT JOIN c ON c.y = a.l AND c.pred = b.l""",
        "eval_cv": f"""SELECT fold, round(acc, 6) AS accuracy, round(avg(acc) OVER (), 6) AS mean_accuracy,
  round(stddev_pop(acc) OVER (), 6) AS std_accuracy
FROM (SELECT fold, avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS acc FROM ({_x5_sql()}) p
      GROUP BY fold) f""",
        "eval_heldout": f"""SELECT doc_id, y, pred, CASE WHEN y = pred THEN 'OK' ELSE 'MISS' END AS status
FROM ({_x5_sql()}) p""",
        "eval_confidence_summary": f"""SELECT pred, count(*) AS n, round(avg(confidence), 6) AS avg_confidence,
  round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence,
  round(quantile_cont(confidence, 0.5), 6) AS median_confidence FROM ({_x5_sql()}) p GROUP BY pred""",
        "eval_class_weights": f"""SELECT label, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight
FROM (SELECT y AS label, count(*) AS n_c FROM ({_x5_sql()}) p GROUP BY y) c""",
    }


def queries():
    return {
        "dataset_summary": dataset_summary,
        "class_counts": class_counts,
        "split_rows": split_rows,
        "split_summary": split_summary,
        "train_class_weights": train_class_weights,
        "fold_rows": fold_rows,
        "fold_summary": fold_summary,
        "feature_profile": feature_profile,
        "signature_collisions": signature_collisions,
        "nonzero_features": nonzero_features,
        "feature_vector": feature_vector,
        "naming_sensitivity": naming_sensitivity,
        "eval_confidence": eval_confidence,
        "eval_accuracy": eval_accuracy,
        "eval_class_report": eval_class_report,
        "eval_confusion": eval_confusion,
        "eval_cv": eval_cv,
        "eval_heldout": eval_heldout,
        "eval_confidence_summary": eval_confidence_summary,
        "eval_class_weights": eval_class_weights,
    }
