"""Registered learner queries on the X6 corpus (M4-M6, M10, M12-M14, M8/M9 on
real predictions). A learner has no SQL oracle: tests check properties."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from snipflow.operators import evaluation as ev
from snipflow.operators import features, model
from snipflow.plans.corpus_q import _render_sql
from snipflow.schemas import FEATURE_NAMES
from snipflow.session import materialize
from snipflow.sources import fixtures as fx

SPLIT_KEY = "((doc_id % 2147483647) * 48271) % 2147483647"


def _data(spark, sf_dir):
    good, _ = features.build_features(materialize(fx.x6_corpus(spark, sf_dir), "x6_corpus"))
    d = good.select("doc_id", "template_idx", "label", *FEATURE_NAMES) \
        .withColumn("split_key", F.expr(SPLIT_KEY))
    return materialize(ev.stratified_split(d, "split_key", ["doc_id"]))


def _fitted(spark, sf_dir):
    d = _data(spark, sf_dir)
    m = model.fit(d.where(F.col("split") == "train"))
    return d, m


def model_predictions(spark, sf_dir):
    d, m = _fitted(spark, sf_dir)
    p = model.predict(m, d.where(F.col("split") == "test"))
    return ev.heldout_status(p.select("doc_id", F.col("label").alias("y"),
                                      F.col("predicted_label").alias("pred"), "confidence"))


def model_report(spark, sf_dir):
    return ev.classification_report(model_predictions(spark, sf_dir))


def model_confusion(spark, sf_dir):
    return ev.confusion_long(model_predictions(spark, sf_dir))


def model_importances(spark, sf_dir):
    _, m = _fitted(spark, sf_dir)
    return model.importances(spark, m)


def model_properties(spark, sf_dir):
    """What holds for any forest on its own split. Per class: rows of either
    side, test rows whose predicted class occurs in training, and whose confidence lies
    between that of an even vote and 1; and, for the whole, whether the importances sum
    to 1 and accuracy beats guessing the largest class."""
    d, m = _fitted(spark, sf_dir)
    k = len(model.labels_of(m))
    known = d.where(F.col("split") == "train").select(F.col("label").alias("predicted_label"), F.lit(True).alias("known")).distinct()
    p = model.predict(m, d.where(F.col("split") == "test")).join(known, "predicted_label", "left")
    inside = F.col("confidence").between(round(1 / k, 4), 1.0)
    per = p.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_test"), F.count(F.when(F.col("known"), 1)).alias("n_known"),
        F.count(F.when(inside, 1)).alias("n_inside"), F.count(F.when(F.col("predicted_label") == F.col("label"), 1)).alias("n_right"))
    train = d.where(F.col("split") == "train").groupBy("label").agg(F.count(F.lit(1)).alias("n_train"))
    weights = model.importances(spark, m, len(FEATURE_NAMES)).agg(F.sum("importance")).first()[0]     # of 39 rows
    every = Window.partitionBy()  # one row per class
    return train.join(per, "label", "left").select(
        "label", "n_train", "n_test", "n_known", "n_inside", F.lit(round(weights, 6)).alias("importance_sum"),
        (F.sum("n_right").over(every) > F.max("n_test").over(every)).alias("beats_largest_class"))


def model_cv(spark, sf_dir):
    d = _data(spark, sf_dir)
    folds = ev.stratified_folds(d.drop("split"), "split_key", ["doc_id"])
    return ev.cv_accuracy(model.cross_validate(folds))


def model_out_of_scope(spark, sf_dir):
    """A forest trained on the flat classes scores the sort renderings,
    whose labels it has never seen (left anti join on the known labels)."""
    d = _data(spark, sf_dir)
    flat = d.where(~F.col("label").contains("Sort"))
    m = model.fit(flat)
    known = flat.select("label").distinct()
    unseen = d.join(F.broadcast(known), "label", "left_anti")      # the classes that the model lists
    p = model.predict(m, unseen)
    return p.select("doc_id", F.col("label").alias("true_label"), F.col("predicted_label").alias("pred"),
                    "confidence")


def score_corpus(spark, sf_dir):
    """H1 + H2 over every X6 rendering; every 13th is emptied and every 17th
    cut in half, so empty and unparsable requests become status rows."""
    from snipflow.operators.scoring import analyse
    d = _data(spark, sf_dir)
    m = model.fit(d.where(F.col("split") == "train"))
    c = fx.x6_corpus(spark, sf_dir)
    code = (F.when(F.col("doc_id") % 13 == 0, F.lit(""))
            .when(F.col("doc_id") % 17 == 0, F.expr("substring(code, 1, length(code) div 2)"))
            .otherwise(F.col("code")))
    subs = c.select(F.col("doc_id").cast("string").alias("sub_id"), code.alias("code"))
    r = analyse(subs, m)
    return r.select("sub_id", "status", "detail", "algorithm", "confidence",
                    F.col("complexity.time_complexity").alias("time_complexity"),
                    F.col("complexity.space_complexity").alias("space_complexity"))


def model_bundle(spark, sf_dir):
    """A5: the saved bundle, loaded again, on raw code against the scoring job: how many
    snippets get the same class and confidence from both."""
    from snipflow.operators import bundle
    from snipflow.operators.scoring import analyse
    from snipflow.session import Scratch
    c = materialize(fx.x6_corpus(spark, sf_dir).select("doc_id", "code", "label"), "x6_corpus")
    path = f"{Scratch(spark, 'bundle').root}/model"
    bundle.train(c, path, SPLIT_KEY, ["doc_id"], num_trees=20)
    saved = model.load(path)
    plain = analyse(c, type(saved)(stages=saved.stages[1:-1]), "doc_id").select("doc_id", "algorithm", F.col("confidence").alias("sure"))
    both = bundle.score(saved, c.select("doc_id", "code")).join(plain, "doc_id")
    same = (F.col("predicted_label") == F.col("algorithm")) & (F.col("confidence") == F.col("sure"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(same, 1)).alias("n_same"))


def stream_scoring(spark, sf_dir):
    """H3: the scoring stream over files of submissions, stopped after some and started
    again, against the batch job: how many submissions have the same row in both."""
    from snipflow.operators.scoring import analyse
    from snipflow.session import Scratch
    from snipflow.sources.io import read_submissions
    from snipflow.streaming import score_stream
    scratch = Scratch(spark, "score-stream")
    c = fx.x6_corpus(spark, sf_dir).select(F.col("doc_id").cast("string").alias("sub_id"), "code", "label")
    broken = F.when(F.col("sub_id") % 13 == 0, F.lit(" ")).when(F.col("sub_id") % 17 == 0, F.concat(F.lit("def (\n"), F.col("code")))
    subs = scratch.save(c.select("sub_id", F.coalesce(broken, "code").alias("code"), F.lit(None).cast("string").alias("entry_call"),
                                 F.pmod(F.xxhash64("sub_id"), F.lit(3)).alias("part")), "subs", by=("part",))
    good, _ = features.build_features(c)
    fitted = model.fit(materialize(good.select("label", *FEATURE_NAMES), "train_rows"), num_trees=20)
    inbox, files = f"{scratch.root}/inbox", 0
    for part in range(3):                      # the second start finds two parts more
        subs.where(F.col("part") == part).drop("part").write.mode("append").json(inbox)
        files = files or len(read_submissions(spark, inbox).inputFiles())
        if part != 1:
            score_stream.start(spark, inbox, f"{scratch.root}/out", f"{scratch.root}/checkpoint", fitted,
                               max_files=max(1, files)).awaitTermination()
    columns = ["status", "detail", "algorithm", "confidence", "complexity", "features"]
    one = spark.read.parquet(f"{scratch.root}/out").select("sub_id", F.struct(*columns).alias("one"))
    two = analyse(subs, fitted).withColumn("complexity", F.to_json("complexity")).withColumn("features", F.to_json("features"))
    both = one.join(two.select("sub_id", F.struct(*columns).alias("two")), "sub_id", "full_outer")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("one").eqNullSafe(F.col("two")), 1)).alias("n_same"),
                    F.count(F.when(F.col("one.status") == "empty", 1)).alias("n_empty"),
                    F.count(F.when(F.col("one.status") == "parse_error", 1)).alias("n_parse_error"))


def template_leakage(spark, sf_dir):
    """Templates whose renderings fall on both sides of the split."""
    from snipflow.operators.corpus import template_leakage as leak
    return leak(_data(spark, sf_dir))


def oracle():
    # every rendering parses, so the split is over all documents
    leakage = f"""
WITH r AS (SELECT doc_id, template_idx, label, {SPLIT_KEY} AS k FROM ({_render_sql()}) c),
s AS (SELECT template_idx, row_number() OVER (PARTITION BY label ORDER BY k, doc_id) <= ceil(0.2 * count(*) OVER (PARTITION BY label)) AS test FROM r)
SELECT template_idx, count(DISTINCT test) AS n_sides, count(*) AS n FROM s GROUP BY template_idx HAVING count(DISTINCT test) > 1"""
    # the others: properties that hold for any forest
    properties = f"""
WITH n AS (SELECT label, count(*) AS n FROM ({_render_sql()}) c GROUP BY label)
SELECT label, n - CAST(ceil(0.2 * n) AS BIGINT) AS n_train, CAST(ceil(0.2 * n) AS BIGINT) AS n_test,
  CAST(ceil(0.2 * n) AS BIGINT) AS n_known, CAST(ceil(0.2 * n) AS BIGINT) AS n_inside,
  CAST(1 AS DOUBLE) AS importance_sum, true AS beats_largest_class FROM n"""
    return {"template_leakage": leakage,
            "model_properties": properties,
            "model_bundle": "SELECT count(*) AS n, count(*) AS n_same FROM documents",
            "stream_scoring": """SELECT count(*) AS n, count(*) AS n_same, count(*) FILTER (WHERE doc_id % 13 = 0) AS n_empty,
  count(*) FILTER (WHERE doc_id % 13 <> 0 AND doc_id % 17 = 0) AS n_parse_error FROM documents"""}


def queries():
    return {
        "model_predictions": model_predictions,
        "model_report": model_report,
        "model_confusion": model_confusion,
        "model_importances": model_importances,
        "model_properties": model_properties,
        "model_cv": model_cv,
        "model_bundle": model_bundle,
        "stream_scoring": stream_scoring,
        "model_out_of_scope": model_out_of_scope,
        "score_corpus": score_corpus,
        "template_leakage": template_leakage,
    }
