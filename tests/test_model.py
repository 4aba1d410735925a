import os

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from snipflow.operators import corpus, features, model


@pytest.fixture(scope="module")
def data(spark):
    good, _ = features.build_features(corpus.generate(spark))
    return good


def test_forest_properties(spark, data, tmp_path):
    m = model.fit(data, num_trees=20)
    p = model.predict(m, data)
    sums = p.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert sums.where(F.abs(F.col("s") - 1.0) > 1e-6).count() == 0
    acc = p.where(F.col("label") == F.col("predicted_label")).count() / p.count()
    assert acc > 0.8
    imp = model.importances(spark, m, top=39).collect()
    assert abs(sum(r["importance"] for r in imp) - 1.0) < 1e-6
    # same seed, same forest
    p2 = model.predict(model.fit(data, num_trees=20), data)
    a = p.select("code", "predicted_label", "confidence")
    assert a.exceptAll(p2.select("code", "predicted_label", "confidence")).count() == 0
    path = os.path.join(str(tmp_path), "m")
    model.save(m, path)
    p3 = model.predict(model.load(path), data).select("code", "predicted_label", "confidence")
    assert a.exceptAll(p3).count() == 0


def test_load_missing(tmp_path):
    with pytest.raises(RuntimeError, match="train first"):
        model.load(os.path.join(str(tmp_path), "nothing"))


def test_analyse_rows(spark, data):
    from snipflow.operators.scoring import analyse
    m = model.fit(data, num_trees=10)
    subs = spark.createDataFrame(
        [("a", "def f(xs):\n    for x in xs:\n        print(x)\n"), ("b", "   "), ("c", "def (:\n")],
        "sub_id string, code string")
    r = {x["sub_id"]: x for x in analyse(subs, m).collect()}
    assert r["a"]["status"] == "ok" and r["a"]["complexity"]["time_complexity"] == "O(n)"
    assert r["a"]["features"]["num_loops"] == 1.0
    assert r["b"]["status"] == "empty" and r["b"]["detail"] == "`code` field is empty."
    assert r["c"]["status"] == "parse_error" and r["c"]["detail"].startswith("Could not parse code: ")
