import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from snipflow.operators import evaluation as ev
from snipflow.sources import fixtures as fx


def test_group_rank_equals_window(spark):
    d = fx.x4_features(spark, SF01).withColumn("split_key", F.expr(fx.X4_SPLIT_KEY))
    mine = ev.group_rank(d, "label", "split_key", fx.X4_TIEBREAK, n_slices=16)
    w = Window.partitionBy("label").orderBy("split_key", *fx.X4_TIEBREAK)
    ref = d.withColumn("group_rank", F.row_number().over(w))
    cols = ["label", "split_key", *fx.X4_TIEBREAK, "group_rank"]
    assert mine.select(cols).exceptAll(ref.select(cols)).count() == 0


def test_split_shares(spark):
    d = fx.x4_features(spark, SF01).withColumn("split_key", F.expr(fx.X4_SPLIT_KEY))
    s = ev.stratified_split(d, "split_key", fx.X4_TIEBREAK)
    for r in s.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                    F.count(F.when(F.col("split") == "test", 1)).alias("t")).collect():
        assert r["t"] == math.ceil(0.2 * r["n"])
    f = ev.stratified_folds(d, "split_key", fx.X4_TIEBREAK)
    sizes = f.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in sizes)


def test_report_zero_division_and_confusion(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", "z")]
    p = spark.createDataFrame(rows, "y string, pred string")
    rep = {r["class"]: r for r in ev.classification_report(p).collect()}
    assert rep["c"]["recall"] == 0.0 and rep["c"]["precision"] == 0.0
    assert rep["z"]["support"] == 0 and rep["z"]["precision"] == 0.0
    assert rep["accuracy"]["f1_score"] == 0.4 and rep["accuracy"]["support"] == 5
    cm = ev.confusion_long(p).collect()
    assert len(cm) == 9  # labels of y: a, b, c
    assert sum(r["n"] for r in cm) == 4  # the prediction 'z' is outside the labels


def test_cv_population_std(spark):
    rows = [(0, "a", "a"), (0, "a", "b"), (1, "a", "a"), (1, "a", "a"), (2, "a", "b"), (2, "a", "b")]
    p = spark.createDataFrame(rows, "fold int, y string, pred string")
    r = ev.cv_accuracy(p).collect()
    accs = sorted(x["accuracy"] for x in r)
    assert accs == [0.0, 0.5, 1.0]
    assert abs(r[0]["std_accuracy"] - round(math.sqrt(1 / 6), 6)) < 1e-9


def test_group_split_keeps_groups_whole(spark):
    from conftest import SF01
    from snipflow.operators.corpus import template_leakage
    c = fx.x6_corpus(spark, SF01).withColumn("gkey", F.expr("(template_idx * 48271 + 11) % 2147483647"))
    s = ev.group_split(c, "template_idx", "gkey")
    assert template_leakage(s).count() == 0
    assert s.count() == c.count()
    assert s.where("split = 'test'").select("label").distinct().count() == 17


def test_confusion_long_takes_any_label(spark):
    from snipflow.operators.evaluation import confusion_long
    df = spark.createDataFrame([("a.b", "n"), ("n", "n"), ("n", "true_label"), ("true_label", "zz")], "y string, pred string")
    got = {(r[0], r[1]): r[2] for r in confusion_long(df).collect()}
    assert len(got) == 9 and got[("a.b", "n")] == 1 and got[("n", "true_label")] == 1 and sum(got.values()) == 3


def test_nearest_groups_by_enumeration():
    import itertools
    import random
    r = random.Random(5)
    for _ in range(300):
        sizes = [r.choice([1, 2, 3, 7, 19, 20, 400]) for _ in range(r.randrange(1, 9))]
        got = ev.nearest_groups(sizes, 0.2)
        total, options = sum(sizes), []
        for mask in itertools.product([True, False], repeat=len(sizes)):
            s = sum(x for x, m in zip(sizes, mask) if m)
            if len(sizes) < 2 or 0 < s < total:
                options.append((abs(5 * s - total), s, [not m for m in mask], list(mask)))
        assert got == min(options)[3], sizes


def test_group_split_by_rows_is_near_and_whole(spark):
    rows = [("a", g) for g, n in enumerate((50, 30, 11, 9)) for _ in range(n)] + [("b", 7)] * 5 + [(None, None)] * 3
    s = ev.group_split_by_rows(spark.createDataFrame(rows, "label string, template_idx int"), "template_idx")
    got = {(r["label"], r["template_idx"], r["split"]): r["n"] for r in s.groupBy("label", "template_idx", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("a", 0, "train"): 50, ("a", 1, "train"): 30, ("a", 2, "test"): 11, ("a", 3, "test"): 9,
                   ("b", 7, "train"): 5, (None, None, "train"): 3}
