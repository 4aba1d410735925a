from pyspark.sql import functions as F

from snipflow.operators import corpus
from snipflow.sources import templates as tp


def test_generated_corpus(spark):
    g = corpus.generate(spark)
    assert g.count() == len(tp.TEMPLATES) * 5
    rep = {r["label"]: r["n"] for r in corpus.generation_report(g).collect()}
    assert rep.pop("TOTAL") == len(tp.TEMPLATES) * 5
    assert set(rep) == set(tp.FLAT_LABELS.values()) | set(tp.SORT_LABELS)
    assert all(v == 15 for v in rep.values())
    codes = [r["code"] for r in g.collect()]
    assert all(c.endswith("\n") and not c.endswith("\n\n") and c == c.lstrip() for c in codes)
    assert not any("__" in c.replace("__init__", "").replace("__name__", "") for c in codes)


def test_render_rules(spark):
    body = "\n\n  # comment\n\t# tab comment\ndef __FUNC__(__ARR__):\n    return __HELPER__  # kept\n\n"
    df = spark.createDataFrame([(0, body, 1, 0), (0, body, 0, 0)],
                               "template_idx int, body string, variant int, style_id int")
    df = df.join(corpus.styles_df(spark), "style_id")
    out = df.select("variant", corpus.render(F.col("body"), F.lit(None).cast("string"),
                                             F.col("variant") % 2 == 0).alias("code")).collect()
    by = {r["variant"]: r["code"] for r in out}
    arr = tp.ROLE_NAMES["ARR"][0]
    assert by[1] == f"def func({arr}):\n    return helper  # kept\n"
    assert by[0].startswith(f"# comment\n\t# tab comment\ndef func({arr}):")


def test_duplicates(spark):
    g = corpus.generate(spark)
    d = corpus.duplicate_report(g).collect()
    assert all(r["n"] >= 2 for r in d)


def test_validate_and_failure_report(spark):
    from snipflow.operators import features
    from snipflow.operators.parse import parse_nodes
    rows = [(i, f"x{i} = {i}\n") for i in range(5)] + [(10 + i, f"def f{i}(:\n") for i in range(25)]
    df = spark.createDataFrame(rows, "row_id long, code string")
    good, bad = corpus.validate(df, parse_nodes(df))
    assert good.count() == 5 and bad.count() == 25
    _, rejects = features.build_features(df)
    rep = features.failure_report(rejects.select("row_id", "parse_error"), "row_id").collect()
    assert len(rep) == 20 and rep[0]["n_failed"] == 25 and rep[0]["n_more"] == 5
    assert sorted(r["row_id"] for r in rep) == list(range(10, 30))
