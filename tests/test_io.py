import json
import os

import pytest
from pyspark.sql import functions as F

from snipflow.schemas import FEATURE_NAMES
from snipflow.sources import io


def test_features_csv_roundtrip(spark, tmp_path):
    row = tuple(float(i) for i in range(39)) + ('odd "label", with comma\nand newline',)
    df = spark.createDataFrame([row], io.FEATURES_SCHEMA)
    path = os.path.join(str(tmp_path), "features")
    io.write_features(df, path)
    back, x = io.read_features(spark, path)
    assert back.collect() == df.collect()
    assert x.columns == FEATURE_NAMES


def test_refuse_empty(spark, tmp_path):
    df = spark.createDataFrame([], io.FEATURES_SCHEMA)
    with pytest.raises(ValueError):
        io.write_features(df, os.path.join(str(tmp_path), "f"))


def test_read_corpus_fallback(spark, tmp_path):
    legacy = os.path.join(str(tmp_path), "legacy.json")
    with open(legacy, "w") as f:
        json.dump([{"code": "x = 1\n", "label": "A"}, {"code": "y = 2\n", "label": "B"}], f, indent=2)
    df = io.read_corpus(spark, os.path.join(str(tmp_path), "missing.json"), legacy)
    assert sorted(r["label"] for r in df.collect()) == ["A", "B"]
    with pytest.raises(FileNotFoundError):
        io.read_corpus(spark, os.path.join(str(tmp_path), "nope.json"))


def test_write_corpus(spark, tmp_path):
    from snipflow.operators import corpus
    g = corpus.generate(spark)
    io.write_corpus(g, str(tmp_path))
    clean = spark.read.json(os.path.join(str(tmp_path), "dataset"))
    assert sorted(clean.columns) == ["code", "label"] and clean.count() == g.count()
    dbg = spark.read.json(os.path.join(str(tmp_path), "dataset_debug"))
    assert dbg.where(F.col("original_algorithm").isNotNull()).count() == 105


def test_steps_and_submissions_roundtrip(spark, tmp_path):
    from conftest import SF001
    from snipflow.operators import trace
    from snipflow.sources import fixtures as fx
    steps = fx.x1_steps(spark, SF001).withColumn("line_number", F.col("line_number").cast("int")) \
        .withColumn("locals", F.lit(None).cast(
            "array<struct<name:string,kind:string,items:array<string>,repr:string>>")) \
        .select("run_id", "seq", "event", "func_name", "line_number", "locals", "output", "ts")
    path = os.path.join(str(tmp_path), "steps")
    io.write_steps(steps, path)
    back = io.read_steps(spark, path)
    a = trace.traced_steps(steps, 50).select("run_id", "seq", "call_depth")
    b = trace.traced_steps(back, 50).select("run_id", "seq", "call_depth")
    assert a.exceptAll(b).count() == 0 and b.count() == a.count()
    subs = os.path.join(str(tmp_path), "subs")
    spark.createDataFrame([("a", "x = 1\n", None)], io.SUBMISSION_SCHEMA).write.json(subs)
    assert io.read_submissions(spark, subs).collect()[0]["code"] == "x = 1\n"


def test_corpus_written_in_parts_is_read_back_whole(spark, scratch):
    from snipflow.sources.io import read_corpus, write_corpus
    df = spark.createDataFrame([(f"x = {i}\n", "c") for i in range(50)], "code string, label string").repartition(4)
    write_corpus(df, scratch)
    back = read_corpus(spark, f"{scratch}/dataset")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_rejects_are_written_and_fail_the_job(spark, scratch):
    rows = [(f"x = {i}\n" if i % 4 else "def (", "A") for i in range(20)]
    df = spark.createDataFrame(rows, "code string, label string").repartition(3)
    with pytest.raises(ValueError, match="5 of 20 snippets do not parse"):
        io.write_validated(df, f"{scratch}/c")
    assert spark.read.json(f"{scratch}/c/rejected=true").where("parse_error IS NOT NULL").count() == 5
    assert io.write_validated(df.where("code LIKE 'x%'"), f"{scratch}/d") == 15
    assert spark.read.json(f"{scratch}/d").count() == 15
