"""JSON records of any layout (A1, P3): splits, order, damage, against Python's json."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from snipflow.sources import io
from snipflow.sources.records import read_records

SCHEMA = "code string, label string, n int"


def records(n, seed):
    r = random.Random(seed)
    bits = ["}", "{", '"', "\\", "\n", "]", "[", ",", "é", "x = {'a': [1, 2]}\n", '"""', "\\n", "} ,{", "# c\r\n", "\t", "}}", " "]
    return [{"code": "".join(r.choice(bits) for _ in range(r.randrange(0, 30))), "label": r.choice(["a", 'b"}', None]), "n": i} for i in range(n)]


LAYOUTS = {
    "array": json.dumps,
    "printed": lambda x: json.dumps(x, indent=2),
    "lines": lambda x: "\n".join(map(json.dumps, x)) + "\n",
    "objects": lambda x: "\r\n".join(json.dumps(y, indent=1, ensure_ascii=False) for y in x),
    "packed": lambda x: "[" + ",".join(json.dumps(y, separators=(",", ":")) for y in x) + "]",
    "bom": lambda x: "﻿" + json.dumps(x),
}


@pytest.mark.parametrize("split", [64 << 20, 300])
def test_every_layout_in_file_order(spark, tmp_path, split):
    want = []
    for k, name in enumerate(sorted(LAYOUTS)):
        rows = records(60, k)
        (tmp_path / f"{k}{name}.json").write_text(LAYOUTS[name](rows), encoding="utf-8")
        want += [(x["code"], x["label"], x["n"]) for x in rows]
    (tmp_path / "8empty.json").write_text("")
    (tmp_path / "9none.json").write_text("[]\n")
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = read_records(spark, str(tmp_path), SCHEMA).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)
    assert [(r["code"], r["label"], r["n"]) for r in got] == want
    assert [r["row_id"] for r in got] == list(range(len(want)))
    assert all(r["corrupt_record"] is None for r in got)


def test_one_array_is_read_in_many_splits(spark, tmp_path):
    rows = records(400, 1)
    (tmp_path / "a.json").write_text(json.dumps(rows))
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        text = spark.read.option("lineSep", "}").text(str(tmp_path))
        assert text.rdd.getNumPartitions() >= 8
        assert [r["n"] for r in read_records(spark, str(tmp_path), SCHEMA).orderBy("row_id").collect()] == list(range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)


def test_damage_stays_on_its_line(spark, tmp_path):
    lines = ['{"code": "a", "n": 1}', '{"code": "b, "n": 2}', '{"code": "c", "n": 3}', '{"code": "open', '{"code": "d", "n": 4}', '{"code": "tail']
    (tmp_path / "x.json").write_text("\n".join(lines))
    got = read_records(spark, str(tmp_path), SCHEMA).orderBy("row_id").collect()
    assert [r["n"] for r in got if r["corrupt_record"] is None] in ([1, 3, 4], [1, 3])
    assert all(any(x in (r["corrupt_record"] or "") for r in got) for x in ('"b, "n"', '"open', '"tail'))
    assert [r["row_id"] for r in got] == list(range(len(got)))


def test_read_corpus_fails_on_damage_or_keeps_it(spark, tmp_path):
    path = os.path.join(str(tmp_path), "c.json")
    with open(path, "w") as f:
        f.write('[{"code": "x = 1", "label": "A", "_variant": 3, "_source_template_idx": 7, "_original_algorithm": "o"},\n{"code": "y, "label": "B"}]')
    with pytest.raises(Exception, match="does not parse"):
        io.read_corpus(spark, path).collect()
    kept = io.read_corpus(spark, path, debug=True, keep_bad=True).orderBy("row_id").collect()
    assert kept[0]["variant"] == 3 and kept[0]["source_template_idx"] == 7 and kept[0]["original_algorithm"] == "o"
    assert kept[1]["corrupt_record"].startswith('{"code": "y') and kept[1]["code"] is None


def test_features_keep_the_row_numbers(spark, tmp_path):
    from snipflow.operators import features
    rows = [{"code": f"x = {i}\n" if i % 5 else "def (", "label": "A"} for i in range(30)]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    corpus = io.read_corpus(spark, str(tmp_path), keep_bad=True)
    good, bad = features.build_features(corpus)
    assert sorted(r["row_id"] for r in bad.select("row_id").collect()) == [0, 5, 10, 15, 20, 25]
    assert {r["row_id"]: r["code"] for r in good.select("row_id", "code").collect()} == {i: x["code"] for i, x in enumerate(rows) if i % 5}
    assert good.where(F.col("corrupt_record").isNotNull()).count() == 0
