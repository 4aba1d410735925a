"""Nested locals (T5, T6) against the recursive rule on Python values."""

import json
import math
import random

from pyspark.sql import functions as F

from snipflow.operators import nested

LIMIT, KEEP, DEPTH = 1000, 50, 3


class Other:
    def __repr__(self):
        return "<other thing>"


def cut(s):
    return s if len(s) <= LIMIT else s[:LIMIT] + "... (truncated)"


def bounded(v, depth=0):
    if depth > DEPTH or not isinstance(v, (type(None), bool, int, float, str, list, tuple, set, dict)):
        return cut(repr(v))
    if isinstance(v, str):
        return cut(v)
    if v is None or isinstance(v, (bool, int, float)):
        return v
    if len(repr(v)) > LIMIT:
        return cut(repr(v))
    if isinstance(v, dict):
        return {str(bounded(k, depth + 1)): bounded(x, depth + 1) for k, x in list(v.items())[:KEEP]}
    return [bounded(x, depth + 1) for x in list(v)[:KEEP]]


def tagged(v):
    if v is None or isinstance(v, (bool, str)) or type(v) is int:
        return v
    if isinstance(v, dict):
        return {"kind": "dict", "items": [[tagged(k), tagged(x)] for k, x in v.items()]}
    if isinstance(v, (list, tuple, set)):
        return {"kind": type(v).__name__, "items": [tagged(x) for x in v]}
    return {"kind": type(v).__name__.lower(), "repr": repr(v)}


def value(r, depth):
    pick = r.randrange(12)
    if depth == 0 or pick < 5:
        return r.choice([None, True, False, 7, -3, 2.5, "it's", 'say "hi"', "back\\slash", "é ü", "", "x" * r.randrange(0, 1300), Other()])
    n = r.choice([0, 1, 2, 3, 7, 60, 600]) if depth < 3 else r.choice([0, 1, 2])
    items = [value(r, depth - 1) for _ in range(n)]
    if pick < 7:
        return items
    if pick < 9:
        return tuple(items)
    hashable = [x if isinstance(x, (str, int, float, type(None))) else (1, str(i)) for i, x in enumerate(items)]
    return set(hashable) if pick < 10 else dict(zip([*hashable, 1, "1"], [*items, "a", "b"]))


def test_bounded_values_follow_the_recursive_rule(spark):
    r = random.Random(11)
    values = [value(r, d) for d in (0, 1, 2, 3, 4, 6) for _ in range(25)]
    values += [[[[[["deep"]]]]], {"a": {"b": {"c": {"d": {"e": 1}}}}}, {1: "x", "1": "y", 2: "z"}, {(1, ("k",)): [None]}, list(range(10_000)),
               ["w" * 990, "v"], {"k": "w" * 995}, ("one",), set(), [1e20, -0.5]]
    rows = [(i, [("__builtins__", "1"), ("v", json.dumps(tagged(v))), ("collections", json.dumps({"kind": "module", "repr": "<m>"})),
                 ("heapq", "[]" if False else '"mine"')]) for i, v in enumerate(values)]
    steps = spark.createDataFrame(rows, "seq int, l array<struct<name string, v string>>").repartition(4)
    steps = steps.withColumn("locals", F.transform("l", lambda x: F.struct(x["name"].alias("name"), F.parse_json(x["v"]).alias("value"))))
    got = nested.safe_locals(steps, ["seq"])
    assert dict(got.dtypes)["value"] == "variant"
    by = {(x["seq"], x["name"]): x["text"] for x in got.drop("value").collect()}
    assert set(by) == {(i, n) for i in range(len(values)) for n in ("v", "heapq")}
    for i, v in enumerate(values):
        want = bounded(v)
        seen = json.loads(by[i, "v"], object_pairs_hook=list if isinstance(want, dict) and False else dict)
        assert seen == want or (isinstance(want, float) and math.isclose(seen, want)), (v, by[i, "v"])
        if isinstance(want, dict):                               # entries stay in order
            assert [k for k, _ in json.loads(by[i, "v"], object_pairs_hook=lambda p: p)] == list(want)


def test_no_steps(spark):
    empty = spark.createDataFrame([], "seq int").withColumn("locals", F.array().cast("array<struct<name:string,value:variant>>"))
    assert nested.safe_locals(empty, ["seq"]).count() == 0


def test_levels_meet_without_a_join(spark):
    """Nothing that grows with the steps can be broadcast through the driver."""
    import contextlib
    import io

    from snipflow.operators import nested
    rows = [(1, '{"kind":"list","items":["a",{"kind":"dict","items":[["k",1]]}]}')]
    steps = spark.createDataFrame(rows, "id long, j string").selectExpr("id", "array(named_struct('name', 'x', 'value', parse_json(j))) AS locals")
    out = nested.safe_locals(steps, ["id"])
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain()
    assert [tuple(r) for r in out.select("id", "pos", "name", "text").collect()] == [(1, 0, "x", '["a", {"k": 1}]')]
    assert "Join" not in text.getvalue() and "Broadcast" not in text.getvalue()


def test_values_are_built_once(spark, monkeypatch):
    """Exploding the locals adds no test of their number, for which each value would be built again."""
    seen, write = [], nested.materialize
    monkeypatch.setattr(nested, "materialize", lambda df, name: seen.append(df) or write(df, name))
    rows = [(1, '{"kind":"list","items":["a",2]}'), (2, "7")]
    steps = spark.createDataFrame(rows, "id long, j string").selectExpr("id", "array(named_struct('name', 'x', 'value', parse_json(j))) AS locals")
    out = nested.safe_locals(steps.unionAll(steps.selectExpr("id + 10 AS id", "slice(locals, 1, 0) AS locals")), ["id"])
    assert sorted((r["id"], r["text"]) for r in out.select("id", "text").collect()) == [(1, '["a", 2]'), (2, "7")]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2                     # one for each side of the union
    assert "v" not in seen[0].columns                       # a value is kept as children or text
