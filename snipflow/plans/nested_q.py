"""Registered query for nested locals (T5, T6): values built from the words of each document."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipflow.functions.text import PY_WS, json_text
from snipflow.operators import nested
from snipflow.plans.dsops_q import _repr_sql, _trunc_sql
from snipflow.sources.tables import table


def _nested_locals(spark, sf_dir):
    """Each document's words as a value of one of seven shapes, and its whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", F.filter(F.split("text", f"{PY_WS}+"), lambda x: x != ""))
    word = lambda k: F.coalesce(F.get("w", F.lit(k)), F.lit(f"none{k}"))
    text = json_text
    a, b, c, e, f = (text(word(k)) for k in range(5))
    n = F.size("w").cast("string")

    def coll(kind, *items):
        parts = [x if not isinstance(x, str) else F.lit(x) for i in items for x in (F.lit(","), i)][1:]
        return F.concat(F.lit(f'{{"kind":"{kind}","items":['), *parts, F.lit("]}"))

    def entry(k, v):
        return F.concat(F.lit("["), k if not isinstance(k, str) else F.lit(k), F.lit(","), v if not isinstance(v, str) else F.lit(v), F.lit("]"))

    every = F.concat(F.lit('{"kind":"list","items":'), F.to_json("w"), F.lit("}"))
    shape = F.pmod("doc_id", F.lit(7))
    value = (F.when(shape == 0, every)
             .when(shape == 1, coll("tuple", coll("list", a, b, c), coll("dict", entry(b, n), entry('"on"', "true"))))
             .when(shape == 2, coll("dict", entry(a, coll("list", b, coll("list", c, coll("list", e, coll("list", f, coll("tuple", a))))))))
             .when(shape == 3, coll("set", a, "null", '{"kind":"float","repr":"1.50"}'))
             .when(shape == 4, coll("tuple", coll("dict", entry(coll("tuple", a, "1"), coll("list")), entry("null", coll("set")))))
             .when(shape == 5, coll("dict", entry("1", a), entry('"1"', b), entry('"all"', every)))
             .otherwise(coll("list", coll("deque", a, b), coll("dict", entry('"f"', '{"kind":"function","repr":"<function f>"}')), n)))
    local = lambda name, json: F.struct(F.lit(name).alias("name"), F.parse_json(json).alias("value"))
    return d.select("doc_id", F.array(
        local("__name__", F.lit('"__main__"')), local("value", value), local("text", text(F.col("text"))),
        local("heapq", F.lit('{"kind":"module","repr":"<module heapq>"}'))).alias("locals"))


def trace_nested_locals(spark, sf_dir):
    out = nested.safe_locals(_nested_locals(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "pos", "name", "text")


def _sql() -> str:
    j = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
    r = {k: f"({_repr_sql(k)})" for k in "abcef"}
    full = "'[' || array_to_string(reprs, ', ') || ']'"
    bounded = lambda rep, val: f"CASE WHEN length({rep}) > 1000 THEN {j(_trunc_sql(rep))} ELSE {val} END"
    whole = bounded("all_repr", "'[' || array_to_string(list_transform(w[1:50], lambda x: CAST(to_json(x) AS VARCHAR)), ', ') || ']'")
    pair = f"'([' || {r['a']} || ', ' || {r['b']} || ', ' || {r['c']} || '], {{' || {r['b']} || ': ' || n || ', ''on'': True}})'"
    deep = (f"'{{' || {r['a']} || ': [' || {r['b']} || ', [' || {r['c']} || ', [' || {r['e']} || ', [' || {r['f']} || ', (' || {r['a']} || ',)]]]]}}'")
    below = f"'[' || {r['f']} || ', (' || {r['a']} || ',)]'"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
             list_filter(string_split_regex(coalesce(text, ''), '{PY_WS}+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT *, coalesce(w[1], 'none0') AS a, coalesce(w[2], 'none1') AS b, coalesce(w[3], 'none2') AS c,
             coalesce(w[4], 'none3') AS e, coalesce(w[5], 'none4') AS f, CAST(len(w) AS VARCHAR) AS n,
             list_transform(w, lambda x: {_repr_sql('x')}) AS reprs FROM d),
p AS (SELECT *, {full} AS all_repr, {pair} AS pair_repr, {deep} AS deep_repr, {below} AS below_repr FROM v),
q AS (SELECT *, '{{1: ' || {r['a']} || ', ''1'': ' || {r['b']} || ', ''all'': ' || all_repr || '}}' AS twice_repr FROM p)
SELECT doc_id, CAST(2 AS INT) AS pos, 'text' AS name, {j(_trunc_sql('text'))} AS text FROM q
UNION ALL
SELECT doc_id, CAST(1 AS INT), 'value', CASE doc_id % 7
  WHEN 0 THEN {whole}
  WHEN 1 THEN {bounded('pair_repr', f"'[[' || {j('a')} || ', ' || {j('b')} || ', ' || {j('c')} || '], ' || CASE WHEN b = 'on' THEN '{{{{\"on\": true}}}}' ELSE '{{{{' || {j('b')} || ': ' || n || ', \"on\": true}}}}' END || ']'").replace('{{', '{').replace('}}', '}')}
  WHEN 2 THEN {bounded('deep_repr', f"'{{' || {j('a')} || ': [' || {j('b')} || ', [' || {j('c')} || ', [' || {j(_trunc_sql(r['e']))} || ', ' || {j(_trunc_sql('below_repr'))} || ']]]}}'")}
  WHEN 3 THEN '[' || {j('a')} || ', null, 1.50]'
  WHEN 4 THEN '[{{' || {j(f"'[' || {r['a']} || ', 1]'")} || ': [], "None": []}}]'
  WHEN 5 THEN {bounded('twice_repr', f"'{{\"1\": ' || {j('b')} || ', \"all\": ' || {whole} || '}}'")}
  ELSE '[' || {j(f"'deque([' || {r['a']} || ', ' || {r['b']} || '])'")} || ', {{"f": "<function f>"}}, ' || n || ']' END
FROM q"""


def queries():
    return {"trace_nested_locals": trace_nested_locals}


def oracle():
    return {"trace_nested_locals": _sql()}
