"""Registered corpus queries (G1-G13) on X6 renderings driven by `documents`,
plus G6/G7 over the document texts themselves."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from snipflow.functions.text import PY_WS, py_lstrip, py_strip, sql_py_strip
from snipflow.operators import corpus
from snipflow.sources import fixtures as fx
from snipflow.sources import templates as tp
from snipflow.sources.tables import table


def corpus_render(spark, sf_dir):
    return fx.x6_corpus(spark, sf_dir).select("doc_id", "template_idx", "variant", "label", "code")


def corpus_report(spark, sf_dir):
    return corpus.generation_report(fx.x6_corpus(spark, sf_dir))


def corpus_duplicates(spark, sf_dir):
    """The renderings and the document texts themselves (which hold exact copies)."""
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("code"), F.col("lang").alias("label"))
    return corpus.duplicate_report(fx.x6_corpus(spark, sf_dir).select("code", "label").unionByName(docs))


def doc_normalize(spark, sf_dir):
    """G7 on real texts, and G6 after marking every third line as a comment."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.split(F.col("text"), "\n", -1)
    marked = F.transform(lines, lambda ln, i: F.when(i % 3 == 2, F.concat(F.lit("# "), ln)).otherwise(ln))
    kept = F.array_join(F.filter(marked, lambda ln: ~py_lstrip(ln).startswith("#")), "\n")
    return d.select("doc_id",
                    F.concat(py_strip(F.col("text")), F.lit("\n")).alias("normalized"),
                    F.concat(py_strip(kept), F.lit("\n")).alias("uncommented"))


GROUP_KEY = "(template_idx * 48271 + 11) % 2147483647"


def corpus_group_split(spark, sf_dir):
    """Group-aware split of the X6 renderings: templates, not rows, are split."""
    from snipflow.operators.evaluation import group_split
    c = fx.x6_corpus(spark, sf_dir).select("doc_id", "template_idx", "label") \
        .withColumn("gkey", F.expr(GROUP_KEY))
    s = group_split(c, "template_idx", "gkey")
    return s.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n_rows"),
                                           F.count_distinct("template_idx").alias("n_templates"))


def corpus_group_split_rows(spark, sf_dir):
    """Whole templates on one side, rows nearest to a fifth; uneven templates by leaving out documents of few words."""
    from snipflow.operators.evaluation import group_split_by_rows
    d = table(spark, sf_dir, "documents").select("doc_id", (F.length(F.coalesce("text", F.lit(""))) > 400).alias("long"))
    c = fx.x6_corpus(spark, sf_dir).select("doc_id", "template_idx", "label").join(d, "doc_id")
    c = c.where(F.col("long") | (F.col("template_idx") % 3 == 0))
    return (group_split_by_rows(c, "template_idx").groupBy("label", "template_idx", "split").agg(F.count(F.lit(1)).alias("n_rows")))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _render_sql() -> str:
    n = len(tp.TEMPLATES)
    trows = ", ".join(f"({i}, {_q(k)}, {_q(lab)}, {_q(b)})" for i, (k, lab, _, b) in enumerate(tp.TEMPLATES))
    toks = list(tp.ROLE_NAMES)
    srows = ", ".join("(" + ", ".join([str(s)] + [_q(tp.ROLE_NAMES[t][s]) for t in toks]) + ")"
                      for s in range(tp.STYLES))
    scols = ", ".join(["style_id"] + [f"tok_{t}" for t in toks])
    frows = ", ".join(f"({_q(k)}, {p}, {_q(nm)})" for k, names in tp.FUNC_NAMES.items()
                      for p, nm in enumerate(names))
    expr = "replace(body, '__FUNC__', func_name)"
    for t in toks:
        expr = f"replace({expr}, '__{t}__', tok_{t})"
    # placeholders left after the role tokens, found in the library text
    residual = sorted({m for _, _, _, b in tp.TEMPLATES for m in re.findall(r"__([A-Z0-9_]+)__", b)}
                      - set(toks) - {"FUNC"})
    for r in residual:
        expr = f"replace({expr}, '__{r}__', '{r.lower()}')"
    uncommented = (f"array_to_string(list_filter(string_split(c, chr(10)), "
                   f"lambda l: NOT starts_with(regexp_replace(l, '^{PY_WS}+', ''), '#')), chr(10))")
    return f"""
WITH t(template_idx, func_key, label, body) AS (VALUES {trows}),
s({scols}) AS (VALUES {srows}),
fn(func_key, func_pos, func_name) AS (VALUES {frows}),
d AS (SELECT doc_id, CAST(doc_id % {n} AS INT) AS template_idx,
             CAST((doc_id // {n}) % 5 AS INT) AS variant,
             CAST(to_json(coalesce(text, '')) AS VARCHAR) || chr(10) AS tail FROM documents),
j AS (SELECT d.*, t.func_key, t.label, t.body, s.*, fn.func_name FROM d
      JOIN t USING (template_idx)
      JOIN s ON s.style_id = (d.variant + d.template_idx) % 5
      JOIN fn ON fn.func_key = t.func_key AND fn.func_pos = (d.variant + d.template_idx) % 4),
r AS (SELECT doc_id, template_idx, variant, label, tail, {expr} AS c FROM j),
x AS (SELECT doc_id, template_idx, variant, label, tail,
             CASE WHEN variant % 2 = 0 THEN c ELSE {uncommented} END AS c2 FROM r)
SELECT doc_id, template_idx, variant, label, {sql_py_strip('c2')} || chr(10) || tail AS code FROM x"""


def oracle():
    rs = _render_sql()
    uncommented = (f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), "
                   f"lambda l, i: CASE WHEN i % 3 = 0 THEN '# ' || l ELSE l END), "
                   f"lambda l: NOT starts_with(regexp_replace(l, '^{PY_WS}+', ''), '#')), chr(10))")
    return {
        "corpus_render": rs,
        "corpus_report": f"""SELECT coalesce(label, 'TOTAL') AS label, count(*) AS n
FROM ({rs}) c GROUP BY ROLLUP (label)""",
        "corpus_duplicates": f"""SELECT sha256(code) AS code_sha256, count(*) AS n, count(DISTINCT label) AS n_labels
FROM (SELECT code, label FROM ({rs}) r UNION ALL SELECT text, lang FROM documents) c GROUP BY 1 HAVING count(*) > 1""",
        "corpus_group_split": f"""
WITH c AS (SELECT doc_id, template_idx, label, {GROUP_KEY} AS gkey FROM ({rs}) r),
g AS (SELECT DISTINCT label, template_idx, gkey FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gkey, template_idx) AS rk,
             count(*) OVER (PARTITION BY label) AS gn FROM g),
s AS (SELECT label, template_idx, CASE WHEN rk <= ceil(0.2 * gn) THEN 'test' ELSE 'train' END AS split FROM r)
SELECT label, split, count(*) AS n_rows, count(DISTINCT template_idx) AS n_templates
FROM c JOIN s USING (label, template_idx) GROUP BY label, split""",
        "corpus_group_split_rows": f"""
WITH RECURSIVE
c AS (SELECT label, template_idx, count(*) AS n FROM ({rs}) r JOIN documents USING (doc_id)
      WHERE length(coalesce(text, '')) > 400 OR template_idx % 3 = 0 GROUP BY label, template_idx),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY template_idx) AS k, count(*) OVER (PARTITION BY label) AS m,
             sum(n) OVER (PARTITION BY label) AS total FROM c),
pick(label, k, mask, s) AS (
  SELECT DISTINCT label, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM o
  UNION ALL
  SELECT p.label, o.k, p.mask * 2 + t.b, CAST(p.s + t.b * o.n AS BIGINT)
  FROM pick p JOIN o ON o.label = p.label AND o.k = p.k + 1, (VALUES (0), (1)) t(b)),
best AS (SELECT DISTINCT ON (p.label) p.label, mask, o.m FROM pick p JOIN o ON o.label = p.label AND o.k = p.k AND o.k = o.m
         WHERE o.m < 2 OR (s > 0 AND s < total) ORDER BY p.label, abs(5 * s - total), s, mask DESC)
SELECT o.label, template_idx, CASE WHEN (mask >> CAST(o.m - o.k AS INT)) & 1 = 1 THEN 'test' ELSE 'train' END AS split, n AS n_rows
FROM o JOIN best USING (label)""",
        "doc_normalize": f"""SELECT doc_id, {sql_py_strip('text')} || chr(10) AS normalized,
  {sql_py_strip(uncommented)} || chr(10) AS uncommented FROM documents""",
    }


def queries():
    return {
        "corpus_render": corpus_render,
        "corpus_report": corpus_report,
        "corpus_duplicates": corpus_duplicates,
        "doc_normalize": doc_normalize,
        "corpus_group_split": corpus_group_split,
        "corpus_group_split_rows": corpus_group_split_rows,
    }
