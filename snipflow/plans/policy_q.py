"""Registered queries on X3 synthetic trees (ancestor logic of F1-F4, F17-F19;
screening V1, V2, V4, V5) and on rendered code (V3-V8 screening)."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipflow.operators import features, policy
from snipflow.sources import fixtures as fx
from snipflow.sources.tables import table


def tree_features(spark, sf_dir):
    from snipflow.session import materialize
    return features.subtree_features(materialize(fx.x3_nodes(spark, sf_dir), "x3_nodes"))


def tree_violations(spark, sf_dir):
    return policy.first_violation(fx.x3_nodes(spark, sf_dir)).select(
        "sample_id", "violation", "n_violations")


def run_screening(spark, sf_dir):
    """V5-V8 on X6 renderings run with a sample call taken from the doc id: some calls are
    blank, some use blocked names, some do not parse. Renderings with an even doc id hold
    their document's text in a function, so that they are definitions only."""
    c = fx.x6_corpus(spark, sf_dir)
    # the last line of a rendering is its document's text, a string constant
    constant = F.expr("substring_index(substring(code, 1, length(code) - 1), '\\n', -1)")
    inside = F.concat(F.expr("substring(code, 1, length(code) - 1 - length(constant))"),
                      F.lit("def note():\n    "), F.col("constant"), F.lit("\n"))
    c = c.withColumn("constant", constant).withColumn("code", F.when(F.col("doc_id") % 2 == 0, inside).otherwise(F.col("code")))
    entry = (F.when(F.col("doc_id") % 7 == 0, F.lit(""))
             .when(F.col("doc_id") % 7 == 1, F.lit("print(open('x'))"))
             .when(F.col("doc_id") % 7 == 2, F.lit("print(("))
             .otherwise(F.concat(F.lit("print(len("), F.col("doc_id").cast("string"), F.lit("))"))))
    runs = c.select(F.col("doc_id").alias("run_id"), "code", entry.alias("entry_call"))
    s = policy.screen(runs)
    return s.select("run_id", "screen_status", "screen_message", F.length("run_text").alias("run_len"))


def _screening_sql() -> str:
    """A rendering's lines tell what it imports and whether it holds definitions only;
    no template uses a blocked name."""
    from snipflow.plans.corpus_q import _render_sql
    return f"""
WITH c AS ({_render_sql()}),
l AS (SELECT doc_id, code, list_filter(string_split(code, chr(10)), lambda x: length(x) > 0) AS lines FROM c),
b AS (SELECT doc_id, code, lines[1:len(lines) - 1] AS body FROM l),
m AS (SELECT doc_id,
        list_filter(list_transform(list_filter(body, lambda x: regexp_matches(x, '^ *(import|from) ')),
                                   lambda x: regexp_extract(x, '^ *(import|from) +([A-Za-z0-9_]+)', 2)),
                    lambda x: x NOT IN ('collections', 'heapq')) AS banned,
        doc_id % 2 = 0 AND len(list_filter(body, lambda x: NOT regexp_matches(x, '^([ \\t]|#|def |class |import |from )'))) = 0 AS only_defs,
        CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'print(open(''x''))' WHEN 2 THEN 'print(('
             ELSE 'print(len(' || doc_id || '))' END AS entry,
        length(code) + CASE WHEN doc_id % 2 = 0 THEN length('def note():' || chr(10) || '    ') ELSE 0 END AS n
      FROM b)
SELECT doc_id AS run_id,
  CASE WHEN len(banned) > 0 OR doc_id % 7 = 1 THEN 'policy_error' WHEN doc_id % 7 = 2 THEN 'syntax_error'
       WHEN doc_id % 7 = 0 AND only_defs THEN 'policy_error' ELSE 'ok' END AS screen_status,
  CASE WHEN len(banned) > 0
       THEN concat('Import of ''', banned[1], ''' is not allowed. Only collections and heapq are available.')
       WHEN doc_id % 7 = 1 THEN 'Use of restricted name ''open'' is not allowed.'
       WHEN doc_id % 7 = 2 THEN 'Syntax error on line 1: ''('' was never closed'
       WHEN doc_id % 7 = 0 AND only_defs
       THEN 'No executable sample call found. Add a call at the bottom, e.g. print(binary_search([1, 2, 3], 2)).'
  END AS screen_message,
  CAST(n + CASE WHEN entry = '' THEN 0 ELSE 2 + length(entry) END AS INT) AS run_len
FROM m"""


def _anc_sql() -> str:
    return f"""
WITH RECURSIVE nodes AS ({fx.x3_sql()}),
anc(sample_id, node_id, anc_id) AS (
  SELECT sample_id, node_id, parent_id FROM nodes WHERE parent_id IS NOT NULL
  UNION ALL
  SELECT a.sample_id, a.node_id, p.parent_id FROM anc a
  JOIN nodes p ON p.sample_id = a.sample_id AND p.node_id = a.anc_id
  WHERE p.parent_id IS NOT NULL
),
ak AS (SELECT a.*, x.kind AS kind, y.kind AS anc_kind, y.name AS anc_name, y.depth AS anc_depth
       FROM anc a JOIN nodes x ON x.sample_id = a.sample_id AND x.node_id = a.node_id
       JOIN nodes y ON y.sample_id = a.sample_id AND y.node_id = a.anc_id)"""


def oracle():
    return {
        "tree_features": _anc_sql() + """,
loops AS (SELECT n.sample_id, n.node_id,
                 1 + (SELECT count(*) FROM ak WHERE ak.sample_id = n.sample_id AND ak.node_id = n.node_id
                      AND ak.anc_kind IN ('For', 'While')) AS d
          FROM nodes n WHERE n.kind IN ('For', 'While')),
nf AS (SELECT sample_id, node_id, arg_max(anc_name, anc_depth) AS fn FROM ak
       WHERE kind = 'Call' AND anc_kind = 'FunctionDef' GROUP BY sample_id, node_id),
rc AS (SELECT n.sample_id, nf.fn, count(*) AS c FROM nodes n JOIN nf USING (sample_id, node_id)
       WHERE n.name = nf.fn GROUP BY n.sample_id, nf.fn),
lp AS (SELECT sample_id, node_id, min(anc_depth) AS first_loop FROM ak
       WHERE kind = 'If' AND anc_kind IN ('For', 'While') GROUP BY sample_id, node_id),
nest AS (SELECT lp.sample_id, lp.node_id,
                1 + (SELECT count(*) FROM ak WHERE ak.sample_id = lp.sample_id AND ak.node_id = lp.node_id
                     AND ak.anc_kind = 'If' AND ak.anc_depth > lp.first_loop) AS v FROM lp),
ret AS (SELECT DISTINCT sample_id FROM ak WHERE kind = 'Return' AND anc_kind IN ('For', 'While'))
SELECT s.sample_id,
  CAST(coalesce((SELECT max(d) FROM loops WHERE loops.sample_id = s.sample_id), 0) AS INT) AS max_loop_depth,
  CAST((SELECT count(*) FROM nodes n WHERE n.sample_id = s.sample_id AND n.kind IN ('For', 'While')) AS INT) AS num_loops,
  CAST(coalesce((SELECT max(c) FROM rc WHERE rc.sample_id = s.sample_id), 0) > 0 AS INT) AS has_recursion,
  CAST(coalesce((SELECT max(c) FROM rc WHERE rc.sample_id = s.sample_id), 0) AS INT) AS recursion_branch_count,
  CAST((SELECT count(*) FROM nodes n WHERE n.sample_id = s.sample_id AND n.kind = 'FunctionDef') AS INT) AS num_function_defs,
  CAST(coalesce((SELECT max(v) FROM nest WHERE nest.sample_id = s.sample_id), 0) AS INT) AS max_if_nesting_in_loop,
  CAST(s.sample_id IN (SELECT sample_id FROM ret) AS INT) AS has_early_return_in_loop
FROM (SELECT DISTINCT sample_id FROM nodes) s""",
        "tree_violations": f"""
WITH nodes AS ({fx.x3_sql()}),
v AS (
  SELECT sample_id, depth, node_id, 'Use of restricted name ''' || name || ''' is not allowed.' AS message
  FROM nodes WHERE kind = 'Name' AND name IN ({', '.join("'" + b + "'" for b in policy.BLOCKED_NAMES)})
  UNION ALL
  SELECT sample_id, depth, node_id, 'Access to dunder attributes is not allowed.'
  FROM nodes WHERE kind = 'Attribute' AND starts_with(name, '__')
  UNION ALL
  SELECT sample_id, depth, node_id,
         'Import of ''' || split_part(name, '.', 1) || ''' is not allowed. Only collections and heapq are available.'
  FROM nodes WHERE kind IN ('Import', 'ImportFrom') AND split_part(name, '.', 1) NOT IN ('collections', 'heapq'))
SELECT sample_id, arg_min(message, (depth, node_id)) AS violation, count(*) AS n_violations
FROM v GROUP BY sample_id""",
        "run_screening": _screening_sql(),
    }


def queries():
    return {
        "tree_features": tree_features,
        "tree_violations": tree_violations,
        "run_screening": run_screening,
    }
