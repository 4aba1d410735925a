"""Registered queries for the complexity cascade (R1-R25) on X4 rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipflow.operators import rules
from snipflow.sources import fixtures

_OUT = fixtures.X4_KEYS + ["rule_id", "rule_name", "time_complexity", "space_complexity",
                           "confidence"]


def rules_cascade(spark, sf_dir):
    return rules.estimate(fixtures.x4_features(spark, sf_dir)).select(*_OUT)


def rule_coverage(spark, sf_dir):
    return rules.rule_coverage(rules.estimate(fixtures.x4_features(spark, sf_dir)))


def rule_time_classes(spark, sf_dir):
    """R25 by time class: how many rows land in each time bound."""
    est = rules.estimate(fixtures.x4_features(spark, sf_dir))
    return est.groupBy("time_complexity", "confidence").agg(F.count(F.lit(1)).alias("n_rows"))


def _sql_lit(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _dim_values() -> str:
    rows = ", ".join(f"({i}, {_sql_lit(n)}, {_sql_lit(t)}, {_sql_lit(s)}, {_sql_lit(c)})"
                     for i, n, t, s, c in rules.RULES)
    return f"(VALUES {rows}) AS dim(rule_id, rule_name, t, s, confidence)"


_CASE = """
CASE
  WHEN has_midpoint_calculation = 1 AND max_loop_depth = 1 AND has_recursion = 0 THEN 1
  WHEN has_union_find_pattern = 1 THEN 2
  WHEN has_topological_sort_pattern = 1 THEN 3
  WHEN has_fast_slow_pointer_pattern = 1 THEN 4
  WHEN has_sliding_window_pattern = 1 THEN 5
  WHEN has_monotonic_stack_pattern = 1 THEN 6
  WHEN has_backtracking_undo_pattern = 1 THEN 7
  WHEN has_recursion = 1 AND recursion_branch_count >= 2 AND has_parallel_two_pointer_pattern = 1 THEN 8
  WHEN has_recursion = 1 AND recursion_branch_count >= 2 AND has_swap_in_loop = 1 THEN 9
  WHEN has_recursion = 1 AND has_tree_pattern = 1 THEN 10
  WHEN has_recursion = 1 AND has_memoization = 1 THEN 11
  WHEN has_recursion = 1 AND recursion_branch_count >= 2 AND has_swap_in_loop = 0
       AND has_parallel_two_pointer_pattern = 0 AND has_tree_pattern = 0 THEN 12
  WHEN (uses_queue = 1 OR has_recursion = 1) AND uses_adjacency_structure = 1 THEN 13
  WHEN uses_queue = 1 AND has_visited_like_var = 1 THEN 14
  WHEN has_same_direction_pointer_pattern = 1 OR has_two_pointer_pattern = 1
       OR has_parallel_two_pointer_pattern = 1 THEN 15
  WHEN has_recursion = 0 AND array_dimensionality >= 2 AND max_loop_depth >= 2 THEN 16
  WHEN has_recursion = 0 AND has_swap_in_loop = 0 AND max_loop_depth <= 2
       AND (uses_dict = 1 OR array_dimensionality >= 1) AND uses_sorted_or_sort_call = 0
       AND num_loops >= 2 THEN 17
  WHEN has_recursion = 0 AND max_loop_depth = 2 AND has_swap_in_loop = 1 THEN 18
  WHEN max_loop_depth >= 2 THEN 19
  WHEN max_loop_depth = 1 THEN 20
  WHEN has_recursion = 1 THEN 21
  ELSE 22
END"""


def _est_sql() -> str:
    return f"""
WITH f AS ({fixtures.x4_sql()}),
r AS (SELECT f.*, {_CASE} AS rule_id FROM f)
SELECT r.*, dim.rule_name, dim.confidence,
  CASE WHEN r.rule_id = 11 AND array_dimensionality >= 2 THEN 'O(n * m)'
       WHEN r.rule_id = 11 THEN 'O(n)'
       WHEN r.rule_id = 19 THEN 'O(n^' || CAST(CAST(max_loop_depth AS INT) AS VARCHAR) || ')'
       ELSE dim.t END AS time_complexity,
  CASE WHEN r.rule_id = 11 AND array_dimensionality >= 2 THEN 'O(n * m)'
       WHEN r.rule_id = 11 THEN 'O(n)'
       WHEN r.rule_id IN (19, 20) AND (uses_dict = 1 OR uses_set = 1 OR array_dimensionality >= 1)
         THEN 'O(n)'
       WHEN r.rule_id IN (19, 20) THEN 'O(1)'
       ELSE dim.s END AS space_complexity
FROM r JOIN {_dim_values()} ON r.rule_id = dim.rule_id"""


def oracle():
    est = _est_sql()
    keys = ", ".join(fixtures.X4_KEYS)
    return {
        "rules_cascade": f"SELECT {keys}, rule_id, rule_name, time_complexity, space_complexity, "
                         f"confidence FROM ({est}) e",
        "rule_coverage": f"""SELECT rule_id, rule_name, count(*) AS n_rows,
  round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM ({est}) e GROUP BY rule_id, rule_name""",
        "rule_time_classes": f"SELECT time_complexity, confidence, count(*) AS n_rows "
                             f"FROM ({est}) e GROUP BY time_complexity, confidence",
    }


def queries():
    return {
        "rules_cascade": rules_cascade,
        "rule_coverage": rule_coverage,
        "rule_time_classes": rule_time_classes,
    }
