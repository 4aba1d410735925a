"""Complexity rules (J5): an ordered first-match cascade over the 39 features.

The cascade is one ``CASE WHEN`` producing ``rule_id``; descriptive texts come
from a 22-row dimension joined by broadcast (its size is fixed by this file).
Time/space strings are values that must match; the reasoning prose is ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from snipflow.session import literal_df

# --- fixed values: rule texts (id, name, time, space, confidence) ----------
# ids follow the cascade order. None = computed per row (see _time/_space).
RULES = [
    (1, "binary_search", "O(log n)", "O(1)", "high"),
    (2, "union_find", "O(alpha(n)) amortized per operation", "O(n)", "medium"),
    (3, "topological_sort", "O(V + E)", "O(V + E)", "high"),
    (4, "fast_slow_pointer", "O(n)", "O(1)", "high"),
    (5, "sliding_window", "O(n)", "O(1) or O(k) if tracking window contents in a set/dict", "high"),
    (6, "monotonic_stack", "O(n)", "O(n)", "high"),
    (7, "backtracking", "O(k^n) or O(n!) (problem-dependent, exponential)", "O(n)", "low"),
    (8, "divide_conquer_merge", "O(n log n)", "O(n)", "high"),
    (9, "divide_conquer_partition", "O(n log n) average, O(n^2) worst case",
     "O(log n) average (recursion stack)", "low"),
    (10, "tree_recursion", "O(n)", "O(h) where h is tree height (O(log n) balanced, O(n) worst case)",
     "medium"),
    (11, "recursive_memoized", None, None, "medium"),
    (12, "recursive_unmemoized_branching", "O(2^n)", "O(n)", "medium"),
    (13, "bfs_dfs", "O(V + E)", "O(V)", "medium"),
    (14, "bfs_no_adjacency_name", "O(V + E)", "O(V)", "medium"),
    (15, "two_pointer", "O(n)", "O(1)", "high"),
    (16, "2d_dp_iterative", "O(n * m)", "O(n * m)", "high"),
    (17, "distribution_sort", "O(n + k)", "O(n + k)", "low"),
    (18, "nested_loops_swap", "O(n^2)", "O(1)", "high"),
    (19, "nested_loops_generic", None, None, "low"),
    (20, "single_loop", "O(n)", None, "medium"),
    (21, "recursion_fallback", "O(n) to O(2^n) (recursion shape not fully resolved by static rules)",
     "O(n)", "low"),
    (22, "constant", "O(1)", "O(1)", "medium"),
    (0, "unknown", "Unknown", "Unknown", "low"),
]
# ---------------------------------------------------------------------------

# Our own explanation per rule (prose, not a result value).
REASONING = {
    1: "Halving midpoint inside one loop without recursion: the search range shrinks by half per step.",
    2: "find/union over a parent structure: near-constant amortised cost per operation.",
    3: "In-degree counts with a queue: each vertex and edge is handled once.",
    4: "Pointer advanced by two links per step: one pass, no extra structure.",
    5: "Inner window-shrinking while inside a for: every index moves forward only.",
    6: "Conditional pop before push: each element enters and leaves the stack once.",
    7: "Add, recurse, undo: the search tree grows exponentially with input size.",
    8: "Two self-calls and a two-index merge: log n levels of linear merging.",
    9: "Two self-calls and an in-loop swap: partitioning, quadratic on bad pivots.",
    10: "Self-call over left/right children: each node once, stack bounded by height.",
    11: "Self-call with a cache: each distinct state is computed once.",
    12: "Two or more self-calls without a cache: repeated subproblems blow up.",
    13: "Traversal over an adjacency structure: vertices and edges once each.",
    14: "Queue with visited tracking: a breadth-first traversal.",
    15: "Two indices that only move forward or toward each other: one pass.",
    16: "Nested loops filling a two-dimensional table without recursion.",
    17: "Several passes building counts or buckets, no comparisons or recursion.",
    18: "Two nested loops with an in-place swap: quadratic comparison sort.",
    19: "Nested loops with no faster pattern: the bound follows the nesting depth.",
    20: "One loop over the input without recursion: linear time.",
    21: "Recursion whose shape no specific rule resolved; review by hand.",
    22: "No loops and no recursion: constant time and space.",
    0: "No rule matched this feature combination.",
}

RULE_NAMES = {r[0]: r[1] for r in RULES}

_DIM_SCHEMA = T.StructType([
    T.StructField("rule_id", T.IntegerType(), False),
    T.StructField("rule_name", T.StringType(), False),
    T.StructField("dim_time", T.StringType(), True),
    T.StructField("dim_space", T.StringType(), True),
    T.StructField("confidence", T.StringType(), False),
    T.StructField("dim_reasoning", T.StringType(), False),
])


def rules_dimension(spark: SparkSession) -> DataFrame:
    rows = [(i, n, t, s, c, REASONING[i]) for i, n, t, s, c in RULES]
    return literal_df(spark, rows, _DIM_SCHEMA)


def _c(name: str) -> Column:
    return F.col(name)


def rule_id_col() -> Column:
    """First-match cascade, in rule order. Feature values are 0/1 flags or counts."""
    rec = _c("has_recursion") != 0
    memo = _c("has_memoization") != 0
    br = _c("recursion_branch_count")
    d = _c("max_loop_depth")
    dim = _c("array_dimensionality")
    swap = _c("has_swap_in_loop") != 0
    par = _c("has_parallel_two_pointer_pattern") != 0
    tree = _c("has_tree_pattern") != 0
    queue = _c("uses_queue") != 0
    adj = _c("uses_adjacency_structure") != 0
    return (
        F.when((_c("has_midpoint_calculation") != 0) & (d == 1) & ~rec, 1)
        .when(_c("has_union_find_pattern") != 0, 2)
        .when(_c("has_topological_sort_pattern") != 0, 3)
        .when(_c("has_fast_slow_pointer_pattern") != 0, 4)
        .when(_c("has_sliding_window_pattern") != 0, 5)
        .when(_c("has_monotonic_stack_pattern") != 0, 6)
        .when(_c("has_backtracking_undo_pattern") != 0, 7)
        .when(rec & (br >= 2) & par, 8)
        .when(rec & (br >= 2) & swap, 9)
        .when(rec & tree, 10)
        .when(rec & memo, 11)
        .when(rec & ~memo & (br >= 2) & ~swap & ~par & ~tree, 12)
        .when((queue | rec) & adj, 13)
        .when(queue & (_c("has_visited_like_var") != 0), 14)
        .when((_c("has_same_direction_pointer_pattern") != 0)
              | (_c("has_two_pointer_pattern") != 0) | par, 15)
        .when(~rec & (dim >= 2) & (d >= 2), 16)
        .when(~rec & ~swap & (d <= 2) & ((_c("uses_dict") != 0) | (dim >= 1))
              & (_c("uses_sorted_or_sort_call") == 0) & (_c("num_loops") >= 2), 17)
        .when(~rec & (d == 2) & swap, 18)
        .when(d >= 2, 19)
        .when(~rec & (d == 1), 20)
        .when(rec, 21)
        .when(~rec & (d == 0), 22)
        .otherwise(0)
    )


def _extra_space() -> Column:
    return ((_c("uses_dict") != 0) | (_c("uses_set") != 0)
            | (_c("array_dimensionality") >= 1))


def estimate(df: DataFrame) -> DataFrame:
    """Append rule_id, rule_name, time/space complexity, confidence, reasoning.

    ``df`` needs the feature columns the cascade reads; other columns pass
    through. The dimension is 23 rows, so the broadcast is bounded.
    """
    spark = df.sparkSession
    dim = F.broadcast(rules_dimension(spark))
    depth = F.col("max_loop_depth").cast("int")
    time_c = (F.when(F.col("rule_id") == 11,
                     F.when(F.col("array_dimensionality") >= 2, F.lit("O(n * m)")).otherwise("O(n)"))
              .when(F.col("rule_id") == 19,
                    F.concat(F.lit("O(n^"), depth.cast("string"), F.lit(")")))
              .otherwise(F.col("dim_time")))
    space_c = (F.when(F.col("rule_id") == 11,
                      F.when(F.col("array_dimensionality") >= 2, F.lit("O(n * m)")).otherwise("O(n)"))
               .when(F.col("rule_id").isin(19, 20),
                     F.when(_extra_space(), F.lit("O(n)")).otherwise("O(1)"))
               .otherwise(F.col("dim_space")))
    reasoning = F.when(
        F.col("rule_id") == 19,
        F.concat(F.lit("Loops nested "), depth.cast("string"),
                 F.lit(" levels deep with no faster pattern: the bound follows the nesting depth.")),
    ).otherwise(F.col("dim_reasoning"))
    return (df.withColumn("rule_id", rule_id_col())
            .join(dim, "rule_id", "left")
            .withColumn("time_complexity", time_c)
            .withColumn("space_complexity", space_c)
            .withColumn("reasoning", reasoning)
            .drop("dim_time", "dim_space", "dim_reasoning"))


def rule_coverage(estimates: DataFrame) -> DataFrame:
    """Rows and share per rule. Partial aggregation before the shuffle,
    so a dominant rule costs one row per map task."""
    counts = estimates.groupBy("rule_id", "rule_name").agg(F.count(F.lit(1)).alias("n_rows"))
    # at most 23 rows reach this window
    total = F.sum("n_rows").over(Window.partitionBy())
    return counts.select("rule_id", "rule_name", "n_rows",
                         F.round(F.col("n_rows") / total, 6).alias("share"))
