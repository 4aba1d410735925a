"""Schemas and fixed names shared by every stage."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: feature names in their required order (39) -------------
FEATURE_NAMES = [
    "max_loop_depth",
    "num_loops",
    "has_recursion",
    "recursion_branch_count",
    "has_memoization",
    "uses_priority_queue",
    "uses_queue",
    "uses_stack",
    "uses_set",
    "uses_dict",
    "has_visited_like_var",
    "has_2d_list_indexing",
    "array_dimensionality",
    "has_swap_in_loop",
    "uses_sorted_or_sort_call",
    "has_two_pointer_pattern",
    "num_function_defs",
    "max_if_nesting_in_loop",
    "has_early_return_in_loop",
    "param_count",
    "uses_adjacency_structure",
    "uses_bit_manipulation",
    "has_linked_list_pattern",
    "has_ll_insert_pattern",
    "has_ll_delete_pattern",
    "has_ll_reverse_pattern",
    "has_tree_pattern",
    "has_prefix_pattern",
    "has_backtracking_undo_pattern",
    "has_union_find_pattern",
    "has_fast_slow_pointer_pattern",
    "has_sliding_window_pattern",
    "has_monotonic_stack_pattern",
    "has_topological_sort_pattern",
    "has_matrix_transpose_pattern",
    "uses_modular_math",
    "has_same_direction_pointer_pattern",
    "has_parallel_two_pointer_pattern",
    "has_midpoint_calculation",
]
# ---------------------------------------------------------------------------

# F-number (1-based, as in the survey) -> name
FEATURE_BY_ID = {i + 1: n for i, n in enumerate(FEATURE_NAMES)}

FEATURES_SCHEMA = T.StructType(
    [T.StructField(n, T.DoubleType(), False) for n in FEATURE_NAMES]
    + [T.StructField("label", T.StringType(), True)]
)

CORPUS_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), True),
    T.StructField("label", T.StringType(), True),
])

# The syntax-node table schema lives with its producer: operators/parse.py NODE_SCHEMA.

LOCAL_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), True),
    T.StructField("kind", T.StringType(), True),
    T.StructField("items", T.ArrayType(T.StringType()), True),
    T.StructField("repr", T.StringType(), True),
])

TRACE_STEPS_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("event", T.StringType(), False),
    T.StructField("func_name", T.StringType(), True),
    T.StructField("line_number", T.IntegerType(), True),
    T.StructField("locals", T.ArrayType(LOCAL_SCHEMA), True),
    T.StructField("output", T.StringType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
])

# Python's syntax error and its subclasses: all report as syntax errors.
SYNTAX_ERRORS = ("SyntaxError", "IndentationError", "TabError")
