from pyspark.sql import functions as F

from conftest import SF01
from snipflow.operators import rules
from snipflow.sources import fixtures as fx

# rows per rule on X4 at sf0.01 (FIXTURES.md)
EXPECTED = {1: 333, 2: 1962, 3: 1568, 4: 2357, 5: 1293, 6: 1238, 7: 2764, 8: 1084, 9: 1553,
            10: 1038, 11: 2564, 12: 6956, 13: 1155, 14: 246, 15: 4296, 16: 8441, 17: 3540,
            18: 415, 19: 3399, 20: 4928, 21: 1977, 22: 6893}


def test_rule_counts_match_fixture(spark):
    est = rules.estimate(fx.x4_features(spark, SF01))
    got = {r["rule_id"]: r["n_rows"] for r in rules.rule_coverage(est).collect()}
    assert got == EXPECTED


def test_dynamic_texts(spark):
    rows = [(2.0, 0.0, 0.0, 0.0, 0.0, 0.0), (3.0, 1.0, 0.0, 0.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    cols = ["max_loop_depth", "uses_dict", "uses_set", "array_dimensionality", "has_recursion",
            "has_memoization"]
    df = spark.createDataFrame(rows, cols)
    for c in ["recursion_branch_count", "has_swap_in_loop", "has_parallel_two_pointer_pattern",
              "has_tree_pattern", "uses_queue", "uses_adjacency_structure", "has_visited_like_var",
              "has_same_direction_pointer_pattern", "has_two_pointer_pattern", "uses_sorted_or_sort_call",
              "num_loops", "has_midpoint_calculation", "has_union_find_pattern",
              "has_topological_sort_pattern", "has_fast_slow_pointer_pattern", "has_sliding_window_pattern",
              "has_monotonic_stack_pattern", "has_backtracking_undo_pattern"]:
        df = df.withColumn(c, F.lit(0.0))
    out = {r["max_loop_depth"]: r for r in rules.estimate(df).collect()}
    assert out[2.0]["rule_id"] == 19 and out[2.0]["time_complexity"] == "O(n^2)"
    assert out[2.0]["space_complexity"] == "O(1)"
    assert out[3.0]["time_complexity"] == "O(n^3)" and out[3.0]["space_complexity"] == "O(n)"
    assert out[1.0]["rule_id"] == 20 and out[1.0]["space_complexity"] == "O(1)"
