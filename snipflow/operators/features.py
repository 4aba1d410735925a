"""The structural features as relational queries over the node table.

1. **wide nodes** — the parser stores on each node its ancestor path and its direct
   children (each with its first child and that one's). "Inside a loop", "in the body
   of a For", "nearest FunctionDef", "the value assigned", "names compared" are array
   expressions on the node's own row; they become narrow columns before anything is
   written or shuffled: no join, no window, and the arrays never leave their task.
   What a snippet has if one node has it is a bit of each node's ``flags``. Only nodes
   that a feature reads leave the parser; the others count as children and ancestors.
2. **one aggregation per snippet** over the wide nodes, small enough to be compiled: the
   flags' ``bit_or``, counts and maxima. The rows of a snippet lie together, so nearly
   all of it happens before the exchange.
3. **side queries** over the few candidate rows of seven shapes that relate two distant
   nodes (recursion per function name, loop-body name sets, classes called by name,
   monotonic stack, same-direction pointers, matrix transpose, backtracking order).
   Their joins are equi-joins on (sample_id, node id or name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snipflow.schemas import FEATURE_NAMES
from snipflow.session import materialize

# --- fixed values: names the features test for -----------------------------
LOOP_KINDS = ["For", "While"]
READ_KINDS = frozenset(["Module", "ParseError", "For", "While", "If", "Return", "FunctionDef", "ClassDef", "arguments", "Call",
                        "Assign", "AugAssign", "Compare", "BoolOp", "Subscript", "Tuple"])
READ_COLUMNS = ["sample_id", "node_id", "parent_id", "field", "kind", "op", "name", "n_args", "n_elts", "parse_error", "error_type",
                "path", "path_fields", "path_kinds", "path_names", "children"]
READ_ATTRIBUTES = ["next", "left", "right", "children"]
HEAP_CALLS = ["heappush", "heappop", "heapify", "nlargest", "nsmallest"]
SORT_CALLS = ["sorted", "sort"]
BIT_OPS = ["BitXor", "BitAnd", "BitOr", "LShift", "RShift"]
READ_OPS = [*BIT_OPS, "Mod", "FloorDiv", "Div"]
VISITED_WORDS = ["visited", "seen", "marked"]
ADJ_WORDS = ["adj", "graph", "edges", "neighbors", "neighbours"]
MEMO_WORDS = ["memo", "cache", "dp"]
TWO_POINTER_NAMES = [
    "lo", "hi", "low", "high", "left", "right", "l", "r", "start", "end", "i", "j",
    "left_ptr", "right_ptr", "s", "e", "begin", "finish",
    "start_idx", "end_idx", "from_idx", "to_idx",
]
ADD_METHODS = ["append", "add"]
REMOVE_METHODS = ["pop", "remove"]
# ---------------------------------------------------------------------------

_LOOPS_SQL = "('For', 'While')"


def read_by_features(kind: str, name: str | None, op: str | None) -> bool:
    """Whether a feature reads nodes of this kind and name by themselves; the others
    count as children and ancestors of those only."""
    if kind == "Name":
        low = name.lower()
        return "parent" in low or "indegree" in low.replace("_", "") or not name.isascii()
    if kind == "Attribute":
        return name in READ_ATTRIBUTES
    return op in READ_OPS if kind == "BinOp" else kind in READ_KINDS


# ---- ancestor facts: array expressions over the node's own path --------------
def anc_loop_count() -> Column:
    return F.expr(f"size(filter(path_kinds, k -> k IN {_LOOPS_SQL}))")


def anc_in_loop_body() -> Column:
    return F.expr(f"exists(zip_with(path_kinds, path_fields, (k, f) -> k IN {_LOOPS_SQL} AND f = 'body'),"
                  " x -> x)")


def anc_first_loop_idx() -> Column:
    return F.expr(f"array_min(transform(path_kinds, (k, i) -> IF(k IN {_LOOPS_SQL}, i, NULL)))")


def _outer_body_loop_idx() -> Column:
    return F.expr(f"array_min(transform(path_kinds, (k, i) -> "
                  f"IF(k IN {_LOOPS_SQL} AND get(path_fields, i) = 'body', i, NULL)))")


def anc_outer_body_loop() -> Column:
    """Id of the outermost loop whose body contains the node."""
    return F.get("path", _outer_body_loop_idx())


def anc_nearest_function() -> Column:
    return F.expr("try_element_at(filter(zip_with(path_kinds, path_names, "
                  "(k, nm) -> IF(k = 'FunctionDef', nm, NULL)), x -> x IS NOT NULL), -1)")


def anc_ids(kind: str, field: str) -> Column:
    """Ids of ancestors of ``kind`` whose ``field`` holds the node."""
    return F.expr(f"filter(transform(path_kinds, (k, i) -> IF(k = '{kind}' AND "
                  f"get(path_fields, i) = '{field}', get(path, i), NULL)), x -> x IS NOT NULL)")


def _if_nesting() -> Column:
    """Ifs on the path below the first loop, plus the If itself."""
    return F.expr("size(filter(transform(path_kinds, (k, i) -> k = 'If' AND i > "
                  f"array_min(transform(path_kinds, (k2, j) -> IF(k2 IN {_LOOPS_SQL}, j, NULL)))), "
                  "x -> x)) + 1")


def _parent_kind() -> Column:
    return F.try_element_at("path_kinds", F.lit(-1))


def _words(c: Column, words: list[str]) -> Column:
    return F.lower(c).rlike("|".join(words))


def _flag(c: Column) -> Column:
    return F.coalesce(F.max(c.cast("int")), F.lit(0))


# ---- 1: wide nodes -------------------------------------------------------------
def _child(kind: str, cond, *cols: str) -> Column:
    """Of nodes of ``kind``: the child that meets a condition (a field that holds one node)."""
    narrow = F.transform(F.filter("children", cond), lambda c: F.struct(*[c[n].alias(n) for n in cols]))
    return F.when(F.col("kind") == kind, F.get(narrow, F.lit(0)))


def _in_field(*names: str):
    return lambda c: c["field"].isin(*names)


def _held(kind: str, cond, value) -> Column:
    """Of nodes of ``kind``: a value of each child that meets a condition."""
    return F.when(F.col("kind") == kind, F.transform(F.filter("children", cond), value))


def _callee() -> Column:
    return F.when(F.col("s_func.kind").isin("Name", "Attribute"), F.col("s_func.name"))


def _flags() -> dict[str, Column]:
    """What a snippet has if one of its nodes has it: conditions on wide nodes' columns."""
    kind, name, op = F.col("kind"), F.col("name"), F.col("op")
    parent_kind, in_top = F.col("parent_kind"), F.col("in_top")
    is_call, is_assign = kind == "Call", kind == "Assign"
    callee = _callee()
    single = is_assign & (F.col("n_elts") == 1)
    val = F.col("s_value")
    name_targets = F.col("c_name_targets")
    any_target = F.size(name_targets) > 0

    def targets_match(words):
        return F.exists(name_targets, lambda t: _words(t, words))

    zip_len = F.when(F.col("n_elts") <= F.col("n_args"), F.col("n_elts")).otherwise(
        F.least(F.col("n_args"), F.col("n_elts") - F.col("n_args")))
    cache_default = ((kind == "arguments") & (parent_kind == "FunctionDef")
                     & F.exists("c_cache_default_pos", lambda p: p < zip_len))
    while_test = (F.col("field") == "test") & (parent_kind == "While")
    return {
        "uses_priority_queue": is_call & callee.isin(*HEAP_CALLS),
        "uses_queue": is_call & (callee == "deque"),
        "_deque_by_name": is_call & (F.col("s_func.kind") == "Name") & (callee == "deque"),
        "uses_sorted_or_sort_call": is_call & callee.isin(*SORT_CALLS),
        "has_visited_like_var": is_assign & targets_match(VISITED_WORDS),
        "uses_adjacency_structure": is_assign & targets_match(ADJ_WORDS),
        "_memo_var": (is_assign & targets_match(MEMO_WORDS)) | cache_default,
        "uses_set": is_assign & any_target & ((val.kind == "Set") | ((val.kind == "Call") & (val.fc.kind == "Name")
                                                                     & (val["fc"]["name"] == "set"))),
        "uses_dict": (is_assign & any_target & ((val.kind == "Dict") | ((val.kind == "Call") & (val.fc.kind == "Name")
                                                                        & val["fc"]["name"].isin("dict", "defaultdict")))) | cache_default,
        "has_swap_in_loop": single & (F.col("s_t0.kind") == "Tuple") & (val.kind == "Tuple") & F.col("in_loop_body"),
        "has_two_pointer_pattern": (kind == "Compare") & while_test & (F.col("c_cmp_names") >= 2) & (F.col("c_cmp_other") == 0),
        "has_early_return_in_loop": (kind == "Return") & (F.col("n_loops_above") > 0),
        "uses_bit_manipulation": kind.isin("BinOp", "AugAssign") & op.isin(*BIT_OPS),
        "uses_modular_math": kind.isin("BinOp", "AugAssign") & (op == "Mod"),
        "has_linked_list_pattern": (kind == "Attribute") & (name == "next"),
        "_lr_attr": (kind == "Attribute") & name.isin("left", "right"),
        # self.left / self.right / self.children assigned inside a class
        "_class_tree": (kind == "Attribute") & name.isin("left", "right", "children")
            & (F.col("field") == "targets") & (parent_kind == "Assign")
            & (F.col("fc.kind") == "Name") & (F.col("fc.name") == "self")
            & F.col("in_class"),
        "has_prefix_pattern": is_assign & (val.kind == "BinOp") & (val.op == "Add") & (val.fc.kind == "Subscript")
            & (val.fc2.kind == "Name") & F.array_contains("c_sub_target_bases", val["fc2"]["name"]),
        "has_fast_slow_pointer_pattern": is_assign & (val.kind == "Attribute") & (val["name"] == "next")
            & (val.fc.kind == "Attribute") & (val["fc"]["name"] == "next"),
        "has_sliding_window_pattern": (kind == "Compare") & while_test & (F.col("c_cmp_binop") > 0)
            & F.col("in_for"),
        "has_parallel_two_pointer_pattern": (kind == "BoolOp") & (op == "And") & while_test & (F.col("n_elts") >= 2)
            & (F.col("c_clause_names") >= 2),
        "has_midpoint_calculation": (kind == "BinOp") & op.isin("FloorDiv", "Div") & (F.col("s_right.kind") == "Constant")
            & (F.col("s_right.const_num") == 2.0) & (F.col("s_left.kind") == "BinOp")
            & (F.col("s_left.op") == "Add"),
        "_parent_name": (kind == "Name") & F.lower(name).contains("parent"),
        "_indegree": (kind == "Name") & F.replace(F.lower(name), F.lit("_"), F.lit("")).contains("indegree"),
        "_fn_find": (kind == "FunctionDef") & F.lower(name).contains("find"),
        "_fn_union": (kind == "FunctionDef") & F.lower(name).contains("union"),
        # linked-list operations look inside module-level functions only
        "_top": in_top,
        "_next_in": in_top & (kind == "Attribute") & (name == "next"),
        "_skip": in_top & single & (F.col("s_t0.kind") == "Attribute") & (F.col("s_t0.name") == "next")
            & (val.kind == "Attribute") & (val["name"] == "next"),
    }


# Columns of wide nodes that only their own row's expressions read.
_PASSING = ["path", "path_fields", "path_kinds", "path_names", "s_left", "s_right", "c_cmp_names", "c_cmp_other", "c_cmp_binop",
            "c_clause_names", "c_name_targets", "c_sub_target_bases", "c_cache_default_pos", "in_loop_body", "in_for", "in_class"]


def wide_nodes(nodes: DataFrame) -> DataFrame:
    """Every node with narrow columns for what its path and its children tell; rows of
    snippets that do not parse stay as they are."""
    kind, field = F.col("kind"), F.col("field")
    name_of = lambda c: c["name"]
    opnd = _in_field("left", "comparators")
    is_opnd_name = lambda c: opnd(c) & (c["kind"] == "Name")
    first = F.get("children", F.lit(0))
    n = nodes.select(
        "sample_id", "node_id", "parent_id", "field", "kind", "op", "name", "n_args", "n_elts", "parse_error", "error_type",
        # the node's own path; read below, not kept
        "path", "path_fields", "path_kinds", "path_names",
        F.when(first.isNotNull(), F.struct(first["kind"].alias("kind"), first["name"].alias("name"))).alias("fc"),
        _child("Call", _in_field("func"), "kind", "name", "fc").alias("s_func"),
        _child("Assign", _in_field("value"), "kind", "name", "op", "fc", "fc2").alias("s_value"),
        _child("Assign", lambda c: (c["field"] == "targets") & (c["pos"] == 0), "node_id", "kind", "name").alias("s_t0"),
        _child("BinOp", _in_field("left"), "kind", "op").alias("s_left"),
        _child("BinOp", _in_field("right"), "kind", "const_num").alias("s_right"),
        _child("Subscript", _in_field("slice"), "kind", "name").alias("s_slice"),
        F.size(_held("Tuple", lambda c: (c["field"] == "elts") & (c["kind"] == "Subscript") & (c["fc"]["kind"] == "Subscript"),
                     lambda c: c["node_id"])).alias("c_subsub_elts"),
        F.size(_held("Compare", is_opnd_name, name_of)).alias("c_cmp_names"),
        F.size(_held("Compare", lambda c: is_opnd_name(c) & ~F.lower(c["name"]).isin(*TWO_POINTER_NAMES), name_of)).alias("c_cmp_other"),
        F.size(_held("Compare", lambda c: opnd(c) & (c["kind"] == "BinOp"), lambda c: c["node_id"])).alias("c_cmp_binop"),
        F.size(F.array_distinct(_held("BoolOp", lambda c: (c["field"] == "values") & (c["kind"] == "Compare") & (c["fc"]["kind"] == "Name"),
                                      lambda c: c["fc"]["name"]))).alias("c_clause_names"),
        _held("Assign", lambda c: (c["field"] == "targets") & (c["kind"] == "Name"), name_of).alias("c_name_targets"),
        _held("Assign", lambda c: (c["field"] == "targets") & (c["kind"] == "Subscript") & (c["fc"]["kind"] == "Name"),
              lambda c: c["fc"]["name"]).alias("c_sub_target_bases"),
        _held("arguments", lambda c: (c["field"] == "defaults") & c["kind"].isin("Dict", "List"), lambda c: c["pos"])
        .alias("c_cache_default_pos"))
    parent_kind = _parent_kind()
    is_call, is_assign = kind == "Call", kind == "Assign"
    pops = is_call & (F.col("s_func.kind") == "Attribute") & (F.col("s_func.name") == "pop")
    stmt_call = is_call & (field == "value") & (parent_kind == "Expr")
    chain_m = F.expr("array_max(transform(path_kinds, (k, i) -> "
                     "IF(NOT (k = 'Subscript' AND get(path_fields, i) = 'value'), i, NULL)))")
    # the statement's block must reach a For body through If body/orelse and
    # loop bodies only (steps above the Expr: indices up to size - 2)
    valid = F.expr(
        "array_max(transform(path_kinds, (k, i) -> IF(i <= size(path_kinds) - 2 AND k = 'For' "
        "AND get(path_fields, i) = 'body', i, NULL))) > coalesce(array_max(transform(path_kinds, "
        "(k, i) -> IF(i <= size(path_kinds) - 2 AND NOT ((k = 'If' AND get(path_fields, i) IN "
        f"('body', 'orelse')) OR (k IN {_LOOPS_SQL} AND get(path_fields, i) = 'body')), i, NULL))), -1)")
    return n.withColumns({
        "parent_kind": parent_kind,
        "n_loops_above": F.when(kind.isin(*LOOP_KINDS, "Return"), anc_loop_count()),
        "if_nesting": F.when((kind == "If") & anc_first_loop_idx().isNotNull(), _if_nesting()),
        "in_top": (F.get("path_kinds", F.lit(1)) == "FunctionDef") | ((kind == "FunctionDef") & (F.col("parent_id") == 0)),
        "top_def": F.when(kind == "FunctionDef", ~F.array_contains("path_kinds", "FunctionDef")),
        "dims": F.when(kind == "Subscript", F.size("path") - chain_m),
        "in_loop_body": F.when(is_assign, anc_in_loop_body()),
        "in_for": F.when(kind == "Compare", F.array_contains("path_kinds", "For")),
        "in_class": F.when(kind == "Attribute", F.array_contains("path_kinds", "ClassDef")),
        "fn": F.when(is_call, anc_nearest_function()),
        "blk": F.when(is_assign | is_call, anc_outer_body_loop()),
        "pop_above": F.when(pops, F.slice("path", _outer_body_loop_idx() + 2, F.size("path") + 1)),
        "in_ifs": F.when((kind == "AugAssign") | ((kind == "Subscript") & (field == "targets")), anc_ids("If", "body")),
        "in_fors": F.when(kind == "If", anc_ids("For", "body")),
        "bt_valid": F.when(stmt_call, valid),
        "bt_owner": F.when(stmt_call, F.try_element_at("path", F.lit(-2))),
        "bt_field": F.when(stmt_call, F.try_element_at("path_fields", F.lit(-2))),
        # the Expr; ids follow statement order
        "bt_stmt": F.when(stmt_call, F.col("parent_id")),
    }).withColumn("flags", reduce(Column.bitwiseOR, (F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
                                                     for i, c in enumerate(_flags().values())))).drop(*_PASSING)


def _join_all(base: DataFrame, parts: list[DataFrame]) -> DataFrame:
    out = base
    for p in parts:
        out = out.join(p, "sample_id", "left")
    return out


def compute_features(nodes: DataFrame) -> DataFrame:
    """One row per parsed sample of a node table: ``sample_id`` + the 39 features (doubles)."""
    return features_of(materialize(wide_nodes(nodes), "wide_nodes"))


def features_of(wide: DataFrame) -> DataFrame:
    """The same from written wide nodes, which the aggregation and the side queries read."""
    w = wide.where(F.col("kind") != "ParseError")
    kind, in_top, top_level_def = F.col("kind"), F.col("in_top"), F.col("top_def")
    callee = _callee()
    single = (kind == "Assign") & (F.col("n_elts") == 1)
    main = w.groupBy("sample_id").agg(
        F.count(F.when(kind.isin(*LOOP_KINDS), 1)).alias("num_loops"),
        F.max(F.when(kind.isin(*LOOP_KINDS), F.col("n_loops_above") + 1)).alias("max_loop_depth"),
        F.count(F.when(kind == "FunctionDef", 1)).alias("num_function_defs"),
        F.max_by(F.when(top_level_def, F.col("n_args")), F.when(top_level_def, F.col("node_id")))
        .alias("param_count"),
        F.max("dims").alias("array_dimensionality"),
        F.max("if_nesting").alias("max_if_nesting_in_loop"),
        F.bit_or("flags").alias("flags"))
    main = main.select("*", *[F.getbit("flags", F.lit(i)).cast("int").alias(c) for i, c in enumerate(_flags())]).drop("flags")
    sides = [_recursion(w, callee), _inserts(w), _reverse(w, in_top, single), _monotonic(w), _same_direction(w),
             _transpose(w, single), _backtracking(w)]
    j = _join_all(main, sides)

    def z(c):
        return F.coalesce(F.col(c), F.lit(0))

    has_rec = z("recursion_branch_count") > 0
    dim = z("array_dimensionality")
    fn_find, fn_union = F.col("_fn_find") == 1, F.col("_fn_union") == 1
    base_ll = (F.col("_top") == 1) & (F.col("_next_in") == 1)
    ll_ins = base_ll & (z("_ins") == 1)
    ll_del = base_ll & ~ll_ins & (F.col("_skip") == 1)
    ll_rev = base_ll & ~ll_ins & ~ll_del & (z("_rev") == 1)
    exprs = {
        "max_loop_depth": z("max_loop_depth"),
        "num_loops": F.col("num_loops"),
        "has_recursion": has_rec.cast("int"),
        "recursion_branch_count": z("recursion_branch_count"),
        "has_memoization": (has_rec & (F.col("_memo_var") == 1)).cast("int"),
        "uses_priority_queue": F.col("uses_priority_queue"),
        "uses_queue": F.col("uses_queue"),
        "uses_stack": F.lit(0),
        "uses_set": F.col("uses_set"),
        "uses_dict": F.col("uses_dict"),
        "has_visited_like_var": F.col("has_visited_like_var"),
        "has_2d_list_indexing": (dim >= 2).cast("int"),
        "array_dimensionality": dim,
        "has_swap_in_loop": F.col("has_swap_in_loop"),
        "uses_sorted_or_sort_call": F.col("uses_sorted_or_sort_call"),
        "has_two_pointer_pattern": F.col("has_two_pointer_pattern"),
        "num_function_defs": F.col("num_function_defs"),
        "max_if_nesting_in_loop": z("max_if_nesting_in_loop"),
        "has_early_return_in_loop": F.col("has_early_return_in_loop"),
        "param_count": z("param_count"),
        "uses_adjacency_structure": F.col("uses_adjacency_structure"),
        "uses_bit_manipulation": F.col("uses_bit_manipulation"),
        "has_linked_list_pattern": F.col("has_linked_list_pattern"),
        "has_ll_insert_pattern": ll_ins.cast("int"),
        "has_ll_delete_pattern": ll_del.cast("int"),
        "has_ll_reverse_pattern": ll_rev.cast("int"),
        "has_tree_pattern": ((F.col("_lr_attr") == 1) | (F.col("_class_tree") == 1)).cast("int"),
        "has_prefix_pattern": F.col("has_prefix_pattern"),
        "has_backtracking_undo_pattern": z("has_backtracking_undo_pattern"),
        "has_union_find_pattern": ((fn_find & fn_union)
                                   | ((F.col("_parent_name") == 1) & (fn_find | fn_union))).cast("int"),
        "has_fast_slow_pointer_pattern": F.col("has_fast_slow_pointer_pattern"),
        "has_sliding_window_pattern": F.col("has_sliding_window_pattern"),
        "has_monotonic_stack_pattern": z("has_monotonic_stack_pattern"),
        "has_topological_sort_pattern": ((F.col("_indegree") == 1) & (F.col("_deque_by_name") == 1)).cast("int"),
        "has_matrix_transpose_pattern": z("has_matrix_transpose_pattern"),
        "uses_modular_math": F.col("uses_modular_math"),
        "has_same_direction_pointer_pattern": z("has_same_direction_pointer_pattern"),
        "has_parallel_two_pointer_pattern": F.col("has_parallel_two_pointer_pattern"),
        "has_midpoint_calculation": F.col("has_midpoint_calculation"),
    }
    assert list(exprs) == FEATURE_NAMES
    return j.select("sample_id", *[F.coalesce(e.cast("double"), F.lit(0.0)).alias(k)
                                   for k, e in exprs.items()])


# ---- side queries over few candidate rows ----------------------------------------
def _recursion(w: DataFrame, callee: Column) -> DataFrame:
    """calls to the nearest enclosing function's name, pooled per name."""
    c = (w.where((F.col("kind") == "Call") & callee.isNotNull())
         .select("sample_id", callee.alias("callee"), "fn")
         .where(F.col("callee") == F.col("fn")))
    per_fn = c.groupBy("sample_id", "fn").agg(F.count(F.lit(1)).alias("c"))
    return per_fn.groupBy("sample_id").agg(F.max("c").alias("recursion_branch_count"))


def _inserts(w: DataFrame) -> DataFrame:
    """F24 helper: a class of the snippet is called by name in a module-level function."""
    is_class = F.col("kind") == "ClassDef"
    called = (F.col("kind") == "Call") & F.col("in_top") & (F.col("s_func.kind") == "Name")
    names = w.where(is_class | called).select("sample_id", F.when(is_class, F.col("name")).otherwise(F.col("s_func.name")).alias("v"),
                                              is_class.cast("int").alias("cls"))
    return (names.groupBy("sample_id", "v").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi")
            .groupBy("sample_id").agg(F.lit(1).alias("_ins")))


def _reverse(w: DataFrame, in_top: Column, single: Column) -> DataFrame:
    """F26 helper: a loop (in a module-level function) whose body assigns >= 3
    distinct plain names; the outermost such body holds all inner ones."""
    a = (w.where(in_top & single & (F.col("s_t0.kind") == "Name"))
         .select("sample_id", F.col("s_t0.name").alias("v"), "blk")
         .where(F.col("blk").isNotNull()))
    return (a.groupBy("sample_id", "blk").agg(F.count_distinct("v").alias("k")).where(F.col("k") >= 3)
            .groupBy("sample_id").agg(F.lit(1).alias("_rev")))


def _monotonic(w: DataFrame) -> DataFrame:
    """some loop body holds a While with a BoolOp test containing an
    attribute ``pop`` call, and an attribute ``append`` call."""
    is_attr_call = (F.col("kind") == "Call") & (F.col("s_func.kind") == "Attribute")
    wstar = (w.where((F.col("kind") == "BoolOp") & (F.col("field") == "test") & (F.col("parent_kind") == "While"))
             .select("sample_id", F.col("parent_id").alias("anc_id")).distinct())
    pops = (w.where(is_attr_call & (F.col("s_func.name") == "pop"))
            .select("sample_id", "blk", F.explode("pop_above").alias("anc_id")))
    cond_pop = pops.join(wstar, ["sample_id", "anc_id"]).select("sample_id", "blk").distinct()
    apps = (w.where(is_attr_call & (F.col("s_func.name") == "append"))
            .select("sample_id", "blk").where(F.col("blk").isNotNull())
            .distinct())
    return (cond_pop.join(apps, ["sample_id", "blk"]).groupBy("sample_id")
            .agg(F.lit(1).alias("has_monotonic_stack_pattern")))


def _same_direction(w: DataFrame) -> DataFrame:
    """an If inside a For body (plain-name loop variable) whose body both
    increments ``v`` and writes ``x[v]``, for some ``v`` other than the loop
    variable."""
    inc = (w.where((F.col("kind") == "AugAssign") & (F.col("op") == "Add") & (F.col("fc.kind") == "Name"))
           .select("sample_id", F.col("fc.name").alias("v"), F.lit(1).alias("inc"), F.lit(0).alias("wr"),
                   F.col("in_ifs").alias("ifs")))
    wr = (w.where((F.col("kind") == "Subscript") & (F.col("field") == "targets")
                  & (F.col("parent_kind") == "Assign") & (F.col("s_slice.kind") == "Name"))
          .select("sample_id", F.col("s_slice.name").alias("v"), F.lit(0).alias("inc"), F.lit(1).alias("wr"),
                  F.col("in_ifs").alias("ifs")))
    cand = (inc.unionByName(wr).select("sample_id", "v", "inc", "wr", F.explode("ifs").alias("if_id"))
            .groupBy("sample_id", "if_id", "v").agg(F.max("inc").alias("inc"), F.max("wr").alias("wr"))
            .where((F.col("inc") == 1) & (F.col("wr") == 1)))
    loop_var = (w.where((F.col("kind") == "For") & (F.col("fc.kind") == "Name"))
                .select("sample_id", F.col("node_id").alias("for_id"), F.col("fc.name").alias("loop_var")))
    if_fors = (w.where(F.col("kind") == "If")
               .select("sample_id", F.col("node_id").alias("if_id"),
                       F.explode("in_fors").alias("for_id"))
               .join(loop_var, ["sample_id", "for_id"]))
    return (cand.join(if_fors, ["sample_id", "if_id"]).where(F.col("loop_var") != F.col("v"))
            .groupBy("sample_id").agg(F.lit(1).alias("has_same_direction_pointer_pattern")))


def _transpose(w: DataFrame, single: Column) -> DataFrame:
    """single 2-tuple target whose elements are both subscripts of
    subscripts, with a tuple value."""
    tuples = (w.where((F.col("kind") == "Tuple") & (F.col("n_elts") == 2) & (F.col("c_subsub_elts") == 2))
              .select("sample_id", F.col("node_id").alias("t0_id")))
    assigns = (w.where(single & (F.col("s_t0.kind") == "Tuple") & (F.col("s_value.kind") == "Tuple"))
               .select("sample_id", F.col("s_t0.node_id").alias("t0_id")))
    return (assigns.join(tuples, ["sample_id", "t0_id"]).groupBy("sample_id")
            .agg(F.lit(1).alias("has_matrix_transpose_pattern")))


def _backtracking(w: DataFrame) -> DataFrame:
    """in a For body (or an If/loop body nested in one only through such
    blocks), an expression statement ``x.append/add(..)``, later a call to the
    current function, later ``x.pop/remove(..)`` on the same name."""
    calls = w.where("bt_valid")
    f = F.col("s_func")
    is_add = (f.kind == "Attribute") & f["name"].isin(*ADD_METHODS)
    is_rem = (f.kind == "Attribute") & f["name"].isin(*REMOVE_METHODS)
    fn = F.col("fn")
    is_rec = ~is_add & (f.kind == "Name") & fn.isNotNull() & (f["name"] == fn)
    recv = F.when(f.fc.kind == "Name", f["fc"]["name"])
    stmt = F.col("bt_stmt")
    s = calls.select(
        "sample_id", F.col("bt_owner").alias("owner"), F.col("bt_field").alias("blk_field"),
        stmt.alias("pos"),
        F.when(is_add & recv.isNotNull(), F.struct(stmt.alias("p"), recv.alias("v"))).alias("add"),
        F.when(is_rec, stmt).alias("rec_pos"),
        F.when(is_rem, recv).alias("rem_var"))
    win = (Window.partitionBy("sample_id", "owner", "blk_field").orderBy("pos")
           .rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("last_add", F.last("add", ignorenulls=True).over(win)) \
        .withColumn("last_rec", F.max("rec_pos").over(win))
    hit = (F.col("rem_var").isNotNull() & (F.col("rem_var") == F.col("last_add.v"))
           & (F.col("last_add.p") < F.col("last_rec")))
    return s.where(hit).groupBy("sample_id").agg(F.lit(1).alias("has_backtracking_undo_pattern"))


# ---- synthetic trees: the whole-subtree features only ------------------------------
SUBTREE_FEATURES = ["max_loop_depth", "num_loops", "has_recursion", "recursion_branch_count",
                    "num_function_defs", "max_if_nesting_in_loop", "has_early_return_in_loop"]


def subtree_features(nodes: DataFrame, callee: str = "name") -> DataFrame:
    """F1-F4, F17-F19 on any preorder tree carrying ancestor arrays, where a
    Call node names its callee in column ``callee`` (synthetic trees)."""
    kind = F.col("kind")
    main = nodes.groupBy("sample_id").agg(
        F.count(F.when(kind.isin(*LOOP_KINDS), 1)).cast("int").alias("num_loops"),
        F.coalesce(F.max(F.when(kind.isin(*LOOP_KINDS), anc_loop_count() + 1)), F.lit(0)).cast("int")
        .alias("max_loop_depth"),
        F.count(F.when(kind == "FunctionDef", 1)).cast("int").alias("num_function_defs"),
        F.coalesce(F.max(F.when((kind == "If") & anc_first_loop_idx().isNotNull(), _if_nesting())),
                   F.lit(0)).cast("int").alias("max_if_nesting_in_loop"),
        _flag((kind == "Return") & (anc_loop_count() > 0)).cast("int").alias("has_early_return_in_loop"))
    calls = (nodes.where((kind == "Call") & F.col(callee).isNotNull())
             .select("sample_id", F.col(callee).alias("callee"), anc_nearest_function().alias("fn"))
             .where(F.col("callee") == F.col("fn")))
    rec = (calls.groupBy("sample_id", "fn").agg(F.count(F.lit(1)).alias("c"))
           .groupBy("sample_id").agg(F.max("c").alias("br")))
    j = main.join(rec, "sample_id", "left")
    br = F.coalesce(F.col("br"), F.lit(0))
    return j.select("sample_id", "max_loop_depth", "num_loops", (br > 0).cast("int").alias("has_recursion"),
                    br.cast("int").alias("recursion_branch_count"), "num_function_defs",
                    "max_if_nesting_in_loop", "has_early_return_in_loop")


# ---- corpus level ------------------------------------------------------------------
def build_features(corpus: DataFrame, code: str = "code") -> tuple[DataFrame, DataFrame]:
    """P1 + P3: corpus rows with their 39 features, and rejects (rows whose
    snippet does not parse, with the message). Duplicate snippets parse once
    but keep their own rows; a hot duplicate is a skewed join key that AQE
    splits."""
    from snipflow.operators.parse import parse_nodes, sample_ids
    nodes = materialize(wide_nodes(parse_nodes(corpus, code, READ_COLUMNS, read_by_features)), "wide_nodes")
    feats = features_of(nodes)
    rows = sample_ids(corpus, code)
    good = rows.join(feats, "sample_id")
    rejects = rows.join(nodes.where(F.col("kind") == "ParseError")
                        .select("sample_id", "parse_error"), "sample_id")
    return good, rejects


def failure_report(rejects: DataFrame, order_col: str, shown: int = 20) -> DataFrame:
    """The first ``shown`` failures by ``order_col`` plus the total and the
    number not shown ("... and N more"). A top-k, not a sort of all failures."""
    total = rejects.agg(F.count(F.lit(1)).alias("n_failed")).scalar()   # scalar subquery
    return (rejects.orderBy(order_col).limit(shown)
            .withColumn("n_failed", total)
            .withColumn("n_more", F.greatest(F.col("n_failed") - shown, F.lit(0))))
