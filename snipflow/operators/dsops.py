"""Step-level views of trace records (T4-T14), all native column expressions.

Locals are ``array<struct<name, kind, items array<string>, repr>>`` in frame
order (first-match picks depend on it); ``items`` hold each element's Python
repr. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipflow.functions.text import PY_WS, py_splitlines, py_strip

# --- fixed values: limits and name sets of the step view --------------------
MAX_REPR_LENGTH = 1000
TRUNCATED_SUFFIX = "... (truncated)"
MAX_ITEMS = 50
VIEW_ITEMS = 20
ENGINE_NAMES = ["__builtins__", "__name__"]
MODULE_NAMES = ["collections", "heapq"]
NON_STACK_NAMES = ["result", "res", "output", "ans"]
RE_POP = r"\.pop\(\s*\)"
RE_QUEUE_WORD = r"\b(queue|deque|q|frontier)\b"
RE_STACK_WORD = r"\b(stack|stk)\b"
RE_PUSH_CALL = r"\.(append|push)\("
RE_FIRST_ARG = r"\.\w+\(\s*([^\)]+?)\s*\)"
# ---------------------------------------------------------------------------

RE_INT = r"^[+-]?[0-9]+(_[0-9]+)*$"
RE_FLOAT = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[0-9]+[eE][+-]?[0-9]+$"


def py_list_text(items: Column) -> Column:
    """``str(list)`` for a list whose items are already reprs."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def attach_line_text(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """T4: line text by line number; out of range -> ''.

    Each run's code is split once (``posexplode``) and equi-joined on
    (run_id, line_number), so a long text is never re-split per step and a hot
    run's steps spread over its line numbers.
    """
    # split only the code of runs that have steps (a semi join on the run ids)
    active = runs.join(steps.select("run_id").distinct(), "run_id", "left_semi")
    lines = active.select("run_id", F.posexplode(py_splitlines(F.col("code"))).alias("p", "line_text"))
    lines = lines.select("run_id", (F.col("p") + 1).cast("int").alias("line_number"), "line_text")
    return (steps.join(lines, ["run_id", "line_number"], "left")
            .withColumn("line_text", F.coalesce(F.col("line_text"), F.lit(""))))


def _truncate(c: Column) -> Column:
    return F.when(F.length(c) > MAX_REPR_LENGTH,
                  F.concat(F.substring(c, 1, MAX_REPR_LENGTH), F.lit(TRUNCATED_SUFFIX))
                  ).otherwise(c)


def collection_text(kind: Column, items: Column) -> Column:
    """Text of a collection of ``kind`` whose item texts are ``items``."""
    inner = F.array_join(items, ", ")
    braces = F.concat(F.lit("{"), inner, F.lit("}"))
    return (F.when(kind == "tuple", F.concat(F.lit("("), inner, F.when(F.size(items) == 1, ",").otherwise(""), F.lit(")")))
            .when(kind == "set", F.when(F.size(items) == 0, "set()").otherwise(braces))
            .when(kind == "dict", braces)
            .when(kind == "deque", F.concat(F.lit("deque(["), inner, F.lit("])")))
            .otherwise(py_list_text(items)))


def plain_text(item: Column) -> Column:
    """``str`` of an item given as its repr: a quoted string loses its quotes and escapes."""
    quoted = F.regexp_like(item, F.lit(r"(?s)^'.*'$|^\".*\"$")) & (F.length(item) >= 2)
    inside = F.regexp_replace(F.substring(item, F.lit(2), F.length(item) - 2), r"\\([\\'\"])", "$1")
    return F.when(quoted, inside).otherwise(item)


def sanitise_locals(locals_col: Column) -> Column:
    """T5 + T6: drop engine names and module handles; cut long strings; a
    collection whose repr exceeds the limit becomes its truncated repr, a deque
    its repr; others keep their first 50 items."""
    keep = F.filter(locals_col, lambda x: ~x["name"].isin(*ENGINE_NAMES)
                    & ~(x["name"].isin(*MODULE_NAMES) & (x["kind"] == "module")))

    def bound(x):
        is_coll = x["kind"].isin("list", "tuple", "set", "deque", "dict")
        full = collection_text(x["kind"], x["items"])
        too_long = is_coll & ((x["kind"] == "deque") | (F.length(full) > MAX_REPR_LENGTH))
        return F.struct(
            x["name"].alias("name"),
            F.when(too_long, F.lit("repr")).otherwise(x["kind"]).alias("kind"),
            F.when(too_long, F.lit(None).cast("array<string>"))
            .when(is_coll, F.slice(x["items"], 1, MAX_ITEMS)).otherwise(x["items"]).alias("items"),
            F.when(too_long, _truncate(full)).otherwise(_truncate(x["repr"])).alias("repr"),
        )

    return F.transform(keep, bound)


def detect_operations(steps: DataFrame) -> DataFrame:
    """Classify each step's line, pick the structure, build the view.

    Adds operation, ds_type, value, data, active_indices, front, rear, top, log.
    The snapshot shows the structure before the line runs.
    """
    # the stripped line is read by every test below: compute it once
    steps = steps.withColumn("_t", py_strip(F.col("line_text")))
    t = F.col("_t")
    loc = F.col("locals")
    is_deq = t.contains(".popleft(") | t.contains(".pop(0)")
    is_pop = F.regexp_like(t, F.lit(RE_POP)) & ~t.contains(".pop(0)")
    is_enq = F.regexp_like(t, F.lit(RE_QUEUE_WORD)) & t.contains(".append(")
    is_push = F.regexp_like(t, F.lit(RE_STACK_WORD)) & F.regexp_like(t, F.lit(RE_PUSH_CALL))
    op = (F.when(t == "", F.lit(None)).when(is_deq, "dequeue").when(is_pop, "pop")
          .when(is_enq, "enqueue").when(is_push, "push"))

    # Which local is the structure
    seq_like = F.filter(loc, lambda x: x["kind"].isin("list", "deque"))
    lists = F.filter(loc, lambda x: x["kind"] == "list")
    stack_named = F.filter(lists, lambda x: x["name"].contains("stack") | x["name"].contains("stk")
                           | F.lower(x["name"]).contains("arr") | (x["name"] == "s"))
    other_list = F.filter(lists, lambda x: ~x["name"].isin(*NON_STACK_NAMES))
    push_named = F.filter(lists, lambda x: x["name"].contains("stack") | x["name"].contains("stk"))
    picked = (F.when(F.col("operation").isin("dequeue", "enqueue"), F.get(seq_like, 0))
              .when(F.col("operation") == "pop",
                    F.coalesce(F.get(stack_named, 0), F.get(other_list, 0)))
              .when(F.col("operation") == "push", F.get(push_named, 0)))

    # Argument of the first method call
    has_arg = F.regexp_like(t, F.lit(RE_FIRST_ARG))
    raw = F.regexp_replace(py_strip(F.regexp_extract(t, RE_FIRST_ARG, 1)), "^['\"]+|['\"]+$", "")
    named = F.get(F.filter(loc, lambda x: x["name"] == F.col("_raw")), 0)
    named_text = F.when(named["kind"].isin("list", "tuple", "set", "deque"),
                        collection_text(named["kind"], named["items"])).otherwise(named["repr"])
    int_val = F.expr("try_cast(replace(_raw, '_', '') AS BIGINT)").cast("string")
    arg = (F.when(~F.col("_has_arg"), F.lit("None"))
           .when(F.regexp_like(F.col("_raw"), F.lit(RE_INT)) & int_val.isNotNull(), int_val)
           .when(F.regexp_like(F.col("_raw"), F.lit(RE_FLOAT)),
                 F.expr("try_cast(_raw AS DOUBLE)").cast("string"))
           .when(named.isNotNull(), named_text)
           .otherwise(F.col("_raw")))

    out = (steps.withColumn("operation", op)
           .withColumn("_s", picked)
           .withColumn("_has_arg", has_arg).withColumn("_raw", raw)
           .withColumn("_arg", F.when(F.col("operation").isin("enqueue", "push"), arg)))
    items = F.col("_s.items")
    n = F.size(items)
    found = F.col("_s").isNotNull()
    first = F.coalesce(F.get(items, 0), F.lit("None"))
    last = F.when(n > 0, F.get(items, n - 1)).otherwise(F.lit("None"))
    view = py_list_text(F.slice(items, 1, VIEW_ITEMS))
    o = F.col("operation")
    value = (F.when(o == "dequeue", F.when(found, first))
             .when(o == "pop", F.when(found, last))
             .otherwise(F.col("_arg")))
    active = (F.when(~found, F.lit(None))
              .when(n == 0, F.lit("[]"))
              .when(o == "dequeue", F.lit("[0]"))
              .otherwise(F.concat(F.lit("["), (n - 1).cast("string"), F.lit("]"))))
    is_queue = o.isin("dequeue", "enqueue")
    front = F.when(found & is_queue, F.when(n > 0, 0).otherwise(-1))
    rear = F.when(found & is_queue, F.when(n > 0, n - 1).otherwise(-1))
    top = F.when(found & ~is_queue, n - 1)
    log = (F.when(o == "dequeue", F.when(found, F.concat(
                F.lit("Dequeued "), plain_text(first), F.lit(" from queue. Queue is now: "),
                py_list_text(F.slice(items, 2, VIEW_ITEMS - 1))))
                .otherwise(F.lit("Dequeued from queue.")))
           .when(o == "pop", F.when(found, F.concat(
                F.lit("Popped "), plain_text(last), F.lit(" from stack. Stack is now: "),
                py_list_text(F.slice(items, 1, F.greatest(n - 1, F.lit(0))))))
                .otherwise(F.lit("Popped from stack.")))
           .when(o == "enqueue", F.when(found, F.concat(
                F.lit("Enqueued "), F.col("_arg"), F.lit(" to queue. Queue is now: "), view))
                .otherwise(F.concat(F.lit("Enqueued "), F.col("_arg"), F.lit(" to queue."))))
           .when(o == "push", F.when(found, F.concat(
                F.lit("Pushed "), F.col("_arg"), F.lit(" to stack. Stack is now: "), view))
                .otherwise(F.concat(F.lit("Pushed "), F.col("_arg"), F.lit(" to stack.")))))
    return (out.withColumn("ds_type", F.when(is_queue, "queue").when(o.isNotNull(), "stack"))
            .withColumn("value", value)
            .withColumn("data", F.when(found, view))
            .withColumn("active_indices", active)
            .withColumn("front", front.cast("int")).withColumn("rear", rear.cast("int"))
            .withColumn("top", top.cast("int"))
            .withColumn("log", log)
            .drop("_s", "_has_arg", "_raw", "_arg", "_t"))


def py_str_repr(c: Column) -> Column:
    """``repr(str)`` for printable text: quote choice and escapes of quotes and backslashes."""
    esc = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    use_double = c.contains("'") & ~c.contains('"')
    return F.when(use_double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def words_local(text: Column) -> Column:
    """A list local holding ``text.split()`` (items as reprs)."""
    words = F.filter(F.split(text, f"{PY_WS}+"), lambda w: w != "")
    return F.struct(F.lit("words").alias("name"), F.lit("list").alias("kind"),
                    F.transform(words, py_str_repr).alias("items"),
                    F.lit(None).cast("string").alias("repr"))


def operation_mix(ops: DataFrame) -> DataFrame:
    """Operations per run (partial aggregation first)."""
    return (ops.where(F.col("operation").isNotNull())
            .groupBy("run_id", "operation").agg(F.count(F.lit(1)).alias("n_ops")))
