"""Test inputs derived from the driver tables (FIXTURES.md X1-X6).

The driver tables hold no code, so each operator family gets its input by
arithmetic over a real table. Every derivation is written once as a small
SQL-expression spec so that the Spark side and the DuckDB oracle read the same
input; the operators under test are written independently on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipflow.schemas import FEATURE_BY_ID, FEATURE_NAMES
from snipflow.sources.tables import table

# ---------------------------------------------------------------- X4 -------
# b = l_orderkey*31 + l_partkey*17 + l_suppkey*7 + l_linenumber*3
X4_B = "(l_orderkey*31 + l_partkey*17 + l_suppkey*7 + l_linenumber*3)"

# F-number -> expression over b; "{div}" is integer division in the dialect.
_X4_SPEC = {
    1: "b % 4",
    3: "CASE WHEN b % 3 = 0 THEN 1 ELSE 0 END",
    4: "CASE WHEN b % 3 = 0 THEN 1 + (b {div} 3) % 4 ELSE 0 END",
    5: "CASE WHEN b % 5 = 1 AND b % 3 = 0 THEN 1 ELSE 0 END",
    13: "(b {div} 5) % 4",
    10: "CASE WHEN (b {div} 7) % 2 = 0 THEN 1 ELSE 0 END",
    9: "CASE WHEN (b {div} 2) % 2 = 0 THEN 1 ELSE 0 END",
    15: "CASE WHEN b % 6 = 1 THEN 1 ELSE 0 END",
    14: "CASE WHEN b % 7 = 0 THEN 1 ELSE 0 END",
    7: "CASE WHEN b % 17 = 1 THEN 1 ELSE 0 END",
    11: "CASE WHEN b % 7 = 3 THEN 1 ELSE 0 END",
    16: "CASE WHEN b % 53 = 0 THEN 1 ELSE 0 END",
    39: "CASE WHEN b % 29 = 0 THEN 1 ELSE 0 END",
    30: "CASE WHEN b % 31 = 0 THEN 1 ELSE 0 END",
    34: "CASE WHEN b % 37 = 0 THEN 1 ELSE 0 END",
    31: "CASE WHEN b % 23 = 0 THEN 1 ELSE 0 END",
    32: "CASE WHEN b % 41 = 0 THEN 1 ELSE 0 END",
    33: "CASE WHEN b % 43 = 0 THEN 1 ELSE 0 END",
    29: "CASE WHEN b % 19 = 0 THEN 1 ELSE 0 END",
    38: "CASE WHEN b % 11 = 0 THEN 1 ELSE 0 END",
    27: "CASE WHEN b % 13 = 0 THEN 1 ELSE 0 END",
    21: "CASE WHEN b % 5 = 2 THEN 1 ELSE 0 END",
    37: "CASE WHEN b % 47 = 0 THEN 1 ELSE 0 END",
    2: "b % 4 + CASE WHEN b % 4 > 0 THEN (b {div} 11) % 3 ELSE 0 END",
    8: "0",
    12: "CASE WHEN (b {div} 5) % 4 >= 2 THEN 1 ELSE 0 END",
}

X4_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def x4_feature_exprs(div: str) -> list[str]:
    """39 feature expressions (double, named) over column ``b``."""
    out = []
    for fid, name in FEATURE_BY_ID.items():
        e = _X4_SPEC.get(fid, f"CASE WHEN b % {fid + 2} = 0 THEN 1 ELSE 0 END")
        out.append(f"CAST({e.format(div=div)} AS DOUBLE) AS {name}")
    return out


def x4_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature row per lineitem row: keys, b, 39 doubles, label, template key."""
    li = table(spark, sf_dir, "lineitem")
    base = li.select(*X4_KEYS, "l_returnflag", "l_linestatus",
                     F.expr(X4_B).alias("b"))
    return base.selectExpr(
        *X4_KEYS, "b", *x4_feature_exprs("div"),
        "l_returnflag || l_linestatus AS label",
        "CAST(l_partkey % 61 AS INT) AS template_key",
    )


def x4_sql() -> str:
    """The same rows for DuckDB, as a subquery body."""
    feats = ",\n  ".join(x4_feature_exprs("//"))
    keys = ", ".join(X4_KEYS)
    return (
        f"SELECT {keys}, b,\n  {feats},\n"
        "  l_returnflag || l_linestatus AS label,\n"
        "  CAST(l_partkey % 61 AS INT) AS template_key\n"
        f"FROM (SELECT *, {X4_B} AS b FROM lineitem) li"
    )


assert len(x4_feature_exprs("div")) == len(FEATURE_NAMES)


# ---------------------------------------------------------------- X1 -------
# Trace steps from `events`: run = user, order (ts, event_id); click -> call,
# purchase -> return, view/signup -> line, error -> exception. A line step
# prints its event type.
X1_CAP = 50
X1_TIME_LIMIT_S = 29.5 * 86400.0

_X1_EVENT = ("CASE event_type WHEN 'click' THEN 'call' WHEN 'purchase' THEN 'return' "
             "WHEN 'error' THEN 'exception' ELSE 'line' END")


def x1_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.selectExpr(
        "user_id AS run_id", "event_id AS seq", f"{_X1_EVENT} AS event",
        "'main' AS func_name", "CAST(event_id % 20 + 1 AS INT) AS line_number",
        "CASE WHEN event_type IN ('view', 'signup') THEN event_type || '\\n' END AS output",
        "ts",
    )


def x1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user; its code text only needs to be non-blank here."""
    ev = table(spark, sf_dir, "events")
    return ev.select("user_id").distinct().selectExpr(
        "user_id AS run_id", "'run_' || CAST(user_id AS STRING) AS code")


def x1_steps_sql() -> str:
    return (f"SELECT user_id AS run_id, event_id AS seq, {_X1_EVENT} AS event, "
            "'main' AS func_name, CAST(event_id % 20 + 1 AS INT) AS line_number, "
            "CASE WHEN event_type IN ('view', 'signup') THEN event_type || chr(10) END AS output, "
            "ts FROM events")


# The same steps with module frames (every 11th step, whose calls and returns do
# not count) and runs of every outcome. What a run carries besides its steps follows
# from its number: no code, no result, a syntax, policy or preparation error, or none.
X1B_FUNC = "CASE WHEN event_id % 11 = 0 THEN '<module>' ELSE 'main' END"
X1B_RUNS = {
    "code": "CASE WHEN user_id % 9 = 0 THEN ' ' || chr(10) ELSE 'run_' || user_id END",
    "no_result": "user_id % 9 = 1",
    "syntax_error": "CASE WHEN user_id % 9 = 2 THEN 'Syntax error at line ' || user_id END",
    "policy_error": "CASE WHEN user_id % 9 = 3 OR user_id % 9 = 2 THEN 'Use of a restricted name in run ' || user_id END",
    "prepare_error": "CASE WHEN user_id % 9 = 4 THEN 'cause ' || user_id END",
    "error": "CASE WHEN user_id % 9 = 5 AND user_id % 2 = 0 THEN 'ValueError: ' || user_id END",
}
X1B_CAP = 52
X1B_TIME_LIMIT_S = 29.4 * 86400.0


def x1b_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x1_steps(spark, sf_dir).withColumn("func_name", F.expr(X1B_FUNC.replace("event_id", "seq")))


def x1b_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct().selectExpr(
        "user_id AS run_id", *[f"{sql.replace('|| user_id', '|| CAST(user_id AS STRING)')} AS {name}" for name, sql in X1B_RUNS.items()])


# ---------------------------------------------------------------- X2 -------
# Operation lines from `events`: one step per event; the run's program is the
# twelve lines below and each step executes line event_id % 12 + 1. Locals are
# an ordered pair: a collection named by (event_id // 12) % 6 holding
# k .. k + k%26 - 1 (k = props.k), then a scalar `node` or `v` = 3k.
X2_LINES = [
    "        node = queue.popleft()",
    "        first = q.pop(0)",
    "        top = stack.pop()",
    "        result.append(stack.pop())",
    "        queue.append(42)",
    "        q.append('x')",
    "        frontier.append(node)",
    "        stack.append(1.5)",
    "        stk.push(v)",
    "        queued.append(1)",
    "    ",
    "        total = a + b",
]
X2_NAMES = ["queue", "stack", "result", "my_arr", "s", "other"]
X2_PROGRAM = "\n".join(X2_LINES) + "\n"


def _x2_name_expr(div: str) -> str:
    arr = ", ".join(f"'{n}'" for n in X2_NAMES)
    return f"[{arr}][CAST((event_id {div} 12) % 6 AS INT) + 1]"


def x2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("run_id")).distinct().withColumn(
        "code", F.lit(X2_PROGRAM))


def x2_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.array(*[F.lit(n) for n in X2_NAMES])
    name = F.element_at(names, F.expr("CAST((event_id div 12) % 6 AS INT) + 1"))
    n_items = k % 26
    items = F.when(n_items > 0, F.transform(F.sequence(k, k + n_items - 1),
                                            lambda x: x.cast("string"))) \
        .otherwise(F.array().cast("array<string>"))
    coll = F.struct(name.alias("name"),
                    F.when(name == "other", "tuple").otherwise("list").alias("kind"),
                    items.alias("items"),
                    F.lit(None).cast("string").alias("repr"))
    scalar = F.struct(F.when(F.col("event_id") % 2 == 0, "node").otherwise("v").alias("name"),
                      F.lit("int").alias("kind"),
                      F.lit(None).cast("array<string>").alias("items"),
                      (k * 3).cast("string").alias("repr"))
    return ev.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
        F.lit("line").alias("event"), F.lit("main").alias("func_name"),
        (F.col("event_id") % 12 + 1).cast("int").alias("line_number"),
        F.array(coll, scalar).alias("locals"),
        F.lit(None).cast("string").alias("output"), "ts")


def x2_steps_sql() -> str:
    """DuckDB: the same steps, with locals flattened into columns."""
    return f"""SELECT user_id AS run_id, event_id AS seq, CAST(event_id % 12 + 1 AS INT) AS line_number,
  {_x2_name_expr('//')} AS coll_name,
  CASE WHEN {_x2_name_expr('//')} = 'other' THEN 'tuple' ELSE 'list' END AS coll_kind,
  list_transform(range(k, k + k % 26), lambda x: CAST(x AS VARCHAR)) AS items,
  CASE WHEN event_id % 2 = 0 THEN 'node' ELSE 'v' END AS scalar_name,
  CAST(k * 3 AS VARCHAR) AS scalar_repr
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) e"""


# ---------------------------------------------------------------- X5 -------
# Predictions from `documents`: truth y, prediction pred, three-class
# probabilities from integer weights, folds by doc_id % 3.
_X5 = {
    "y": "CASE WHEN doc_id % 17 = 0 THEN 'xx' ELSE lang END",
    "pred": ("CASE WHEN doc_id % 7 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'de' "
             "WHEN doc_id % 13 = 0 THEN 'it' ELSE lang END"),
    "w1": "1 + (doc_id * 37) % 100",
    "w2": "1 + (doc_id * 53) % 100",
    "w3": "1 + (doc_id * 71) % 100",
    "fold": "CAST(doc_id % 3 AS INT)",
}


def x5_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    base = d.selectExpr("doc_id", *[f"{e} AS {k}" for k, e in _X5.items()])
    s = F.col("w1") + F.col("w2") + F.col("w3")
    return base.select("doc_id", "y", "pred", "fold",
                       F.array(*[(F.col(w) / s).cast("double") for w in ("w1", "w2", "w3")])
                       .alias("probability"))


def x5_sql() -> str:
    cols = ", ".join(f"{e} AS {k}" for k, e in _X5.items())
    return (f"SELECT doc_id, y, pred, fold, w1 / (w1 + w2 + w3) AS p1, w2 / (w1 + w2 + w3) AS p2, "
            f"w3 / (w1 + w2 + w3) AS p3 FROM (SELECT doc_id, {cols} FROM documents) d")


# X4 split key: a multiplicative hash of b spread over [0, 2^31 - 1).
X4_SPLIT_KEY = "((b % 2147483647) * 48271) % 2147483647"
X4_TIEBREAK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


# ---------------------------------------------------------------- X6 -------
def x6_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rendered snippet per document (template and variant from doc_id), its whole
    text a string constant in it: as many distinct snippets as distinct documents."""
    from snipflow.operators.corpus import corpus_from_ids
    return corpus_from_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), text_col="text")


# ---------------------------------------------------------------- X3 -------
# Synthetic preorder trees from `lineitem`: tree = l_orderkey mod n_trees,
# k = rank in the tree; dyadic numbering gives parent k & (k-1), subtree end
# min(n-1, k + lowbit(k) - 1), depth popcount(k). Calls name their callee.
X3_KINDS = ["For", "While", "If", "Return", "Call", "Name", "FunctionDef", "Attribute",
            "Import", "ImportFrom", "Assign", "Expr", "ClassDef"]
X3_NAMES = ["f", "g", "h", "open", "eval", "os", "sys.path", "collections", "heapq.heappush",
            "__class__", "x", "helper", "json"]
X3_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]


def x3_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window
    li = table(spark, sf_dir, "lineitem")
    # one number: the tree count scales with the table
    n_trees = max(li.count() // 100, 1)
    kinds = F.array(*[F.lit(k) for k in X3_KINDS])
    names = F.array(*[F.lit(n) for n in X3_NAMES])
    t = li.select(*X3_ORDER, (F.col("l_orderkey") % n_trees).alias("sample_id"))
    w = Window.partitionBy("sample_id").orderBy(*X3_ORDER)
    t = t.withColumn("k", (F.row_number().over(w) - 1).cast("int")) \
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sample_id")).cast("int"))
    k = F.col("k")
    low = k.bitwiseAND(-k)
    # ancestors of k: k with its lowest 1, 2, ... set bits cleared
    path = F.expr("array_sort(array_distinct(filter(transform(sequence(1, 31), "
                  "b -> shiftleft(shiftright(k, b), b)), a -> a < k)))")
    from snipflow.operators.parse import conform
    base = t.select(
        "sample_id", k.alias("node_id"),
        F.when(k > 0, k.bitwiseAND(k - 1)).cast("int").alias("parent_id"),
        F.when(k == 0, F.col("n") - 1).otherwise(F.least(F.col("n") - 1, k + low - 1)).cast("int")
        .alias("end_id"),
        F.bit_count(k).cast("int").alias("depth"),
        F.when(k > 0, F.lit("body")).alias("field"),
        F.when(k == 0, F.lit("Module"))
        .otherwise(F.element_at(kinds, (F.col("l_partkey") % len(X3_KINDS)).cast("int") + 1)).alias("kind"),
        F.when(k > 0, F.element_at(names, (F.col("l_suppkey") % len(X3_NAMES)).cast("int") + 1))
        .alias("name"),
        path.alias("path"),
        F.array_repeat(F.lit("body"), F.size(path)).alias("path_fields"),
    )
    # ancestor kinds and definition names: each tree (about 100 nodes by
    # construction) lists its nodes once in the same window partition, and a
    # path maps through that list — no join
    whole = (Window.partitionBy("sample_id").orderBy("node_id")
             .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kinds = F.collect_list("kind").over(whole)        # index = node_id (0..n-1)
    dnames = F.collect_list(F.when(F.col("kind").isin("FunctionDef", "ClassDef"), F.col("name"))
                            .otherwise(F.lit(""))).over(whole)
    out = base.withColumn("_k", kinds).withColumn("_n", dnames).select(
        *base.columns,
        F.transform("path", lambda a: F.element_at("_k", a + 1)).alias("path_kinds"),
        F.transform("path", lambda a: F.nullif(F.element_at("_n", a + 1), F.lit(""))).alias("path_names"))
    return conform(out)


def x3_sql(n_trees_expr: str = "greatest(count(*) OVER () // 100, 1)") -> str:
    kinds = ", ".join(f"'{k}'" for k in X3_KINDS)
    names = ", ".join(f"'{n}'" for n in X3_NAMES)
    order = ", ".join(X3_ORDER)
    return f"""SELECT sample_id, k AS node_id,
  CASE WHEN k > 0 THEN k & (k - 1) END AS parent_id,
  CASE WHEN k = 0 THEN n - 1 ELSE least(n - 1, k + (k & -k) - 1) END AS end_id,
  bit_count(k) AS depth,
  CASE WHEN k = 0 THEN 'Module' ELSE [{kinds}][CAST(l_partkey % {len(X3_KINDS)} AS INT) + 1] END AS kind,
  CASE WHEN k > 0 THEN [{names}][CAST(l_suppkey % {len(X3_NAMES)} AS INT) + 1] END AS name
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY {order}) - 1 AS INT) AS k,
             CAST(count(*) OVER (PARTITION BY sample_id) AS INT) AS n
      FROM (SELECT *, l_orderkey % {n_trees_expr} AS sample_id FROM lineitem) a) b"""
