"""Trace analytics (data half of J7): step records in, run-level facts out.

Steps arrive as a table (or stream) ``run_id, seq, event, func_name,
line_number, locals, output, ts``; ``seq`` orders steps within a run. All work
is windows and aggregates keyed by ``run_id``. The step cap is applied before
any other window: a rank filter that stands alone lets Spark plan a
``WindowGroupLimit`` on both sides of the shuffle, so a run with billions of
steps ships at most ``cap + 1`` rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snipflow.functions.text import is_blank, py_strip

# --- fixed values: limits and run messages ---------------------------------
MAX_STEPS = 500
MAX_REPR_LENGTH = 1000
TIMEOUT_SECONDS = 5.0
MSG_EMPTY = "`code` field is empty."
MSG_TIMEOUT = "Execution timed out - possible infinite loop"
MSG_NO_RESULT = "Execution failed before a trace result could be returned."
MSG_TRUNCATED = "Trace truncated at {cap} steps (execution may be long-running)."
MODULE_FRAME = "<module>"
# ---------------------------------------------------------------------------

SHOWN_STEPS = 12


def user_steps(steps: DataFrame) -> DataFrame:
    """Keep call/line/return; drop module-level call/return and exceptions."""
    ev = F.col("event")
    module = F.coalesce(F.col("func_name") == MODULE_FRAME, F.lit(False))
    return steps.where(ev.isin("call", "line", "return") & ~(module & ev.isin("call", "return")))


def cap_steps(steps: DataFrame, cap: int = MAX_STEPS) -> DataFrame:
    """The first ``cap + 1`` steps of each run with their rank ``step_no``.

    Rows with ``step_no <= cap`` are the kept trace; a row ranked ``cap + 1``
    only marks the run as truncated (exactly ``cap`` steps is not truncated).
    """
    w = Window.partitionBy("run_id").orderBy("seq")
    return (steps.withColumn("step_no", F.row_number().over(w))
            .where(F.col("step_no") <= cap + 1))


def call_depth(capped: DataFrame) -> DataFrame:
    """Depth shown with each step.

    A call counts itself, a return shows the depth before it pops, and the
    depth never goes below 0. With S the running sum of +1 (call) / -1
    (return), the floored depth after a step is S - least(0, running min S)
    (a reflected walk); the shown depth is the previous post-step depth, plus
    one on a call. One sort per run, no per-row state.
    """
    w = Window.partitionBy("run_id").orderBy("step_no")
    w_run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    delta = (F.when(F.col("event") == "call", 1)
             .when(F.col("event") == "return", -1).otherwise(0))
    s = F.sum(delta).over(w_run)
    out = capped.withColumn("_s", s)
    out = out.withColumn("_post", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w_run)))
    shown = (F.coalesce(F.lag("_post").over(w), F.lit(0))
             + F.when(F.col("event") == "call", 1).otherwise(0))
    return out.withColumn("call_depth", shown.cast("int")).drop("_s", "_post")


def traced_steps(steps: DataFrame, cap: int = MAX_STEPS) -> DataFrame:
    """T1 + T3 + T2: the kept steps (``step_no <= cap``) with call depth."""
    return call_depth(cap_steps(user_steps(steps), cap)).where(F.col("step_no") <= cap)


def _opt(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def run_status(runs: DataFrame, steps: DataFrame, cap: int = MAX_STEPS,
               time_limit_s: float = TIMEOUT_SECONDS, capped: DataFrame | None = None) -> DataFrame:
    """T15 + T16: one row per run with status, error text, steps kept, output.

    ``runs`` has ``run_id, code`` and may carry screening results
    (``syntax_error``, ``policy_error``, ``prepare_error`` texts, ``no_result``
    flag) and the run's own ``error`` text. Without such a column a run counts as
    failed if nothing but returns follows its last exception: a trace emits a
    return for every frame that the exception leaves. Precedence: empty, timed out, no result, syntax error, policy
    error, could not prepare, truncated, runtime error, ok. A timed-out or
    unprepared run keeps no steps and no output.
    """
    # Whole-run facts: partial aggregation, one row per run per map task.
    span = steps.groupBy("run_id").agg(
        ((F.max(F.unix_micros(F.col("ts").cast("timestamp")))
          - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 1e6).alias("duration_s"),
        F.max_by(F.struct("event", "line_number"), F.when(F.col("event") != "return", F.col("seq"))).alias("_last"),
    )
    if capped is None:
        capped = call_depth(cap_steps(user_steps(steps), cap))
    kept = F.col("step_no") <= cap
    per_run = capped.groupBy("run_id").agg(
        F.count(F.when(kept, 1)).alias("n_steps"),
        (F.max("step_no") > cap).alias("truncated"),
        F.max(F.when(kept, F.col("call_depth"))).alias("max_depth"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(kept & F.col("output").isNotNull(),
                                               F.struct("step_no", "output")))),
            lambda x: x["output"]), "").alias("_out"),
    )
    r = runs.join(span, "run_id", "left").join(per_run, "run_id", "left")
    code = F.col("code")
    blank = is_blank(code)
    syntax = _opt(r, "syntax_error", F.lit(None).cast("string"))
    policy = _opt(r, "policy_error", F.lit(None).cast("string"))
    prepare = _opt(r, "prepare_error", F.lit(None).cast("string"))
    no_result = _opt(r, "no_result", F.lit(False))
    timed_out = F.coalesce(F.col("duration_s") > F.lit(time_limit_s), F.lit(False))
    truncated = F.coalesce(F.col("truncated"), F.lit(False))
    own_error = _opt(r, "error", F.lit(None).cast("string"))
    raised = (own_error.isNotNull() if "error" in r.columns
              else F.coalesce(F.col("_last.event") == "exception", F.lit(False)))
    status = (F.when(blank, "empty").when(timed_out, "timed_out")
              .when(no_result, "no_result").when(syntax.isNotNull(), "syntax_error")
              .when(policy.isNotNull(), "policy_error").when(prepare.isNotNull(), "prepare_error")
              .when(truncated, "truncated").when(raised, "runtime_error").otherwise("ok"))
    error = (F.when(status == "empty", MSG_EMPTY).when(status == "timed_out", MSG_TIMEOUT)
             .when(status == "no_result", MSG_NO_RESULT)
             .when(status == "syntax_error", syntax).when(status == "policy_error", policy)
             .when(status == "prepare_error", F.concat(F.lit("Could not prepare code: "), prepare))
             .when(status == "truncated", MSG_TRUNCATED.format(cap=cap))
             .when(status == "runtime_error",
                   F.coalesce(own_error, F.concat(F.lit("Exception raised at line "),
                                                  F.col("_last.line_number").cast("string")))))
    has_steps = status.isin("truncated", "runtime_error", "ok")
    return r.select(
        "run_id",
        status.alias("status"),
        error.alias("error"),
        F.when(has_steps, F.coalesce(F.col("n_steps"), F.lit(0))).otherwise(0)
        .cast("long").alias("step_count"),
        F.when(has_steps, F.coalesce(F.col("max_depth"), F.lit(0))).otherwise(0)
        .cast("int").alias("max_depth"),
        F.when(has_steps, py_strip(F.coalesce(F.col("_out"), F.lit("")))).otherwise("")
        .alias("final_output"),
        F.round("duration_s", 6).alias("duration_s"),
    )


def run_summary(runs: DataFrame, steps: DataFrame, cap: int = MAX_STEPS,
                time_limit_s: float = TIMEOUT_SECONDS, shown: int = SHOWN_STEPS) -> DataFrame:
    """Status + the first ``shown`` steps in compact form + "... N more steps"."""
    # one capped walk feeds both the status and the first steps
    capped = call_depth(cap_steps(user_steps(steps), cap))
    st = run_status(runs, steps, cap, time_limit_s, capped=capped)
    first = (capped.where(F.col("step_no") <= shown)
             .groupBy("run_id").agg(F.array_join(F.transform(
                 F.array_sort(F.collect_list(F.struct(
                     "step_no", F.concat_ws(":", "event", F.col("line_number").cast("string"),
                                            F.col("call_depth").cast("string")).alias("c")))),
                 lambda x: x["c"]), " | ").alias("_first")))
    out = st.join(first, "run_id", "left")
    has = F.col("step_count") > 0
    return out.select(
        "run_id", "status", "error", "step_count", "final_output",
        F.when(has, F.col("_first")).otherwise("").alias("first_steps"),
        F.when(F.col("step_count") > shown,
               F.concat(F.lit("... "), (F.col("step_count") - shown).cast("string"),
                        F.lit(" more steps"))).alias("more"),
    )


def hot_lines(steps: DataFrame, cap: int = MAX_STEPS) -> DataFrame:
    """Executions per (run, line) among the kept steps, with the line's rank."""
    t = traced_steps(steps, cap)
    c = t.groupBy("run_id", "line_number").agg(F.count(F.lit(1)).alias("hits"),
                                               F.max("call_depth").alias("max_depth"))
    w = Window.partitionBy("run_id").orderBy(F.desc("hits"), "line_number")
    return c.withColumn("line_rank", F.rank().over(w))
