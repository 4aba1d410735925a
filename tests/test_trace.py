import datetime as dt

from pyspark.sql import functions as F

from conftest import SF01
from snipflow.operators import trace
from snipflow.sources import fixtures as fx

T0 = dt.datetime(2024, 1, 1)


def _steps(spark, events, run_id=1, func="f"):
    rows = [(run_id, i, e, f if isinstance(f, str) else func, 1 + i % 5, None, None,
             T0 + dt.timedelta(seconds=i))
            for i, (e, f) in enumerate((e, func) if isinstance(e, str) else e for e in events)]
    return spark.createDataFrame(rows, "run_id long, seq long, event string, func_name string, "
                                       "line_number int, locals array<struct<name:string,kind:string,"
                                       "items:array<string>,repr:string>>, output string, ts timestamp_ntz")


def reference_walk(events):
    """The step-by-step state machine, for comparison."""
    d, out = 0, []
    for e in events:
        if e == "call":
            d += 1
        out.append(d)
        if e == "return":
            d = max(0, d - 1)
    return out


def test_depth_floor_and_call(spark):
    ev = ["return", "return", "call", "line", "call", "return", "return", "return", "line", "call"]
    got = [r["call_depth"] for r in trace.traced_steps(_steps(spark, ev), 100).orderBy("seq").collect()]
    assert got == reference_walk(ev)


def test_module_frames_and_exceptions_dropped(spark):
    ev = [("call", "<module>"), ("line", "<module>"), ("call", "f"), ("exception", "f"),
          ("return", "f"), ("return", "<module>")]
    got = trace.traced_steps(_steps(spark, ev), 100).orderBy("seq").collect()
    assert [(r["event"], r["call_depth"]) for r in got] == [("line", 0), ("call", 1), ("return", 1)]


def test_cap_exact_is_not_truncated(spark):
    runs = spark.createDataFrame([(1, "x = 1")], "run_id long, code string")
    st = trace.run_status(runs, _steps(spark, ["line"] * 5), cap=5, time_limit_s=1e9).collect()[0]
    assert st["status"] == "ok" and st["step_count"] == 5
    st = trace.run_status(runs, _steps(spark, ["line"] * 6), cap=5, time_limit_s=1e9).collect()[0]
    assert st["status"] == "truncated" and st["step_count"] == 5
    assert st["error"] == "Trace truncated at 5 steps (execution may be long-running)."


def test_status_precedence(spark):
    runs = spark.createDataFrame([(1, "  "), (2, "x"), (3, "x")], "run_id long, code string")
    runs = runs.withColumn("syntax_error", F.when(F.col("run_id") == 3, F.lit("Syntax error on line 1: x")))
    steps = _steps(spark, ["line"] * 3, 1).unionByName(_steps(spark, ["line"] * 3, 2)) \
        .unionByName(_steps(spark, ["line"] * 3, 3))
    st = {r["run_id"]: r for r in trace.run_status(runs, steps, cap=10, time_limit_s=1.5).collect()}
    assert st[1]["status"] == "empty" and st[1]["error"] == "`code` field is empty."
    assert st[2]["status"] == "timed_out" and st[2]["step_count"] == 0
    assert st[3]["status"] == "timed_out"
    st = {r["run_id"]: r for r in trace.run_status(runs, steps, cap=10, time_limit_s=100).collect()}
    assert st[3]["status"] == "syntax_error" and st[2]["status"] == "ok"


def test_x1_counts(spark):
    t = trace.traced_steps(fx.x1_steps(spark, SF01), fx.X1_CAP)
    assert t.count() == 7243
    st = trace.run_status(fx.x1_runs(spark, SF01), fx.x1_steps(spark, SF01), fx.X1_CAP, 1e12)
    assert st.where("status = 'truncated'").count() == 94


def test_crashed_run_ends_in_returns(spark):
    runs = spark.createDataFrame([(1, "x = 1")], "run_id long, code string")

    def status(events, runs=runs):
        return trace.run_status(runs, _steps(spark, events), cap=50, time_limit_s=1e9).collect()[0]

    assert status(["call", "call", "exception", "return", "exception", "return"])["status"] == "runtime_error"
    assert status(["call", "exception", "line", "return"])["status"] == "ok"
    told = spark.createDataFrame([(1, "x = 1", "ZeroDivisionError: division by zero")],
                                 "run_id long, code string, error string")
    st = status(["call", "line"], told)
    assert st["status"] == "runtime_error" and st["error"] == "ZeroDivisionError: division by zero"
    none = spark.createDataFrame([(1, "x = 1", None)], "run_id long, code string, error string")
    assert status(["call", "exception"], none)["status"] == "ok"
