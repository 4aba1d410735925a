"""T19 + T15 + A7 on a stream: kept steps with call depth, and a status row per run.

Steps may come out of order and more than once. A step sent again is dropped by
(run, seq) within the watermark. Every other step waits in its run's list state until
the watermark has passed it; then the steps that are due are applied in order (event
time, then seq) and go out once, with the numbers that the batch job gives them. A run
that stays idle for ``idle_s`` of event time beyond its last step is over: a timer
emits its status row and removes its state, so state holds open runs only.

State per run: the waiting steps, and one row with the depth after the last applied
step, the numbers of kept steps, the run's span and its output. A call of the state from
Python is a round trip, so runs share state in ``buckets`` (``RunsProcessor``): a few calls
per bucket and batch, however many runs it holds; one bucket at a time is in memory. The
restart of a stopped
query goes on from its checkpoint; the file sink's log makes each output row appear once.
Steps that come later than the watermark are dropped by Spark and counted in the
query's progress (``numRowsDroppedByWatermark``). A run that goes on after its status
row starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from snipflow.functions.text import py_strip
from snipflow.operators.trace import (MAX_STEPS, MODULE_FRAME, MSG_TIMEOUT, MSG_TRUNCATED, TIMEOUT_SECONDS)

OUT_SCHEMA = ("run_id long, kind string, seq long, step_no int, event string, line_number int, call_depth int, "
              "status string, error string, step_count long, max_depth int, final_output string, duration_s double")
PENDING_SCHEMA = "us long, seq long, event string, func_name string, line_number int, output string"
RUN_SCHEMA = ("depth long, n long, truncated boolean, max_depth int, first_us long, last_us long, "
              "last_event string, last_line int, output string")
_OUT_COLUMNS = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
_OUT = Row(*_OUT_COLUMNS)
BUCKETS_EACH = 16               # of a state partition; a bucket of more than some KB costs 40 ms a batch on the way to Python
_PENDING = ["us", "seq", "event", "func_name", "line_number", "output"]
# of a bucket: when something is due next, and its waiting steps and open runs (Arrow)
BUCKET_SCHEMA = "timer long, steps binary, runs binary"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
_STEPS, _RUNS = (pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in f"run_id long, {ddl}".split(", "))])
                 for ddl in (PENDING_SCHEMA, RUN_SCHEMA))
_NUMBERS = [f.name for f in _STEPS if f.type != pa.string()]


class RunProcessor(StatefulProcessor):
    def __init__(self, cap: int, idle_ms: int, time_limit_s: float):
        self.cap, self.idle_ms, self.time_limit_s = cap, idle_ms, time_limit_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING_SCHEMA)
        self.run = handle.getValueState("run", RUN_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        got = [tuple(r[c] for c in _PENDING) for r in rows]
        if got:
            self.pending.appendList(got)
            self.handle.registerTimer(max(r[0] for r in got) // 1000 + 1)      # the first millisecond at which it is due
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.pending.get()]
        due = sorted(r for r in waiting if r[0] <= now * 1000)
        rest = [r for r in waiting if r[0] > now * 1000]
        had = run = self.run.get()
        out = []
        if due:
            if rest:
                self.pending.put(rest)
            else:
                self.pending.clear()
            rows, run = self._apply(key, due, run)
            out += rows
        if not rest and run is not None:
            over = run[5] // 1000 + self.idle_ms
            if now > over:
                out.append(self._status(key, run))
                if had is not None:
                    self.run.clear()
                return iter(out)
            self.handle.registerTimer(over + 1)
        if due:
            self.run.update(run)
        return iter(out)

    def close(self) -> None:
        pass

    def _apply(self, key, due, run) -> tuple[list[Row], tuple]:
        state = tuple(run) if run is not None else (0, 0, False, 0, due[0][0], due[0][0], None, None, "")
        depth, n, truncated, max_depth, first, last, last_event, last_line, output = state
        last = max(last, due[-1][0])
        for r in due:
            if r[2] != "return":
                last_event, last_line = r[2], r[4]
        kept = [r for r in due if r[2] in ("call", "line", "return")
                and not (r[3] == MODULE_FRAME and r[2] in ("call", "return"))]
        room = self.cap - n
        truncated = truncated or len(kept) > room
        kept = kept[:room]
        out = []
        for r in kept:
            # a return leaves a call, but never goes below the module
            depth += r[2] == "call"
            n += 1
            out.append(_row(key, "step", seq=r[1], step_no=n, event=r[2], line_number=r[4], call_depth=depth))
            max_depth = max(max_depth, depth)
            depth = max(depth - (r[2] == "return"), 0)
        output += "".join(r[5] or "" for r in kept)
        return out, (depth, n, bool(truncated), max_depth, first, last, last_event, last_line, output)

    def _status(self, key, run) -> Row:
        _, n, truncated, max_depth, first, last, last_event, last_line, output = run
        duration = (last - first) / 1e6
        if duration > self.time_limit_s:
            status, error, n, max_depth, output = "timed_out", MSG_TIMEOUT, 0, 0, ""
        elif truncated:
            status, error = "truncated", MSG_TRUNCATED.format(cap=self.cap)
        elif last_event == "exception":
            status, error = "runtime_error", f"Exception raised at line {last_line}"
        else:
            status, error = "ok", None
        return _row(key, "status", status=status, error=error, step_count=n, max_depth=max_depth, final_output=output,
                    duration_s=round(duration, 6))


def _without_nulls(steps: DataFrame, key: Column) -> DataFrame:
    """``key``, the columns of ``_STEPS`` with 0 for numbers that are null, and ``nulls``:
    which they are. pandas would make floats of such columns."""
    nulls = sum((F.when(F.col(c).isNull(), 1 << k).otherwise(0) for k, c in enumerate(_NUMBERS)), F.lit(0))
    return steps.select(key, *[F.coalesce(c, F.lit(0)).alias(c) if c in _NUMBERS else F.col(c) for c in _STEPS.names],
                        nulls.alias("nulls"))


def _steps(frame: pd.DataFrame) -> pa.Table:
    nulls = frame["nulls"].to_numpy()
    if (nulls >> _NUMBERS.index("us") & 1).any():
        raise ValueError("a step without a time")
    return pa.table([pa.array(frame[f.name].to_numpy(), f.type, mask=(nulls >> _NUMBERS.index(f.name) & 1).astype(bool))
                     if f.name in _NUMBERS else pa.array(frame[f.name], f.type, from_pandas=True) for f in _STEPS], schema=_STEPS)


def _frames(rows: list[Row]) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(_OUT_COLUMNS, zip(*rows))})


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows(table: pa.Table) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in table.columns))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class RunsProcessor(RunProcessor):
    """The same for all runs of a bucket at once, in pandas frames with the columns of
    ``_STEPS`` and ``nulls`` (see ``_without_nulls``).

    What the watermark has passed goes out when the bucket is next touched: with new
    steps, or by its one timer, set to the first millisecond at which a step is due or a
    run is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", BUCKET_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        return self._advance([_steps(frame) for frame in rows], timerValues.getCurrentWatermarkInMs(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance([], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, got: list[pa.Table], now: int, fired: int | None) -> Iterator[pd.DataFrame]:
        held = self.bucket.get()
        timer, steps, runs = tuple(held) if held is not None else (None, None, None)
        if fired is not None and fired != timer:
            return iter([])                             # replaced by an earlier one
        waiting = pa.concat_tables([*([_unpacked(steps)] if steps is not None else []), *got])
        late = pc.less_equal(waiting["us"], now * 1000)
        due = waiting.filter(late).sort_by([("us", "ascending"), ("seq", "ascending")])
        rest = waiting.filter(pc.invert(late))
        of_run: dict[int, list] = {}
        for r in _rows(due):
            of_run.setdefault(r[0], []).append(r[1:])
        state = {r[0]: r[1:] for r in _rows(_unpacked(runs))} if runs is not None else {}
        out = []
        for run_id, these in of_run.items():
            rows, state[run_id] = self._apply((run_id,), these, state.get(run_id))
            out += rows
        next_due = pc.min(rest["us"]).as_py()
        times = [next_due // 1000 + 1] if next_due is not None else []
        for run_id in state.keys() - set(pc.unique(rest["run_id"]).to_pylist()):
            over = state[run_id][5] // 1000 + self.idle_ms
            if now > over:
                out.append(self._status((run_id,), state.pop(run_id)))
            else:
                times.append(over + 1)
        again = min(times, default=None)
        if timer is not None and timer not in (again, fired):
            self.handle.deleteTimer(timer)
        if again is None:
            if held is not None:
                self.bucket.clear()
            return _frames(out)
        if again != timer:
            self.handle.registerTimer(again)
        if out or of_run:
            runs = _packed(_table([(k, *v) for k, v in state.items()], _RUNS))
        self.bucket.update((again, _packed(rest), runs))
        return _frames(out)


def _row(key, kind: str, **values) -> Row:
    return _OUT(key[0], kind, *[values.get(c) for c in _OUT_COLUMNS[2:]])


def run_stream(steps: DataFrame, cap: int = MAX_STEPS, idle_s: float = 60.0, time_limit_s: float = TIMEOUT_SECONDS,
               watermark: str = "10 minutes", buckets: int = 0) -> DataFrame:
    """Streaming step records (run_id, seq, event, func_name, line_number, output, ts) to
    rows of two kinds: ``step`` (seq, step_no, event, line_number, call_depth) and
    ``status`` (status, error, step_count, max_depth, final_output, duration_s).
    ``buckets``: in how many parts runs share state (fixed for the life of a checkpoint);
    0: each run has its own."""
    sel = steps.select("run_id", "seq", "event", "func_name", "line_number", "output", F.col("ts").cast("timestamp").alias("ts"))
    sel = sel.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["run_id", "seq"])
    sel = sel.withColumn("us", F.unix_micros("ts"))
    options = cap, int(idle_s * 1000), time_limit_s
    if buckets:
        sel = _without_nulls(sel, F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket"))
        out = sel.groupBy("bucket").transformWithStateInPandas(RunsProcessor(*options), OUT_SCHEMA, "append", "eventtime")
    else:
        out = sel.groupBy("run_id").transformWithState(RunProcessor(*options), OUT_SCHEMA, "append", "eventtime")
    return out.withColumn("final_output", py_strip(F.col("final_output")))


@contextmanager
def state_conf(spark: SparkSession, partitions: int):
    """RocksDB state, in ``partitions`` parts (fixed for the life of a checkpoint)."""
    want = {"spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.shuffle.partitions": str(partitions)}
    had = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_runs(steps: DataFrame, out: str, checkpoint: str, state_partitions: int = 200, **options) -> None:
    """Work off what is there (steps -> ``out``, one folder of Parquet for both kinds) and
    stop; called again with the same checkpoint it goes on where it stopped."""
    spark = steps.sparkSession
    options.setdefault("buckets", BUCKETS_EACH * state_partitions)
    with state_conf(spark, state_partitions):
        query = (run_stream(steps, **options).writeStream.format("parquet").outputMode("append")
                 .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
