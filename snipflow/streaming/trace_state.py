"""T1-T3 on a stream of step records, with per-run state.

State per run: last applied ``seq``, the floored call depth after it, steps
kept so far and the truncation flag. Each micro-batch of a run is sorted by
``seq``; the depth walk is vectorised (reflected cumulative sum from the
stored depth), and rows at or below the last applied ``seq`` go out flagged
``late`` instead of being applied. A run that passes its cap gets one closing
row (event ``truncated``, step_no ``cap + 1``, the first step left out), also
when its kept steps went out in earlier micro-batches. A run's state is dropped by an event-time
timer once the watermark passes its last step plus ``idle_ms`` (the run's
time limit), so state does not grow with the number of runs ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from snipflow.operators.trace import MAX_STEPS, MODULE_FRAME

TRUNCATED = "truncated"
OUT_SCHEMA = ("run_id long, seq long, step_no long, event string, line_number int, "
              "call_depth int, truncated boolean, late boolean")
STATE_SCHEMA = "last_seq long, depth long, n long, truncated boolean, last_ts_ms long"


def _step_fn(cap: int, idle_ms: int):
    cols = ["run_id", "seq", "step_no", "event", "line_number", "call_depth", "truncated", "late"]

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_seq, depth, n, trunc, last_ts = (state.get if state.exists
                                              else (-(2**62), 0, 0, False, -(2**62)))
        df = pd.concat(list(pdfs), ignore_index=True)
        if len(df):
            last_ts = max(last_ts, int(df["ts"].astype("int64").max() // 1_000_000))
        keep = df["event"].isin(["call", "line", "return"]) & ~(
            (df["func_name"] == MODULE_FRAME) & df["event"].isin(["call", "return"]))
        df = df[keep].sort_values("seq", kind="stable")
        late = df[df["seq"] <= last_seq]
        fresh = df[df["seq"] > last_seq]
        out = []
        if len(late):
            out.append(pd.DataFrame({
                "run_id": late["run_id"].to_numpy(), "seq": late["seq"].to_numpy(),
                "step_no": np.full(len(late), -1), "event": late["event"].to_numpy(),
                "line_number": late["line_number"].to_numpy(), "call_depth": np.full(len(late), -1),
                "truncated": np.full(len(late), trunc), "late": np.full(len(late), True)}))
        if len(fresh) and not trunc:
            ev = fresh["event"].to_numpy()
            delta = np.where(ev == "call", 1, np.where(ev == "return", -1, 0))
            s = depth + np.cumsum(delta)
            post = s - np.minimum(0, np.minimum.accumulate(s))
            prev = np.concatenate([[depth], post[:-1]])
            shown = prev + (ev == "call")
            room = max(cap - n, 0)
            take = min(room, len(fresh))
            trunc = len(fresh) > room
            if take:
                out.append(pd.DataFrame({
                    "run_id": fresh["run_id"].to_numpy()[:take], "seq": fresh["seq"].to_numpy()[:take],
                    "step_no": np.arange(n + 1, n + take + 1), "event": ev[:take],
                    "line_number": fresh["line_number"].to_numpy()[:take],
                    "call_depth": shown[:take].astype("int32"),
                    "truncated": np.full(take, trunc), "late": np.full(take, False)}))
                n += take
                depth = int(post[take - 1])
            if trunc:
                over = fresh.iloc[take]
                out.append(pd.DataFrame({
                    "run_id": [over["run_id"]], "seq": [over["seq"]], "step_no": [cap + 1],
                    "event": [TRUNCATED], "line_number": [over["line_number"]],
                    "call_depth": np.array([-1], "int32"), "truncated": [True], "late": [False]}))
            last_seq = int(fresh["seq"].to_numpy()[-1])
        elif len(fresh):
            last_seq = int(fresh["seq"].to_numpy()[-1])
        state.update((last_seq, depth, n, trunc, last_ts))
        state.setTimeoutTimestamp(max(last_ts + idle_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.concat(out, ignore_index=True)[cols]

    return fn


def traced_stream(steps: DataFrame, cap: int = MAX_STEPS, idle_ms: int = 5_000,
                  watermark: str = "10 minutes") -> DataFrame:
    """Streaming step records -> kept steps with depth, one state per run.

    ``ts`` drives the watermark; a run idle for ``idle_ms`` of event time past
    the watermark is closed and its state removed.
    """
    sel = (steps.withColumn("ts", steps["ts"].cast("timestamp")).withWatermark("ts", watermark)
           .select("run_id", "seq", "event", "func_name", "line_number", "ts"))
    return sel.groupBy("run_id").applyInPandasWithState(
        _step_fn(cap, idle_ms), OUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)
