import os

from pyspark.sql import functions as F

from conftest import SF01
from snipflow.operators import trace
from snipflow.sources import fixtures as fx
from snipflow.streaming.trace_state import traced_stream


def test_stream_equals_batch(spark, tmp_path):
    d = str(tmp_path)
    steps = fx.x1_steps(spark, SF01)
    steps.withColumn("part", (F.col("seq") * 4 / 10000).cast("int")) \
        .write.mode("overwrite").partitionBy("part").parquet(os.path.join(d, "steps"))
    sch = spark.read.parquet(os.path.join(d, "steps")).drop("part").schema
    src = spark.readStream.schema(sch).option("maxFilesPerTrigger", 2).parquet(os.path.join(d, "steps", "part=*"))
    q = (traced_stream(src, cap=fx.X1_CAP, idle_ms=int(fx.X1_TIME_LIMIT_S * 1000))
         .writeStream.format("memory").queryName("t19").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    cols = ["run_id", "seq", "step_no", "event", "line_number", "call_depth"]
    out = spark.table("t19").where("not late")
    got = out.where("event <> 'truncated'").select(cols)
    want = trace.traced_steps(steps, fx.X1_CAP).select(cols)
    assert got.count() == want.count() == 7243
    assert got.exceptAll(want).count() == 0
    # one closing row per run with more user steps than the cap
    over = trace.user_steps(steps).groupBy("run_id").count().where(F.col("count") > fx.X1_CAP).select("run_id")
    closed = out.where("event = 'truncated'").select("run_id")
    assert closed.count() == over.count() and closed.exceptAll(over).count() == 0


def test_stream_truncation_at_batch_edge(spark, tmp_path):
    import datetime as dt
    d = str(tmp_path)
    sch = ("run_id long, seq long, event string, func_name string, line_number int, "
           "locals array<struct<name:string,kind:string,items:array<string>,repr:string>>, "
           "output string, ts timestamp_ntz")
    t0 = dt.datetime(2024, 1, 1)
    for k, seqs in enumerate(([1, 2, 3], [4, 5], [6])):
        spark.createDataFrame([(1, s, "line", "f", s, None, None, t0 + dt.timedelta(seconds=s)) for s in seqs], sch) \
            .coalesce(1).write.parquet(os.path.join(d, "in", f"b{k}"))
    src = spark.readStream.schema(sch).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "in", "*"))
    q = (traced_stream(src, cap=3, idle_ms=3_600_000)
         .writeStream.format("memory").queryName("t19edge").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    out = [(r["seq"], r["step_no"], r["event"]) for r in spark.table("t19edge").orderBy("seq").collect()]
    assert out == [(1, 1, "line"), (2, 2, "line"), (3, 3, "line"), (4, 4, "truncated")]


def test_score_stream(spark, tmp_path):
    from snipflow.operators import corpus, features, model
    from snipflow.streaming.score_stream import start
    good, _ = features.build_features(corpus.generate(spark))
    m = model.fit(good, num_trees=5)
    d = str(tmp_path)
    inp = os.path.join(d, "in")
    spark.createDataFrame([("s1", "x = 1\n", None), ("s2", "", None)],
                          "sub_id string, code string, entry_call string").write.json(inp)
    q = start(spark, inp, os.path.join(d, "out"), os.path.join(d, "ck"), m)
    q.awaitTermination()
    out = {r["sub_id"]: r for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    assert out["s1"]["status"] == "ok" and out["s2"]["status"] == "empty"


def test_stream_late_steps(spark, tmp_path):
    import datetime as dt
    d = str(tmp_path)
    sch = ("run_id long, seq long, event string, func_name string, line_number int, "
           "locals array<struct<name:string,kind:string,items:array<string>,repr:string>>, "
           "output string, ts timestamp_ntz")
    t0 = dt.datetime(2024, 1, 1)

    def rows(seqs, events):
        return [(1, s, e, "f", 1, None, None, t0 + dt.timedelta(seconds=s)) for s, e in zip(seqs, events)]

    spark.createDataFrame(rows([10, 11, 12, 13, 14], ["call", "call", "line", "return", "line"]), sch) \
        .coalesce(1).write.parquet(os.path.join(d, "in", "b1"))
    spark.createDataFrame(rows([5, 6, 15, 16], ["call", "line", "call", "line"]), sch) \
        .coalesce(1).write.parquet(os.path.join(d, "in", "b2"))
    src = spark.readStream.schema(sch).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "in", "*"))
    q = (traced_stream(src, cap=100, idle_ms=3_600_000)
         .writeStream.format("memory").queryName("t19late").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.table("t19late").orderBy("late", "seq").collect()
    late = [r["seq"] for r in out if r["late"]]
    kept = [(r["seq"], r["step_no"], r["call_depth"]) for r in out if not r["late"]]
    assert late == [5, 6]
    # depth continues across micro-batches: 1, 2, 2, 2 (return shows pre-pop), 1, then call -> 2
    assert kept == [(10, 1, 1), (11, 2, 2), (12, 3, 2), (13, 4, 2), (14, 5, 1), (15, 6, 2), (16, 7, 2)]


def test_score_stream_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    import pytest
    from snipflow.operators import corpus, features, model, scoring
    from snipflow.session import checkpoint_dir
    from snipflow.streaming import score_stream
    good, _ = features.build_features(corpus.generate(spark))
    m = model.fit(good, num_trees=5)
    d = str(tmp_path)
    inp = os.path.join(d, "in")
    codes = [r["code"] for r in corpus.generate(spark).limit(40).collect()] + ["", "def (", "x = 1\n"]
    subs = spark.createDataFrame([(f"s{i}", c, None) for i, c in enumerate(codes)], "sub_id string, code string, entry_call string")
    subs.repartition(4, "sub_id").write.json(inp)

    def left():
        root = checkpoint_dir(spark).removeprefix("file://")
        return {x for x in os.listdir(root) if x.startswith(("nodes", "stage", "wide", "feat"))}

    before, calls = left(), []

    def failing(batch, fitted):
        calls.append(1)
        out = scoring.analyse(batch, fitted)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return out

    monkeypatch.setattr(score_stream, "analyse", failing)
    with pytest.raises(Exception, match="lost"):
        score_stream.start(spark, inp, os.path.join(d, "out"), os.path.join(d, "ck"), m, max_files=1).awaitTermination()
    score_stream.start(spark, inp, os.path.join(d, "out"), os.path.join(d, "ck"), m, max_files=1).awaitTermination()
    assert left() == before
    out = spark.read.parquet(os.path.join(d, "out"))
    assert out.select("batch_id").distinct().count() >= 4
    cols = ["sub_id", "status", "detail", "algorithm", "confidence", "complexity", "features"]
    want = scoring.analyse(subs, m).withColumn("complexity", F.to_json("complexity")).withColumn("features", F.to_json("features"))
    assert sorted(map(str, out.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_run_processor_asks_the_state_seldom():
    """One due step costs five calls of the state server, each a round trip (nine before)."""
    from snipflow.streaming.run_state import RunProcessor

    class State:
        calls, held = [], None

        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            def act(*args):
                State.calls.append(f"{self.name}.{call}")
                return [(1_000, 1, "call", "f", 3, None)] if (self.name, call) == ("pending", "get") else None if call == "get" else True
            return act

    class Handle(State):
        def getListState(self, *_):
            return State("pending")

        def getValueState(self, *_):
            return State("run")

    class Now:
        def getCurrentWatermarkInMs(self):
            return 10

    p = RunProcessor(50, 60_000, 10.0)
    p.init(Handle("handle"))
    out = list(p.handleExpiredTimer((7,), Now(), None))
    assert sorted(State.calls) == ["handle.registerTimer", "pending.clear", "pending.get", "run.get", "run.update"]
    assert [(r.run_id, r.kind, r.seq, r.step_no, r.call_depth) for r in out] == [(7, "step", 1, 1, 1)]


def _run_both(batches, cap=4, idle_ms=5_000, limit=8.0):
    """The rows of one processor per run and of one for all runs, batch by batch
    (watermark, steps), and the calls of the state that each took."""
    from collections import defaultdict

    import pandas as pd
    from pyspark.sql import Row

    from snipflow.streaming import run_state as rs
    calls = {"run": 0, "bucket": 0}

    class Value:
        held = None

        def __init__(self, kind):
            self.kind = kind

        def get(self):
            calls[self.kind] += 1
            return self.held

        def update(self, value):
            calls[self.kind] += 1
            self.held = value

        put = update

        def clear(self):
            calls[self.kind] += 1
            self.held = None

    class Rows(Value):
        def get(self):
            return iter(super().get() or [])

        def appendList(self, rows):
            calls[self.kind] += 1
            self.held = [*(self.held or []), *rows]

    class Handle:
        def __init__(self, kind):
            self.kind, self.timers = kind, set()

        def getValueState(self, *_):
            return Value(self.kind)

        def getListState(self, *_):
            return Rows(self.kind)

        def registerTimer(self, at):
            calls[self.kind] += 1
            self.timers.add(at)

        def deleteTimer(self, at):
            calls[self.kind] += 1
            self.timers.discard(at)

    class Now:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return self.now

        getExpiryTimeInMs = getCurrentWatermarkInMs

    def make(cls, kind):
        handle, p = Handle(kind), cls(cap, idle_ms, limit)
        p.init(handle)
        return handle, p

    def fire(handle, p, key, now):
        out = []
        for at in sorted(t for t in handle.timers if t <= now):
            if at in handle.timers:
                handle.timers.discard(at)
                out.append(p.handleExpiredTimer(key, Now(now), Now(at)))
        return out

    one, bucket = {}, make(rs.RunsProcessor, "bucket")
    alone, shared = [], []
    row = Row(*rs._PENDING)
    for now, steps in batches:
        of = defaultdict(list)
        for run, *step in steps:
            of[run].append(row(*step))
        for run, rows in of.items():
            one.setdefault(run, make(rs.RunProcessor, "run"))[1].handleInputRows((run,), iter(rows), Now(now))
        for run, (handle, p) in one.items():
            alone += [r for got in fire(handle, p, (run,), now) for r in got]
        names, numbers = rs._STEPS.names, rs._NUMBERS
        frame = pd.DataFrame([[0 if v is None and n in numbers else v for n, v in zip(names, s)] for s in steps], columns=names)
        frame["nulls"] = [sum(1 << k for k, n in enumerate(numbers) if s[names.index(n)] is None) for s in steps]
        handle, p = bucket
        got = [p.handleInputRows((0,), iter([frame.iloc[:7], frame.iloc[7:]]), Now(now))] if steps else []
        for frame in (f for g in [*got, *fire(handle, p, (0,), now)] for f in g):
            shared += [rs._OUT(*r) for r in frame.itertuples(index=False)]
    assert bucket[1].bucket.held is None and not bucket[0].timers
    return alone, shared, calls


def test_runs_of_a_bucket_share_state():
    import random
    r = random.Random(5)
    batches, top = [], 0
    for k in range(12):
        steps = [(r.choice([None, *range(-1, 9)]), (1_000 * k + r.randrange(2_500)) * 1_000 + r.choice([0, 0, 7]), 100 * k + i + (1 << 60),
                  r.choice(["call", "line", "return", "exception", None]), r.choice(["main", "<module>", None]), r.choice([None, 3, 4]),
                  r.choice([None, "", "x\n"])) for i in range(30 if k not in (7, 8) else 2)]
        batches.append((max(top - 1_500, 0), [s for s in steps if s[1] > (top - 1_500) * 1_000]))
        top = max([top, *[s[1] // 1_000 for s in batches[-1][1]]])
    batches += [(top - 1_500, []), (top + 60_000, [])]
    key, seen = (lambda x: [(v is None, v) for v in x]), set()
    for cap, limit in ((4, 1e9), (1_000, 1e9), (4, 8.0)):
        alone, shared, _ = _run_both(batches, cap=cap, limit=limit)
        assert sorted(map(tuple, shared), key=key) == sorted(map(tuple, alone), key=key)
        seen |= {x.status or x.kind for x in alone}
    assert seen >= {"step", "ok", "truncated", "runtime_error", "timed_out"}


def test_state_is_asked_per_bucket_not_per_run():
    """Hundreds of runs take a few calls a batch (six per run before)."""
    steps = [(run, 1_000_000 + run, run, "line", "main", 1, "x\n") for run in range(300)]
    alone, shared, calls = _run_both([(0, steps), (5_000, []), (60_000, [])])
    assert len(alone) == len(shared) == 600
    assert calls["bucket"] <= 12 < 300 * 6 <= calls["run"]


def test_slices_arrive_whole_in_several_files(spark, tmp_path, monkeypatch):
    """A slice in many files is one batch: none of its steps is late."""
    from snipflow.plans import stream_q, trace_q
    from snipflow.session import checkpoint_dir
    monkeypatch.setattr(stream_q, "_ROWS_PER_FILE", 400)
    monkeypatch.setattr(stream_q, "_LEAST_ROWS", 100)
    monkeypatch.setattr(stream_q, "_OPTIONS", dict(stream_q._OPTIONS, buckets=3))
    d = str(tmp_path)
    events = spark.read.parquet(f"{SF01}/events.parquet")
    events.withColumn("user_id", F.col("user_id") % 7).write.parquet(f"{d}/events.parquet")
    got = stream_q.stream_trace_steps(spark, d)
    inboxes = [x for x in os.listdir(checkpoint_dir(spark)) if x.startswith("run-stream-")]
    newest = max(inboxes, key=lambda x: os.path.getmtime(f"{checkpoint_dir(spark)}/{x}"))
    assert len([x for x in os.listdir(f"{checkpoint_dir(spark)}/{newest}/inbox") if x.endswith(".parquet")]) > 14
    want = trace_q.trace_call_depth(spark, d).select(got.columns)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_scoring_inbox_is_written_by_many_tasks_and_fit_reads_rows_once(spark, tmp_path, monkeypatch):
    from conftest import SF001
    from snipflow.operators import model
    from snipflow.plans import model_q
    from snipflow.streaming import score_stream
    d = str(tmp_path)
    spark.read.parquet(f"{SF001}/documents.parquet").repartition(4, "doc_id").write.parquet(f"{d}/documents.parquet")
    fit, start, seen = model.fit, score_stream.start, []
    monkeypatch.setattr(model, "fit", lambda rows, **kw: seen.append(rows) or fit(rows, **kw))
    monkeypatch.setattr(score_stream, "start", lambda *a, **kw: seen.append(kw["max_files"]) or start(*a, **kw))
    r = model_q.stream_scoring(spark, d).first()
    assert r["n"] == r["n_same"] == 200 and r["n_empty"] > 0 and r["n_parse_error"] > 0
    rows, first, second = seen
    assert first == second == 4                            # one task's file before
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()     # features are not built anew per pass


def test_blank_texts(spark):
    from snipflow.functions.text import is_blank
    texts = [None, "", " ", "\t\n\x0b\x0c\r", "\x1c\x85\xa0     　", "a", " a ", "\n" * 50 + "]", "​", "\U0001f600", "^", "\x00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", is_blank(F.col("t")).alias("b"))
    assert {r["i"]: r["b"] for r in rows.collect()} == {i: t is None or not t.strip() for i, t in enumerate(texts)}
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()
