"""Registered stream-to-folder jobs: X1's steps arrive out of order and twice, the query
stops halfway and goes on from its checkpoint; the folder holds the batch job's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipflow.plans import trace_q
from snipflow.schemas import TRACE_STEPS_SCHEMA
from snipflow.session import Scratch
from snipflow.sources import fixtures as fx
from snipflow.streaming import run_state

_SLICE_S = 3 * 86400
_ON_THE_WAY = 3                 # a step arrives in the file of its slice or one of the two after it
_ROWS_PER_FILE = 500_000        # a slice of more rows arrives in several files, the same number for all slices
_LEAST_ROWS = 1_000             # per file, so that none stays empty
_OPTIONS = dict(cap=trace_q.CAP, time_limit_s=trace_q.LIMIT, idle_s=20 * 86400.0, watermark="7 days")


def _arrivals(spark, sf_dir):
    """Every step of X1 twice, each copy with the number of the file that it arrives in."""
    steps = fx.x1_steps(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    start = steps.agg(F.min("ts")).first()[0]
    twice = steps.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    part = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(start))) / F.lit(_SLICE_S * 1_000_000))
    return twice.withColumn("file", (part + F.pmod(F.xxhash64("seq", "copy"), F.lit(_ON_THE_WAY))).cast("int"))


def _run(spark, sf_dir):
    scratch = Scratch(spark, "run-stream")
    rows = scratch.save(_arrivals(spark, sf_dir), "arrivals", by=("file",))
    sizes = {r["file"]: r["count"] for r in rows.where("file IS NOT NULL").groupBy("file").count().collect()}
    files = max(sizes) + 1
    # a batch is the files of one slice; a slice too small to fill them lets all have one
    each = max(1, min(-(-max(sizes.values()) // _ROWS_PER_FILE), min(sizes.get(k, 0) for k in range(files)) // _LEAST_ROWS))
    inbox, columns = f"{scratch.root}/inbox", [f.name for f in TRACE_STEPS_SCHEMA.fields]

    def deliver(df, parts):
        have = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns]
        df = df.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(have, TRACE_STEPS_SCHEMA.fields)])
        (df.coalesce(1) if parts == 1 else df.repartition(parts)).write.mode("append").parquet(inbox)

    def work_off():
        stream = spark.readStream.schema(TRACE_STEPS_SCHEMA).option("maxFilesPerTrigger", each).parquet(inbox)
        run_state.write_runs(stream, f"{scratch.root}/out", f"{scratch.root}/checkpoint", state_partitions=max(8, spark.sparkContext.defaultParallelism), **_OPTIONS)

    for k in range(files):
        deliver(rows.where(F.col("file") == k), each)
        if k == files // 2:
            work_off()
    # two steps of no run, long after, let the watermark pass all others
    last = rows.orderBy(F.desc("ts")).limit(1).withColumn("run_id", F.lit(-1).cast("long"))
    for days in (60, 61):
        deliver(last.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(days))).withColumn("seq", F.lit(-days).cast("long")), 1)
    work_off()
    return spark.read.parquet(f"{scratch.root}/out").where("run_id >= 0")


def stream_trace_steps(spark, sf_dir):
    return _run(spark, sf_dir).where("kind = 'step'").select("run_id", "seq", "step_no", "event", "line_number", "call_depth")


def stream_run_status(spark, sf_dir):
    return _run(spark, sf_dir).where("kind = 'status'").select(
        "run_id", "status", "error", "step_count", "max_depth", "final_output", "duration_s")


def queries():
    return {"stream_trace_steps": stream_trace_steps, "stream_run_status": stream_run_status}


def oracle():
    batch = trace_q.oracle()
    return {"stream_trace_steps": batch["trace_call_depth"], "stream_run_status": batch["trace_run_status"]}
