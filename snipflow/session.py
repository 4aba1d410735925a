"""Session construction and shared-folder helpers.

The library never creates a session on import; callers pass one in.
``get_spark`` is a convenience for scripts and tests.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. AQE coalesces small shuffles and splits
# skewed join partitions at run time; the UI stays off (no server).
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # No broadcast from planner estimates (a stale statistic must not
    # broadcast a side that grew with the data). Broadcasts happen for the
    # explicitly hinted dimensions fixed by code, or when AQE has measured a
    # finished stage below the runtime threshold.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "snipflow", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised intermediates.

    ``spark.checkpoint.dir`` is used as it is, scheme included. Only a local
    master (tests) may leave it unset and gets a temporary folder; on a cluster
    a machine-local folder is invisible to the other hosts, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder (master {master})")
        d = tempfile.mkdtemp(prefix="snipflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API (any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# Spark deletes a query's shuffle files as soon as the query ends, not when its plan is collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of the writes within the block go with the writes: what they wrote
    is read back from the shared folder, never computed again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


class Scratch:
    """Written intermediates of one job, in the shared checkpoint folder.

    ``save`` writes a DataFrame as Parquet and reads it back: lineage is cut,
    later stages prune columns, and a lost executor re-reads files instead of
    recomputing; the shuffle files of the step go at once. ``drop`` deletes one step (or all of them) once no plan reads
    it any more; what is left, after a failure too, goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _at_exit(spark, self.root)

    def save(self, df, step: str, compression: str = "snappy", by: tuple = ()):
        """``by``: columns with few values, by which a reader picks whole folders."""
        path = f"{self.root}/{step}"
        with _shuffles_dropped(df.sparkSession):
            df.write.mode("overwrite").option("compression", compression).partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *steps: str) -> None:
        for path in [f"{self.root}/{s}" for s in steps] or [self.root]:
            delete_path(self.spark, path)


_scope = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession):
    """Steps that ``materialize`` writes within the block (in this thread) are deleted at
    its end, also after a failure. Results must be written before the block ends."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        paths, _scope.paths = _scope.paths, outer
        for path in paths:
            delete_path(spark, path)


def materialize(df, name: str = "stage"):
    """Cut lineage: write ``df`` as Parquet into the shared checkpoint folder
    and read it back.

    Used where a plan is read many times (node table, ancestor relation): the
    Python parse runs once, later stages get column pruning and predicate
    pushdown on the files, and a lost executor re-reads files instead of
    recomputing the lineage. (RDD ``checkpoint()`` would run the lineage twice
    unless cached, and yields rows, not columns.)

    The files stay while the returned DataFrame may be read: to the end of the
    enclosing ``scratch_scope``, or of the driver process.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    paths = getattr(_scope, "paths", None)
    if paths is None:
        _at_exit(spark, path)
    else:
        paths.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _at_exit(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver process ends, also if the session has stopped by then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove():
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM is gone: nothing to call
            pass
    atexit.register(remove)


def literal_df(spark, rows, schema):
    """A small fixed table (dimensions defined in code) as a SQL inline table:
    resolved to a LocalRelation at analysis, no Python worker, no RDD."""
    from pyspark.sql import types as T
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(v)

    names = [f.name for f in schema.fields]
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields)
    return spark.sql(f"SELECT {cols} FROM VALUES {body} AS t({', '.join(names)})")
