from snipflow.operators.parse import parse_nodes
from snipflow.session import literal_df, materialize


def test_literal_df_escaping(spark):
    rows = [(1, "a\\b'c\nd", None), (2, "x", 1.5)]
    df = literal_df(spark, rows, "i int, s string, d double")
    assert [tuple(r) for r in df.orderBy("i").collect()] == rows
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def test_materialize_roundtrip(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS v")
    m = materialize(df, "t")
    assert m.count() == 100 and m.agg({"v": "sum"}).collect()[0][0] == 9900


def test_parse_keeps_parallelism(spark):
    df = spark.range(40).selectExpr("concat('x', CAST(id AS STRING), ' = 1') AS code")
    nodes = parse_nodes(df)
    assert nodes.rdd.getNumPartitions() >= 2
    assert nodes.where("node_id = 0").count() == 40


def test_cluster_master_needs_a_shared_folder(monkeypatch):
    import pytest
    from snipflow import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="shared folder"):
        session.checkpoint_dir(Session())


def test_scratch_save_and_drop(spark):
    import os
    from snipflow.session import Scratch
    s = Scratch(spark, "t")
    assert s.save(spark.range(5), "a").count() == 5
    assert os.path.isdir(f"{s.root}/a")
    s.drop("a")
    assert not os.path.exists(f"{s.root}/a")
    s.drop()


def test_saved_step_leaves_no_shuffle_files(spark):
    """The disk holds what a job saved, not the shuffles that led there."""
    import os
    import time

    from snipflow.session import SHUFFLE_CLEANUP, Scratch
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in folders for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}

    before, conf, scratch = files(), spark.conf.get(SHUFFLE_CLEANUP), Scratch(spark, "cleanup")
    saved = scratch.save(spark.range(10_000).repartition(7, "id").groupBy("id").count(), "step")
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(SHUFFLE_CLEANUP) == conf
    assert saved.count() == 10_000
