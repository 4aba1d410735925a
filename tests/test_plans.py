"""Plan-shape guards for the properties the design relies on at scale."""

from conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _all_plans(df):
    qe = df._jdf.queryExecution()
    return qe.optimizedPlan().toString() + "\n" + qe.executedPlan().toString()


def test_step_cap_is_a_group_limit(spark):
    import __spark_entry__ as e
    p = _plan(e.queries()["trace_call_depth"](spark, SF001))
    assert "WindowGroupLimit" in p


def test_scans_are_pruned(spark):
    import __spark_entry__ as e
    p = _plan(e.queries()["rules_cascade"](spark, SF001))
    assert "l_extendedprice" not in p and "l_shipdate" not in p
    p = _plan(e.queries()["corpus_render"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_stratified_rank_splits_classes(spark):
    import __spark_entry__ as e
    p = _plan(e.queries()["split_rows"](spark, SF001))
    assert "_slice" in p and "hashpartitioning(label" in p


def test_no_pair_joins_in_feature_path(spark):
    import __spark_entry__ as e
    for name in ["corpus_features", "tree_features", "run_screening"]:
        p = _all_plans(e.queries()[name](spark, SF001))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Join Cross"):
            assert bad not in p, (name, bad)
