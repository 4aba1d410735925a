"""Every registered query with oracle SQL matches DuckDB at sf0.001 (the
driver checks sf0.01 the same way)."""

import oracle_compare

from conftest import SF001


def test_registered_queries_match_duckdb(spark):
    import __spark_entry__ as entry
    names = set(entry.oracle_sql())
    res = oracle_compare.compare(spark, SF001, names, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "ok"}
    assert not bad
    assert set(res) == names


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0


def test_every_registered_query_runs(spark):
    """All registered queries without oracle SQL run at sf0.001 with unique column
    names (the comparison above runs the others and checks their names)."""
    import __spark_entry__ as entry
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if name in oracles:
            continue
        df = fn(spark, SF001)
        assert len(df.columns) == len(set(df.columns)), name
        assert df.count() >= 0, name
