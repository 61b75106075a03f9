"""Driver contract: entry runs, every query has a callable, oracle keys are a subset."""
import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"condition", "exclude", "avg_abs_err_p_sup", "proportion_correct"} <= set(df.columns)


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 150
