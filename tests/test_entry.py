"""Driver contract: entry smoke run and registry consistency."""
import __spark_entry__ as E


def test_entry_runs_and_has_alerts(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "audit_hash" in df.columns


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 39
