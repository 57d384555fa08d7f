"""Rules given as SQL text: usable in SQL and as detectors; the registry stays as it is."""
import pytest

from conftest import fix, raw_df
from surveil.operators import bronze as B
from surveil.operators import detectors as D
from surveil.operators import gold as G
from surveil.operators import rules as RU
from surveil.operators import silver as S


def test_sql_rule_as_function_and_detector(spark):
    rows = [fix("new", f"o-{i}", 1_000 + i) for i in range(3)] + [fix("cancel", f"o-{i}", 2_000 + i) for i in range(3)]
    gold = G.to_gold(S.to_silver(B.to_bronze(raw_df(spark, rows))), 60_000)
    many = RU.define(spark, "MANY_ORDERS", ["n_orders"], "least(1D, n_orders / 4D)", 0.75, ("R1", "R2"))
    assert spark.sql("SELECT rule_many_orders(2L) AS s").first()["s"] == 0.5
    names = set(D.REGISTRY)
    found = {r["detector"]: r for r in D.detect(gold, ["WASH_TRADE", many]).collect()}
    assert set(found) == {"MANY_ORDERS"} and set(D.REGISTRY) == names
    assert found["MANY_ORDERS"]["rule_score"] == 0.75 and found["MANY_ORDERS"]["regulation_refs"] == ["R1", "R2"]


def test_wrong_definitions_fail_at_once(spark):
    with pytest.raises(ValueError):
        RU.define(spark, "BAD", ["no_such_column"], "1D", 0.5, ())
    with pytest.raises(ValueError):
        RU.define(spark, "bad name", ["n_orders"], "1D", 0.5, ())
    with pytest.raises(Exception):
        RU.define(spark, "BAD", ["n_orders"], "n_execs / 2D", 0.5, ())
