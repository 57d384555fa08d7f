"""Alert -> events for windows of any length and position; label windows that are reversed or repeated."""
import random

import pytest

from surveil.operators import govern as GV
from surveil.operators import labels as LB
from surveil.operators import links as L
from pyspark.sql import functions as F

HOUR = 3_600_000


def test_alert_events_match_brute_force_for_any_window(spark):
    r = random.Random(6)
    ev = [(r.choice("ab"), r.choice("XY"), f"e{i}", "D", r.randint(-3 * HOUR, 40 * HOUR), None) for i in range(400)]
    al = []
    for i in range(60):
        start = r.randint(-3 * HOUR, 30 * HOUR)
        al.append((f"al{i}", "D", r.choice("ab"), r.choice("XY"), start, start + r.choice([0, -5, 1, 60_000, HOUR, 7 * HOUR + 3, 26 * HOUR])))
    silver = spark.createDataFrame(ev, "trader_id string, symbol string, cl_ord_id string, msg_type string, transact_time long, exec_id string")
    alerts = spark.createDataFrame(al, "alert_id string, detector string, trader_id string, instrument string, window_start long, window_end long")
    got = sorted((x.alert_id, x.cl_ord_id) for x in L.alert_events(alerts, silver).collect())
    assert got == sorted((a[0], e[2]) for a in al for e in ev if a[2:4] == e[:2] and a[4] <= e[4] < a[5])


def test_reversed_and_repeated_labels(spark):
    rows = [("t", "X", "SPOOFING", 60_000, 59_000), ("t", "X", "SPOOFING", 60_000, 120_000), ("t", "X", "SPOOFING", 60_000, 120_000)]
    lab = spark.createDataFrame(rows, "trader_id string, instrument string, abuse_type string, window_start long, window_end long")
    assert sorted(x.window_start for x in LB.label_windows(lab).collect()) == [60_000, 120_000]


def test_pseudonyms_need_a_key_and_stay_whole(spark):
    with pytest.raises(ValueError):
        GV.mask(F.lit("x"), "short")
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    one, two = (df.select(GV.mask(F.col("v"), key).alias("m")).collect() for key in ("k" * 16, "q" * 16))
    assert one[0] == one[1] != one[2] and one[3].m is None and len(one[0].m) == 4 + 64
    assert one[0] != two[0]
