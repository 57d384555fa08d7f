"""What rides through the shuffles of the medallion: copies only in the dedup, no constant keys, no unread columns."""
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, fix, raw_df
from surveil.operators import bronze as B
from surveil.operators import gold as G
from surveil.operators import gold_states as GS
from surveil.operators import silver as S
from surveil.plans import medallion as M
from surveil.plans import queries as Q
from surveil.session import stored


def _rows():
    """Single events, exact copies, copies that differ, keys with a null, a key that is all null but its time."""
    rows = [fix("new", f"n{i}", 60_000 * i, trader_id=f"t{i % 3}") for i in range(40)]
    rows += [fix("fill", f"n{i}", 60_000 * i + 5, last_px=70.0 + i % 2, order_id=f"o{j}", exec_id="x") for i in range(9) for j in range(3)]
    rows += [fix("cancel", "c", 7, orig_cl_ord_id=o) for o in ("n2", "n1", None)] + [fix("new", "n0", 0, trader_id="t0")] * 4
    return rows + [fix(None, None, 3, price=p) for p in (5.0, None, 4.0)]


@pytest.mark.parametrize("words", [1, 2, 1 << 20])
@pytest.mark.parametrize("needed", [None, G.INPUT_COLUMNS])
def test_sifted_dedup_keeps_the_same_rows(spark, monkeypatch, words, needed):
    monkeypatch.setattr(S, "SIFT_WORDS", words)        # few words: keys that come once share the bits of copies
    df = raw_df(spark, _rows()).withColumn("_ingest_ts", F.pmod("transact_time", F.lit(3)))
    key = lambda t: sorted(map(tuple, t.collect()), key=repr)
    plain, sifted = S.dedup(df, needed=needed), S.dedup(df, needed=needed, sift=True)
    assert sifted.columns == plain.columns and key(sifted) == key(plain)
    assert len(key(plain)) == 40 + 9 + 1 + 1


def test_only_repeated_keys_are_marked(spark):
    df = raw_df(spark, _rows())
    marks = S.repeated(df).collect()
    assert sum(bin(r["_bits"] & (2 ** 64 - 1)).count("1") for r in marks) == 9 + 1 + 1 + 1
    assert S.repeated(df.dropDuplicates(S.DEDUP_KEY)).isEmpty() and S.repeated(df.limit(0)).isEmpty()


def test_single_events_are_combined_before_any_shuffle_of_whole_events(spark):
    plan = M.gold(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning(trader_id")[-1]                      # what the first shuffle of gold reads
    first, copies = below.split("Exchange hashpartitioning(cl_ord_id")
    assert first.count("Filter NOT coalesce") == 1 and "_bits" in first
    assert "_bits" in re.search("Filter coalesce.*", copies)[0]


def test_constant_keys_are_not_shuffled_and_joins_need_no_second_one(spark):
    silver = S.to_silver(B.to_bronze(raw_df(spark, _rows())))
    key = lambda t: sorted(t.collect(), key=repr)
    for window in (60_000, 420_000, 86_400_000):       # the second does not divide a day
        whole = G.to_gold(silver, window)
        assert key(G.to_gold(silver, window, constant=S.UNMAPPED)) == key(whole) and G.to_gold(silver, window, constant=S.UNMAPPED).columns == whole.columns
        assert {r.secs_to_close for r in whole.collect()} <= {(57_600_000 - t % 86_400_000) / 1000 for t in (r["transact_time"] for r in _rows())}
    states = stored(GS.to_states(silver, constant=S.UNMAPPED), "states")
    assert key(states) == key(GS.to_states(silver)) and states.columns == GS.to_states(silver).columns
    assert key(GS.to_gold(states, 3_600_000, constant=S.UNMAPPED)) == key(G.to_gold(silver, 3_600_000))
    plan = Q.QUERIES["labelled_windows"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((trader_id[^)]*?), \d+\)", plan)]
    assert sorted(keys) == ["trader_id, symbol, window_start"] * 2 + ["trader_id, symbol, window_start, price"]


@pytest.mark.parametrize("name", ["alert_events", "alert_events_daily", "gold_states_hourly"])
def test_stored_silver_holds_what_is_read(spark, monkeypatch, name):
    seen = []
    for where in (M, Q):
        monkeypatch.setattr(where, "stored", lambda df, of="table": seen.append((of, df.columns)) or stored(df, of))
    Q.QUERIES[name](spark, SF_SMALL)
    silver = dict(seen)["silver"]
    assert not {"cancel_reason", "account", "scenario_id", "_source", "notional"} & set(silver) and set(S.DEDUP_KEY) < set(silver)


def test_stored_tables_are_compressed_with_zstd(spark):
    files = stored(spark.range(1000), "zstd").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
