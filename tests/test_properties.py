"""Property tests: operators against brute force on random small fixtures."""
import hashlib
import math

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import raw_df
from surveil.operators import bronze as B
from surveil.operators import gold as G
from surveil.operators import silver as S

SETTINGS = dict(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

event = st.fixed_dictionaries({
    "msg_type": st.sampled_from(["D", "8", "F", "G"]),
    "cl_ord_id": st.sampled_from([f"o{i}" for i in range(6)]),
    "trader_id": st.sampled_from(["T-000", "T-001"]),
    "symbol": st.sampled_from(["RY", "TD", None]),
    "side": st.sampled_from(["1", "2"]),
    "order_qty": st.integers(1, 50).map(lambda q: q * 100),
    "transact_time": st.integers(-200_000, 400_000),
    "ticks": st.integers(-30, 30),
    "has_price": st.booleans(),
    "exec_id": st.sampled_from([None, "e1", "e2"]),
})


def to_rows(evs):
    rows = []
    for e in evs:
        px = round((14000 + e["ticks"]) / 100.0, 2) if e["has_price"] else None
        r = {"msg_type": e["msg_type"], "cl_ord_id": e["cl_ord_id"], "trader_id": e["trader_id"], "account": "A",
             "symbol": e["symbol"], "side": e["side"], "order_qty": e["order_qty"], "ord_type": "2",
             "transact_time": e["transact_time"], "exchange_id": "TSX", "price": px}
        if e["msg_type"] == "8":
            r.update(exec_id=e["exec_id"], exec_type="2", last_qty=e["order_qty"], last_px=px)
        rows.append(r)
    return rows


def brute_gold(rows, w=60_000):
    df = pd.DataFrame(rows)
    for c in ("exec_id", "last_qty", "last_px"):
        if c not in df:
            df[c] = None
    df = df[df["symbol"].notna()]
    df = df.drop_duplicates(["cl_ord_id", "msg_type", "transact_time", "exec_id"])
    kind = {"D": "NEW", "8": "EXEC", "F": "CANCEL", "G": "REPLACE"}
    out = {}
    for (tr, sym, ws), g in df.assign(ws=df["transact_time"] // w * w).groupby(["trader_id", "symbol", "ws"]):
        k = g["msg_type"].map(kind)
        new, ex = g[k == "NEW"], g[k == "EXEC"]
        buy = new[new["side"] == "1"]["order_qty"].sum()
        sell = new[new["side"] != "1"]["order_qty"].sum()
        pr = g[g["price"].notna()].sort_values(["transact_time", "price"])
        first = pr["price"].iloc[0] if len(pr) else 0.0
        last = pr.sort_values(["transact_time", "price"])["price"].iloc[-1] if len(pr) else 0.0
        fills = ex[ex["last_px"].notna() & ex["last_qty"].notna()]
        bf, sf_ = fills[fills["side"] == "1"], fills[fills["side"] != "1"]
        bv = (bf["last_qty"] * bf["last_px"]).sum() / bf["last_qty"].sum() if len(bf) else 0.0
        sv = (sf_["last_qty"] * sf_["last_px"]).sum() / sf_["last_qty"].sum() if len(sf_) else 0.0
        out[(tr, sym, int(ws))] = dict(
            n_orders=len(new), n_cancels=int((k == "CANCEL").sum()), n_execs=len(ex), buy_qty=int(buy),
            sell_qty=int(sell), distinct_prices=int(g["price"].nunique()),
            secs_to_close=float(((57_600_000 - g["transact_time"] % 86_400_000) / 1000.0).min()),
            first_px=first, last_px=last, buy_vwap=bv, sell_vwap=sv,
            price_move_bps=(last - first) / first * 1e4 if first > 0 else 0.0,
            round_trip_gain_bps=(sv - bv) / bv * 1e4 if bv > 0 and sv > 0 else 0.0)
    return out


@settings(**SETTINGS)
@given(st.lists(event, min_size=1, max_size=40))
def test_gold_matches_pandas_brute_force(spark, evs):
    rows = to_rows(evs)
    got = {(r["trader_id"], r["symbol"], r["window_start"]): r.asDict()
           for r in G.to_gold(S.to_silver(B.to_bronze(raw_df(spark, rows)))).collect()}
    want = brute_gold(rows)
    assert set(got) == set(want)
    for k, w in want.items():
        for c, v in w.items():
            assert math.isclose(got[k][c], v, rel_tol=1e-9, abs_tol=1e-9), (k, c, got[k][c], v)


@settings(**SETTINGS)
@given(st.lists(event, min_size=1, max_size=40))
def test_clean_and_quarantine_partition_any_input(spark, evs):
    raw = raw_df(spark, to_rows(evs))
    assert B.to_bronze(raw).count() + B.bronze_quarantine(raw).count() == len(evs)


def py_field(v):
    """Plain-Python rendering of the byte grammar (spec restated for the test)."""
    if v is None:
        return "\x00"
    if isinstance(v, bool):
        return "1" if v else "0"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v:.8f}"
    if isinstance(v, list):
        return "\x1e".join(py_field(x) for x in v)
    return v


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x2FF), max_size=12),
       st.integers(-10**12, 10**12), st.one_of(st.none(), st.floats(0, 1)),
       st.lists(st.text(alphabet="abcXYZ-._", max_size=5), max_size=4))
def test_grammar_matches_python_rendering(spark, s, i, x, lst):
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType
    from surveil.functions import grammar as Gm
    body = Gm.canonical_body([(F.lit(s), StringType()), (F.lit(i), LongType()),
                              (F.lit(x).cast("double"), DoubleType()),
                              (F.array(*[F.lit(e) for e in lst]).cast("array<string>"), ArrayType(StringType()))])
    got = spark.range(1).select(Gm.digest(body).alias("d")).first()["d"]
    want = hashlib.sha256("\x1f".join(py_field(v) for v in (s, i, x, lst)).encode()).hexdigest()
    assert got == want


def py_scores(f):
    """The five rules restated in plain Python (rule table of the survey, same operation order)."""
    out = {}
    ott = min(f["order_to_trade_ratio"] / 10.0, 1.0)
    out["SPOOFING"] = 0.0 if f["n_orders"] < 4 else max(0.0, min(1.0, 0.7 * f["cancel_ratio"] + 0.3 * ott))
    imb, gain = f["qty_imbalance"], f["round_trip_gain_bps"]
    if f["buy_qty"] <= 0 or f["sell_qty"] <= 0 or f["n_execs"] < 2 or abs(imb) > 0.1 or abs(gain) > 1.0:
        out["WASH_TRADE"] = 0.0
    else:
        out["WASH_TRADE"] = max(0.0, min(1.0, 0.6 * (1.0 - min(abs(imb), 1.0))
                                         + 0.4 * (1.0 if f["distinct_prices"] <= 2 else 0.5)))
    if f["n_execs"] < 2 or abs(imb) > 0.1 or gain <= 1.0 or f["buy_qty"] <= 0 or f["sell_qty"] <= 0:
        out["FRONT_RUNNING"] = 0.0
    else:
        out["FRONT_RUNNING"] = min(1.0, 0.6 + 0.4 * min(gain / 10.0, 1.0))
    mv = f["price_move_bps"]
    if f["n_execs"] < 4 or mv <= 0.0 or f["cancel_ratio"] > 0.2 or f["sell_qty"] <= 0:
        out["MOMENTUM_IGNITION"] = 0.0
    else:
        out["MOMENTUM_IGNITION"] = min(1.0, 0.4 * min(f["n_execs"] / 6.0, 1.0) + 0.3 + 0.1 * min(mv / 5.0, 1.0))
    stc = f["secs_to_close"]
    if stc < 0.0 or stc > 120.0 or mv <= 0.0 or f["n_execs"] < 1 or f["buy_qty"] <= 0:
        out["MARKING_THE_CLOSE"] = 0.0
    else:
        high = 1.0 if f["last_px"] >= f["max_px"] - 1e-9 and f["max_px"] > 0 else 0.5
        out["MARKING_THE_CLOSE"] = min(1.0, 0.3 + 0.3 * (1.0 - min(stc / 120.0, 1.0)) + 0.2 * min(mv / 5.0, 1.0)
                                       + 0.2 * high)
    return out


feature_row = st.fixed_dictionaries({
    "n_orders": st.integers(0, 12), "n_execs": st.integers(0, 8), "buy_qty": st.integers(0, 3000),
    "sell_qty": st.integers(0, 3000), "distinct_prices": st.integers(0, 6),
    "cancel_ratio": st.floats(0, 2), "order_to_trade_ratio": st.floats(0, 20), "qty_imbalance": st.floats(-1, 1),
    "round_trip_gain_bps": st.one_of(st.floats(-5, 20), st.sampled_from([1.0, -1.0, 0.0])),
    "price_move_bps": st.one_of(st.floats(-5, 10), st.sampled_from([0.0])),
    "secs_to_close": st.one_of(st.floats(-10, 200), st.sampled_from([0.0, 120.0])),
    "last_px": st.floats(0, 2), "max_px": st.floats(0, 2),
})


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(feature_row, min_size=1, max_size=20))
def test_detector_scores_match_plain_python_rules(spark, rows):
    from surveil.operators import detectors as D
    cols = list(rows[0])
    ddl = ", ".join(f"{c} {'long' if isinstance(rows[0][c], int) else 'double'}" for c in cols)
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], ddl)
    got = D.score_all(df).collect()
    for g, r in zip(sorted(got, key=lambda x: tuple(x[c] for c in cols)), sorted(rows, key=lambda x: tuple(x[c] for c in cols))):
        want = py_scores(r)
        for name, v in want.items():
            assert g[f"score_{name.lower()}"] == v, (name, r)
