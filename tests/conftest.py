import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from surveil.session import build_session, checkpoint_dir
    s = build_session(master="local[*]", shuffle_partitions=8, app="surveil-tests")
    checkpoint_dir(s)
    yield s
    s.stop()


def fix(kind, ident, at, **fields):
    """One event: kind is new, fill, cancel or replace; prices and quantities per call."""
    row = dict.fromkeys(("exec_type", "exec_id", "last_qty", "last_px", "price"))
    row |= {"msg_type": {"new": "D", "fill": "8", "cancel": "F", "replace": "G"}.get(kind, kind), "cl_ord_id": ident,
            "transact_time": at, "trader_id": "tr-9", "account": "acct-9", "symbol": "XQZ", "side": "1", "order_qty": 250,
            "ord_type": "2", "exchange_id": "VEN", "price": 71.25}
    if kind == "fill":
        row |= {"exec_type": "2", "exec_id": f"x-{ident}-{at}", "last_qty": 250, "last_px": 71.25}
    if kind == "cancel":
        row["price"] = None
    return row | fields


def raw_df(spark, rows):
    from surveil.schemas import RAW_FIX_SCHEMA
    names = [f.name for f in RAW_FIX_SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_FIX_SCHEMA)
