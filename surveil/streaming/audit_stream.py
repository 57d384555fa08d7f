"""Streaming audit-chain append: one StatefulProcessor per chain keeps the head.

Entries arrive as a stream; each is routed by the same (day, hash bucket) key as the batch
path.  Per micro-batch and chain, the new entries are put in the total order of a chain
and linked from the stored (head_hash, seq) in a ValueState (RocksDB, checkpointed),
so the chain continues exactly across batches and restarts.  A log that a batch job began is
taken over through the anchors of its chains, which become the state's initial rows.  A task
holds one chain's entries of one micro-batch: ``n_chains`` and the source's trigger limit
(files or offsets per trigger) bound it; linked rows leave in chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from surveil.operators import audit as AU
from surveil.schemas import GENESIS_HASH

CHUNK = 10_000
HEAD = StructType([StructField("head", StringType()), StructField("seq", LongType())])


class ChainAppender(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.head.update((str(initialState["head_hash"].iloc[0]), int(initialState["n_entries"].iloc[0])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries = []
        for pdf in rows:
            payloads = [None if p is None else list(p) for p in pdf["payload"]]
            entries += zip(pdf["ts"].tolist(), pdf["ref_id"], pdf["action"], pdf["subsystem"], payloads, pdf["body"])
        # nulls first, as in the batch order
        entries.sort(key=lambda e: tuple((x is not None, x) for x in e[:4]) + ([(x is not None, x) for x in e[4] or []],))
        prev, seq = self.head.get() if self.head.exists() else (GENESIS_HASH, 0)
        out = []
        for ts, ref_id, action, subsystem, payload, body in entries:
            h = hashlib.sha256(prev.encode("ascii") + b"|" + body.encode("utf-8")).hexdigest()
            seq += 1
            out.append((int(key[0]), seq, subsystem, action, ref_id, int(ts), payload, "sha256", prev, h))
            prev = h
            if len(out) == CHUNK:
                yield pd.DataFrame(out, columns=AU.CHAIN_COLUMNS)
                out = []
        self.head.update((prev, seq))
        if out:
            yield pd.DataFrame(out, columns=AU.CHAIN_COLUMNS)

    def close(self) -> None:
        pass


def append_stream(entries: DataFrame, n_chains: int = AU.N_CHAINS, anchors: DataFrame | None = None) -> DataFrame:
    """Streaming entries (subsystem, action, ref_id, ts, payload) -> chain rows (CHAIN_SCHEMA, append mode).

    ``anchors`` (``audit.anchor`` of an existing log, a batch table) hands the log over: every chain goes on from
    its anchored head and sequence number, and the bucket count is the one stored with them. They seed the state
    when the query first starts; a restart from its checkpoint goes on from the state."""
    if anchors is not None:
        n_chains = AU.n_chains_of(anchors)
    src = entries.select(AU.chain_key(F.col("ref_id"), F.col("ts"), n_chains).alias("chain_id"), *AU.ENTRY_COLS, AU.entry_body().alias("body"))
    seed = None if anchors is None else anchors.select("chain_id", "n_entries", "head_hash").groupBy("chain_id")
    return src.groupBy("chain_id").transformWithStateInPandas(ChainAppender(), AU.CHAIN_SCHEMA, "Append", "None", initialState=seed)
