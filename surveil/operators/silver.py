"""Silver: normalise + enrich bronze events and drop re-delivered duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveil.schemas import DEDUP_KEY, EVENT_KINDS


ENRICHED_FROM = ["msg_type", "symbol", "side", "order_qty", "price"]      # what ``enrich`` reads
UNMAPPED = {"asset_class": "equity", "desk": "equity"}                    # of every event, where no dimension maps its symbol
SIFT_WORDS = 1 << 20                                                      # rows of the marks that ``repeated`` makes, at most


def event_kind() -> F.Column:
    kind = F.lit("OTHER")
    for code, name in reversed(EVENT_KINDS):
        kind = F.when(F.col("msg_type") == code, F.lit(name)).otherwise(kind)
    return kind


def enrich(bronze: DataFrame, asset_dim: DataFrame | None = None) -> DataFrame:
    """event_kind, asset_class, desk, is_buy, notional.

    ``asset_dim(symbol, asset_class, desk)`` is an optional dimension; Spark picks the join by its
    size. Symbols it does not cover stay equity; of several rows for a symbol the smallest
    (asset_class, desk) counts, so a repeated symbol never multiplies events.
    """
    df = bronze.withColumn("event_kind", event_kind())
    if asset_dim is None:
        df = df.withColumns({c: F.lit(v) for c, v in UNMAPPED.items()})
    else:
        d = (asset_dim.groupBy("symbol").agg(F.min(F.struct("asset_class", "desk")).alias("_d"))
             .select("symbol", F.col("_d.asset_class").alias("_ac"), F.col("_d.desk").alias("_desk")))
        df = (df.join(d, "symbol", "left")
              .withColumn("asset_class", F.coalesce("_ac", F.lit(UNMAPPED["asset_class"])))
              .withColumn("desk", F.coalesce("_desk", F.lit(UNMAPPED["desk"])))
              .drop("_ac", "_desk"))
    return df.withColumns({
        "is_buy": F.col("side") == "1",
        "notional": F.coalesce(F.col("order_qty") * F.col("price"), F.lit(0.0)),
    })


def _word(h: F.Column) -> F.Column:
    return F.shiftrightunsigned(h, 64 - SIFT_WORDS.bit_length() + 1)


def _bit(h: F.Column) -> F.Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def repeated(df: DataFrame, key: list[str] = DEDUP_KEY) -> DataFrame:
    """(_word, _bits): a bit for every key hash that comes more than once, 64 to a row.

    A Bloom filter with one hash: a key that comes twice has its bit set, and so may a few that come once. At most
    ``SIFT_WORDS`` rows at any size of the input, so it can be broadcast."""
    h = F.col("_hash")
    twice = df.groupBy(F.xxhash64(*key).alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return twice.groupBy(_word(h).alias("_word")).agg(F.bit_or(_bit(h)).alias("_bits"))


def dedup(df: DataFrame, key: list[str] = DEDUP_KEY, needed: list[str] | None = None, sift: bool = False) -> DataFrame:
    """Keep one row per duplicate key (NULL = NULL), deterministically.

    An aggregate rather than a window: the map side collapses copies before the
    shuffle, so even a group of copies holding a large share of all rows costs one
    partial-aggregate row per task.  The survivor is the earliest delivery (least
    ``_ingest_ts``, like the streaming dedup which keeps the first arrival), then the
    least row by value: stable under recomputation.

    ``needed``: the columns that the plan behind reads. The least row begins with the least row of its first
    columns, so columns behind the last needed one change neither the survivor's other values nor the number of
    rows, and do not ride through the shuffle.

    ``sift``: first count the hashes of the keys (8 bytes a row to shuffle) and send only the rows whose hash comes
    more than once (``repeated``) through the aggregate. All others stay where they are, for the aggregates behind
    to combine before their own shuffle. ``df`` is read three times, so it must give the same rows each time.
    """
    rest = [c for c in df.columns if c not in key]
    rest = sorted(rest, key=lambda c: c != "_ingest_ts")  # ingest time first, order otherwise kept
    if needed is not None:
        rest = rest[:1 + max((i for i, c in enumerate(rest) if c in needed), default=0)]
    kept = [c for c in df.columns if c in key or c in rest]

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*").select(*kept)
    if not sift:
        return least(df)
    h = F.col("_hash")
    marked = df.withColumn("_hash", F.xxhash64(*key)).withColumn("_word", _word(h)).join(F.broadcast(repeated(df, key)), "_word", "left")
    again = F.coalesce(F.col("_bits").bitwiseAND(_bit(h)) != 0, F.lit(False))
    return marked.filter(~again).select(*kept).unionByName(least(marked.filter(again).select(*df.columns)))


def to_silver(bronze: DataFrame, asset_dim: DataFrame | None = None, needed: list[str] | None = None, sift: bool = False) -> DataFrame:
    """Dedup first, then enrich: the derived columns are a projection of the survivor,
    so they need not ride through the shuffle. ``needed``: bronze columns that are read behind it (all by default);
    ``sift``: see ``dedup``."""
    return enrich(dedup(bronze, needed=None if needed is None else [*needed, *ENRICHED_FROM], sift=sift), asset_dim)


def dup_audit(bronze: DataFrame, key: list[str] = DEDUP_KEY) -> DataFrame:
    """Duplicate keys and their copy counts (what dedup removed)."""
    return (bronze.groupBy(*key).agg(F.count(F.lit(1)).alias("n_copies"))
            .filter(F.col("n_copies") > 1))
