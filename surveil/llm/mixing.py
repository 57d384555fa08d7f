"""Mixing sources to target weights by hierarchical budgets.

The tree is domain -> language -> source. A token budget enters at the root and is shared among the
children of each node in proportion to their weights. A child that cannot use its share (capacity =
its tokens times ``epochs``) is filled, and what it leaves goes to its siblings by weight; only a
node whose children are all full passes less than its share, so a shortage reaches the siblings
before the ancestors. A leaf with budget b and T tokens takes floor(b / T) whole epochs and then a
token-prefix of the next one: its documents in the order of a seeded hash of (doc_id, epoch), as
long as the running token sum stays within the budget.

The prefix is found without sorting a leaf in one task: token sums per (leaf, hash bin) are
pre-aggregated, the bins of a leaf (at most 4096) are accumulated, and only the bin in which the
budget ends is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveil.session import stored

LEVELS = ("domain", "lang", "source")
NONE = "(none)"          # name of the branch of null languages and sources
BIN_SHIFT = 52           # top 12 bits of the order hash: 4096 bins a leaf


@dataclass
class Weights:
    """Weight of each child by level and name; names not listed weigh ``other``."""

    domain: dict[str, float] = field(default_factory=lambda: {"web": 3.0, "curated": 2.0})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0})
    source: dict[str, float] = field(default_factory=dict)
    other: float = 1.0

    def column(self, level: str) -> Column:
        table = getattr(self, level)
        if not table:
            return F.lit(self.other)
        pairs = [F.lit(x) for kv in table.items() for x in kv]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level)), F.lit(self.other))


def domain_of(source: Column) -> Column:
    """Default domain of a source: numbered 10 or more is curated, any other web."""
    return F.when(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("long") >= 10, "curated").otherwise("web")


def leaves_of(docs: DataFrame, carry: list[str], domain=domain_of) -> DataFrame:
    """(row struct of the ``carry`` columns, domain, lang, source, tokens, doc_id) per row.

    tokens = words of the text (``[^\\x20\\x09-\\x0D]+``), 0 for null; the struct keeps the caller's
    columns apart from the helper columns, whatever their names."""
    source = F.coalesce(docs["source"].cast("string"), F.lit(NONE))
    return docs.select(
        F.struct(*[docs[c] for c in carry]).alias("row"), docs["doc_id"].alias("doc_id"), domain(source).alias("domain"),
        F.coalesce(docs["lang"].cast("string"), F.lit(NONE)).alias("lang"), source.alias("source"),
        F.coalesce(F.regexp_count(docs["text"], F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("tokens"))


def share(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Replace ``budget`` (the parent's) by each child's share; needs columns weight and cap.

    Children are saturated in the order of cap / weight; the rest split what is left by weight.
    Weight 0 or less gives 0."""
    order = Window.partitionBy(*parent).orderBy(F.col("fill"), F.col(child))
    all_ = Window.partitionBy(*parent)
    live = F.col("weight") > 0
    x = children.withColumn("fill", F.when(live, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    x = x.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("open", F.sum(F.when(live, F.col("weight")).otherwise(0.0)).over(order.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("full", live & (F.col("before") + F.col("fill") * F.col("open") <= F.col("budget")))
    x = x.withColumn("used", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(all_))
    x = x.withColumn("rest", F.sum(F.when(live & ~F.col("full"), F.col("weight")).otherwise(0.0)).over(all_))
    got = (F.when(F.col("full"), F.col("cap")).when(live, (F.col("budget") - F.col("used")) * F.col("weight") / F.col("rest"))
           .otherwise(0.0))
    return x.withColumn("budget", F.least(F.col("cap"), got)).drop("fill", "before", "open", "full", "used", "rest")


def budgets(leaves: DataFrame, budget: float | None, fraction: float, epochs: int, weights: Weights) -> DataFrame:
    """(domain, lang, source, tokens, budget) per leaf; ``budget`` tokens, or ``fraction`` of all tokens."""
    leaf = stored(leaves.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = float(leaf.agg(F.sum("tokens")).first()[0] or 0) * fraction if budget is None else float(budget)
    out = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[:depth + 1])
        node = leaf.groupBy(*keys).agg((F.sum("tokens") * F.lit(float(epochs))).alias("cap")).withColumn("weight", weights.column(level))
        node = node.withColumn("budget", F.lit(total)) if out is None else node.join(out, list(LEVELS[:depth]))
        out = share(node, list(LEVELS[:depth]) or [F.lit(0)], level).select(*keys, "budget")
    return leaf.join(out, list(LEVELS)).withColumn("budget", F.floor(F.col("budget") + F.lit(1e-6)).cast("long"))


def _order(seed: int) -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("epochs") + F.lit(seed << 16))


def cuts(leaves: DataFrame, leaf_budgets: DataFrame, seed: int) -> DataFrame:
    """(domain, lang, source, epochs, bin, cut): whole epochs, then the part of the next epoch with
    hash bin below ``bin``, or equal to it and hash up to ``cut``."""
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    leaf = leaf_budgets.withColumn("epochs", whole)
    leaf = stored(leaf.select(*LEVELS, "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest")), "budgets")
    keyed = (leaves.select(*LEVELS, "doc_id", F.col("tokens").alias("n")).join(leaf, list(LEVELS)).filter("rest > 0")
             .withColumn("h", _order(seed)).withColumn("bin", F.shiftright("h", BIN_SHIFT)))
    run = Window.partitionBy(*LEVELS).orderBy("bin")
    bins = (keyed.groupBy(*LEVELS, "bin").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
            .withColumn("upto", F.sum("n").over(run)))
    edge = stored(bins.filter("upto > rest").groupBy(*LEVELS).agg(
        F.min("bin").alias("bin"), F.min_by(F.col("rest") - F.col("upto") + F.col("n"), "bin").alias("left")), "edges")
    inside = Window.partitionBy(*LEVELS).orderBy("h")     # ties (repeated doc_ids) are taken together
    last = (keyed.select(*LEVELS, "bin", "h", "n").join(edge, [*LEVELS, "bin"])
            .withColumn("upto", F.sum("n").over(inside)).filter(F.col("upto") <= F.col("left"))
            .groupBy(*LEVELS).agg(F.max("h").alias("cut")))
    return stored(leaf.join(edge.drop("left"), list(LEVELS), "left").join(last, list(LEVELS), "left")
                  .select(*LEVELS, "epochs", "bin", "cut"), "cuts")


def select(leaves: DataFrame, leaf_cuts: DataFrame, seed: int) -> DataFrame:
    """The chosen rows of ``leaves``, one per epoch in which a row is taken, plus ``epoch``."""
    h = _order(seed)
    bin_ = F.shiftright(h, BIN_SHIFT)
    part = F.coalesce((bin_ < F.col("bin")) | ((bin_ == F.col("bin")) & (h <= F.col("cut"))), F.lit(False))
    times = F.col("epochs") + part.cast("long")
    rows = leaves.join(leaf_cuts, list(LEVELS)).withColumn("times", times).filter("times > 0")
    return rows.withColumn("epoch", F.explode(F.expr("sequence(0L, times - 1)"))).drop("times", "epochs", "bin", "cut")


def mix(docs: DataFrame, budget: float | None = None, fraction: float = 0.7, epochs: int = 2, weights: Weights | None = None,
        seed: int = 0, domain=domain_of) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epoch) of the chosen documents.

    Null text has 0 tokens; null lang or source is the branch ``(none)``; rows with one doc_id share
    a place in the order and are taken or left together; a null doc_id is ordered like any value.
    Other columns are not read. An empty table gives an empty result."""
    leaves = stored(leaves_of(docs, ["doc_id"], domain), "documents")
    plan = cuts(leaves, budgets(leaves, budget, fraction, epochs, weights or Weights()), seed)
    return select(leaves, plan, seed).select("doc_id", *LEVELS, "tokens", "epoch")


def mix_rows(docs: DataFrame, budget: float | None = None, fraction: float = 0.7, epochs: int = 1, weights: Weights | None = None,
             seed: int = 0, domain=domain_of) -> DataFrame:
    """``mix`` returning the chosen rows with the columns of ``docs`` (repeated per epoch)."""
    thin = stored(leaves_of(docs, ["doc_id"], domain), "documents")
    plan = cuts(thin, budgets(thin, budget, fraction, epochs, weights or Weights()), seed)
    return select(leaves_of(docs, docs.columns, domain), plan, seed).select("row.*")
