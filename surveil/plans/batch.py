"""Batch job: run the medallion once and write every layer as a table.

Each layer is written (day-partitioned parquet under ``root``, registered in its
namespace) and the next layer reads the written table, so lineage is cut at every layer:
a lost executor recomputes at most one layer from files, and every downstream report
reads storage instead of re-running the feed.  The tagged feed is evaluated once; clean and
quarantined rows are two partitions of that table.  With ``days`` only those event days are read
and rewritten (dynamic partition overwrite): earlier days stay as they are.  Audit entries
record each table write.  With ``score`` a model is fitted and saved under ``root`` / ``MODEL``;
later runs name it in ``model_path`` and score without fitting.

    spark-submit surveil/plans/batch.py <tables> <root> [first day, day after last]
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from surveil.operators import audit as AU
from surveil.operators import bronze as B
from surveil.operators import detectors as D
from surveil.operators import gold as G
from surveil.operators import silver as S
from surveil.session import stored
from surveil.sources import catalog, feed


MODEL = "ml/models/scorer"


def run(spark: SparkSession, sf_dir: str, root: str, window_ms: int = 60_000, created_at: int = 0,
        n_chains: int = AU.N_CHAINS, prefix: str = "surveil", granularity: str = "day",
        score: bool = False, ml_max_iter: int = 100, model_path: str | None = None,
        days: tuple[str, str] | None = None) -> dict[str, str]:
    tables: dict[str, str] = {}
    writes: list[tuple[str, str, int, int]] = []

    def in_days(df, time_col="transact_time"):
        if days is None:
            return df
        first, end = (F.lit(d).cast("date") for d in days)
        day = catalog.event_date(time_col)
        return df.filter((day >= first) & (day < end))

    def write(df, layer, name, time_col="transact_time"):
        t = catalog.write_layer(df, root, layer, name, time_col=time_col, prefix=prefix, granularity=granularity,
                                replace_days=days is not None)
        tables[name] = t
        table = in_days(spark.table(t), time_col) if time_col else spark.table(t)
        writes.append((t, f"{root.rstrip('/')}/{layer}/{name}", table.count(), int(time.time() * 1000)))
        return table.drop("event_date") if "event_date" in table.columns and "event_date" not in df.columns else table

    # rows without a time are quarantined under the null day: they belong to every run's feed
    tagged = B.tag(feed.raw_feed(spark, sf_dir))
    if days is not None:
        tagged = tagged.filter(F.col("transact_time").isNull()).unionByName(in_days(tagged.filter(F.col("transact_time").isNotNull())))
    landed = stored(tagged, "landing")
    bronze = write(landed.filter(F.size("_dq_missing") == 0).drop("_dq_missing"), "bronze", "events")
    write(landed.filter(F.size("_dq_missing") > 0), "bronze", "quarantine")
    silver = write(S.to_silver(bronze), "silver", "events")
    gold = write(G.to_gold(silver, window_ms), "gold", "windows", time_col="window_start")
    alerts = write(D.detect(gold, created_at=created_at), "alerts", "alerts", time_col="window_start")
    entries = AU.entries_from_alerts(alerts)
    chain = write(AU.append(AU.assign_chains(entries, n_chains=n_chains)), "governed_output", "audit_chain",
                  time_col=None)
    anchors = write(AU.anchor(chain, n_chains), "governed_output", "audit_anchors", time_col=None)
    if score:
        from surveil.operators import labels as LB
        from surveil.operators import scorer as SC
        from surveil.operators.scorer_model import AbuseScorer, AbuseScorerModel
        if model_path:
            saved = AbuseScorerModel.load(model_path)
        else:
            saved = AbuseScorer(maxIter=ml_max_iter).fit(LB.labelled_windows(gold, feed.labels(spark, sf_dir), window_ms))
            saved.write().overwrite().save(f"{root.rstrip('/')}/{MODEL}")
        model = saved.scorer
        write(SC.score(model, gold, explain=False), "ml", "scores", time_col="window_start")
        enriched = write(SC.enrich_alerts(alerts, SC.score(model, SC.alerted_windows(gold, alerts))), "alerts", "alerts_scored", time_col="window_start")
        # scoring is its own audit entry, appended to the same chains (the emission digest is untouched)
        ml_entries = _ml_entries(enriched)
        new = AU.append(AU.assign_chains(ml_entries, n_chains=n_chains), anchors=anchors)
        catalog.write_layer(new, root, "governed_output", "audit_chain", time_col=None, prefix=prefix, mode="append")
        chain = spark.table(tables["audit_chain"])
        write(AU.anchor(chain, n_chains), "governed_output", "audit_anchors", time_col=None)
    lineage = AU.append(AU.assign_chains(AU.table_written_entries(spark, writes), n_chains=1))
    catalog.write_layer(lineage, root, "governed_output", "lineage_chain", time_col=None, prefix=prefix)
    tables["lineage_chain"] = f"{prefix}_governed_output.lineage_chain"
    return tables


def _ml_entries(enriched):
    """One ML_SCORED entry per alert: payload = rendered ml_score and top feature name."""
    from pyspark.sql.types import DoubleType, StringType
    from surveil.functions import grammar
    top = F.element_at("shap_top_features", 1)["feature_name"]
    return enriched.select(F.lit("ml").alias("subsystem"), F.lit("ML_SCORED").alias("action"),
                           F.col("alert_id").alias("ref_id"), F.col("created_at").alias("ts"),
                           F.array(grammar.canonical_field(F.col("ml_score"), DoubleType()),
                                   grammar.canonical_field(top, StringType())).alias("payload"))


def main() -> None:
    from surveil.session import build_session, checkpoint_dir
    if len(sys.argv) not in (3, 5):
        sys.exit("usage: batch.py <tables> <root> [first day, day after last]")
    spark = build_session(app="surveil-batch")
    checkpoint_dir(spark)
    for name, table in run(spark, sys.argv[1], sys.argv[2], days=tuple(sys.argv[3:5]) or None).items():
        print(name, table, spark.table(table).count())


if __name__ == "__main__":
    main()
