"""The saved scorer: a new session, a stream and the batch job score with it, without fitting."""
import subprocess
import sys
import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from conftest import SF_SMALL
from surveil.operators import labels as LB
from surveil.operators.scorer_model import AbuseScorer, AbuseScorerModel
from surveil.plans import medallion as M
from surveil.session import checkpoint_dir, stored
from surveil.sources import feed

COLS = ["trader_id", "symbol", "window_start", "raw_score", "ml_score", "conformal_set", "needs_human",
        "shap_base_value", "shap_values"]


@pytest.fixture(scope="module")
def saved(spark):
    d = tempfile.mkdtemp(prefix="saved-scorer-", dir=checkpoint_dir(spark))
    lw = stored(LB.labelled_windows(M.gold(spark, SF_SMALL), feed.labels(spark, SF_SMALL)), "lw")
    model = AbuseScorer(maxIter=5, alpha=0.2).fit(lw)
    model.write().overwrite().save(f"{d}/model")
    scores = model.transform(lw)
    lw.write.mode("overwrite").parquet(f"{d}/windows")
    scores.select(COLS).write.mode("overwrite").parquet(f"{d}/scores")
    return d, lw, model


def _same(a, b):
    return a.select(COLS).exceptAll(b.select(COLS)).isEmpty() and b.select(COLS).exceptAll(a.select(COLS)).isEmpty()


def test_reloaded_model_scores_alike(spark, saved):
    d, lw, model = saved
    again = AbuseScorerModel.load(f"{d}/model")
    assert again.uid == model.uid and again.getOrDefault("alpha") == 0.2 and again.getOrDefault("maxIter") == 5
    assert (again.scorer.qhat, again.scorer.n_cal) == (model.scorer.qhat, model.scorer.n_cal)
    assert _same(again.transform(lw), spark.read.parquet(f"{d}/scores"))
    assert again.transform(lw.limit(0)).isEmpty()


def test_a_new_session_scores_alike(saved):
    code = f"""
from surveil.session import build_session
from surveil.operators.scorer_model import AbuseScorerModel
s = build_session("local[2]", 2, extra={{"spark.driver.memory": "2g"}})
got = AbuseScorerModel.load("{saved[0]}/model").transform(s.read.parquet("{saved[0]}/windows")).select({COLS!r})
want = s.read.parquet("{saved[0]}/scores")
print("equal", got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), want.count() > 0)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=400)
    assert "equal True True" in out.stdout, out.stderr[-2000:]


def test_stream_scores_alike(spark, saved):
    d, lw, _ = saved
    s = AbuseScorerModel.load(f"{d}/model").transform(spark.readStream.schema(lw.schema).parquet(f"{d}/windows"))
    q = (s.select(COLS).writeStream.format("memory").queryName("scored_stream").option("checkpointLocation", f"{d}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert _same(spark.table("scored_stream"), spark.read.parquet(f"{d}/scores"))


def test_stage_of_a_pipeline(spark, saved):
    d, lw, model = saved
    PipelineModel([model]).write().overwrite().save(f"{d}/pipeline")
    assert _same(PipelineModel.load(f"{d}/pipeline").transform(lw), spark.read.parquet(f"{d}/scores"))
    Pipeline(stages=[AbuseScorer(maxIter=7)]).write().overwrite().save(f"{d}/unfitted")
    assert Pipeline.load(f"{d}/unfitted").getStages()[0].getOrDefault("maxIter") == 7


def test_batch_job_scores_without_fitting(spark, saved, monkeypatch):
    from surveil.operators import scorer as SC
    from surveil.plans import batch
    d, _, _ = saved
    monkeypatch.setattr(SC, "fit", lambda *a, **k: pytest.fail("fitted again"))
    t = batch.run(spark, SF_SMALL, f"{d}/job", prefix="saved", granularity="month", score=True, model_path=f"{d}/model")
    got = spark.table(t["scores"]).select("trader_id", "symbol", "window_start", "ml_score")
    want = spark.read.parquet(f"{d}/scores").select(got.columns)
    assert got.exceptAll(want).isEmpty() and spark.table(t["alerts_scored"]).filter(F.col("ml_score").isNull()).isEmpty()
