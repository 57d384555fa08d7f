"""Session helpers: no silent local folders on a cluster, no sizes set behind the caller's back."""
import inspect
from types import SimpleNamespace

import pytest

from surveil import session


def _fake(master):
    none = SimpleNamespace(isDefined=lambda: False, isEmpty=lambda: True)
    sc = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, d=None: d),
                         _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)),
                         setCheckpointDir=lambda d: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=sc)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_unset_checkpoint_folder_raises_on_a_cluster(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_fake(master))


def test_local_master_gets_a_scratch_folder():
    assert "surveil-ckpt-" in session.checkpoint_dir(_fake("local[4]"))


def test_master_and_shuffle_count_are_off_by_default():
    args = inspect.signature(session.build_session).parameters
    assert args["master"].default is None and args["shuffle_partitions"].default is None


def test_stored_table_reads_back(spark):
    df = spark.range(10).selectExpr("id", "cast(null as string) as s")
    t = session.stored(df, "unit")
    assert t.schema == df.schema or [f.dataType for f in t.schema] == [f.dataType for f in df.schema]
    assert t.count() == 10 and session.stored(df.limit(0), "unit").count() == 0
