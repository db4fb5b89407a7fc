from types import SimpleNamespace

import pytest

from spanloom.plans import storage


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session(master))
    assert storage.shared_dir(session(master, "hdfs://x/shared/")) == "hdfs://x/shared"


def test_one_machine_may_use_its_own():
    assert storage.shared_dir(session("local[4]")).startswith("file:///")


def test_staged_tables_are_removed(spark):
    import os

    rows = storage.staged(spark.range(5))
    folder = storage.own_dir(spark).removeprefix("file://")
    assert rows.count() == 5 and os.listdir(folder)
    kept = {x: os.path.join(folder, x) for x in os.listdir(folder) if x.startswith("stage-")}
    assert kept
    other = SimpleNamespace(**{k: getattr(spark, k) for k in ("conf",)}, sparkContext=SimpleNamespace(
        master=spark.sparkContext.master, applicationId="another", _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc))
    mine = storage.own_dir(other).removeprefix("file://")
    assert os.path.isdir(mine)
    storage.release(other)
    assert not os.path.exists(mine) and all(os.path.exists(x) for x in kept.values())
