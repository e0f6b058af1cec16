import os
from types import SimpleNamespace

import pytest

from tidemark.functions import stored


def session(master, found=None):
    conf = SimpleNamespace(get=lambda key, default=None: found)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: SimpleNamespace(get=lambda key: found)))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            stored.shared_dir(session(master))
        assert stored.shared_dir(session(master, "hdfs://store/shared/")) == "hdfs://store/shared"
    assert stored.shared_dir(session("local[4]")) == stored.shared_dir(session("local[4]")) != "/tmp"


def test_replaced_tables_are_deleted(spark):
    one = stored.materialise(spark.range(5))
    two = stored.materialise(one.selectExpr("id + 1 AS id"), one)
    assert sorted(r.id for r in two.collect()) == [1, 2, 3, 4, 5]
    at = [x.stored_at.removeprefix("file:") for x in (one, two)]
    assert not os.path.exists(at[0]) and os.path.exists(at[1])
