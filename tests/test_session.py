"""Where tables between steps are written."""

from types import SimpleNamespace

import pytest

from evgraph.session import work_dir


def session(master, **conf):
    get = lambda key, default=None: conf.get(key, default)
    return SimpleNamespace(
        conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get))
    )


def test_named_folder_first_then_the_warehouse_and_no_local_folder_on_a_cluster():
    local = {"spark.sql.warehouse.dir": "file:/tmp/w"}
    assert work_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs:/s"}, **local)) == "hdfs:/s"
    assert work_dir(session("local[8]", **local)) == "file:/tmp/w"
    assert work_dir(session("yarn", **{"spark.sql.warehouse.dir": "s3://w"})) == "s3://w"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            work_dir(session(master, **local))
