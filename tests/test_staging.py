from types import SimpleNamespace

import pytest

from outvote import staging


def session(folder, master):
    context = SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)


def test_the_configured_folder_is_used():
    assert staging.shared_folder(session("hdfs://shared/x", "yarn")) == "hdfs://shared/x"


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(session(None, "yarn"))


def test_staged_tables_have_no_lineage(spark):
    df = staging.stage(spark.range(10).selectExpr("id", "id * 2 as v"), "t")
    assert "Range" not in df._jdf.queryExecution().toString()
    assert sorted(r["v"] for r in df.collect()) == list(range(0, 20, 2))
