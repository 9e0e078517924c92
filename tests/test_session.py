from __future__ import annotations

from types import SimpleNamespace

import pytest

from shelfline import session


def test_tables_go_to_the_shared_folder(spark, forecast):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_folder(spark) == shared
    stored = session.hand_over(forecast, "stage")
    assert all(shared in path for path in stored.inputFiles())
    assert stored.schema == forecast.schema and stored.count() == forecast.count()
    assert session.cut_lineage(forecast).count() == forecast.count()


def fake(master, directory=None):
    made = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: made[-1] if made else directory, setCheckpointDir=made.append
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("spark://host:7077"))
    assert session.shared_folder(fake("spark://host:7077", "hdfs:///x")) == "hdfs:///x"
    assert "shelfline-" in session.shared_folder(fake("local[2]"))
