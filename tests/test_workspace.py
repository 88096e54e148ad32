"""Shared folders: demanded on clusters, removed on request."""

from types import SimpleNamespace

import pytest

from reelframe.sources import workspace


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: other), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_path(session, "x")


def test_written_tables_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(workspace, "_handed_out", [])
    path = workspace.shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert workspace.clear(spark) == 1 and workspace.clear(spark) == 0
