"""The shared folder with and without the cluster's setting."""

import os
from types import SimpleNamespace

import pytest

from tracetide import session


def fake(master, value=None, app="app-1"):
    conf = SimpleNamespace(get=lambda key, default=None: value if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_the_setting_wins():
    assert session.shared_root(fake("spark://x", "hdfs://y/z")) == "hdfs://y/z"
    assert session.work_path(fake("spark://x", "hdfs://y/z/"), "a").startswith("hdfs://y/z/a-")


def test_a_local_session_has_one_folder_of_its_own():
    first = session.shared_root(fake("local[2]"))
    assert os.path.isdir(first) and session.shared_root(fake("local[2]")) == first
    assert session.shared_root(fake("local[2]", app="app-2")) != first


def test_a_cluster_needs_the_setting():
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.shared_root(fake("spark://x"))


def test_folders_are_removed_below_the_shared_one_only(spark, tmp_path):
    path = session.work_path(spark, "gone")
    spark.range(3).write.parquet(path)
    session.remove(spark, [path, session.work_path(spark, "never-written")])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    spark.range(3).write.parquet(f"{tmp_path}/own")
    with pytest.raises(ValueError, match="shared folder"):
        session.remove(spark, [f"{tmp_path}/own"])
    assert spark.read.parquet(f"{tmp_path}/own").count() == 3
