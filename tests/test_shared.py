import os

import pytest

from docquarry.functions.values import spare
from docquarry.sources import shared


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)

    def set(self, key, value):
        self[key] = value


class Session:
    """A session as far as shared_dir() looks at one."""

    def __init__(self, master, **settings):
        self.conf = Conf(settings)
        self.sparkContext = self
        self.master = master

    def getConf(self):  # noqa: N802
        return Conf()


def test_folder_is_the_one_that_is_set():
    assert shared.shared_dir(Session("spark://x:7077", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(ValueError):
        shared.shared_dir(Session("spark://x:7077"))


def test_a_local_master_gets_a_folder_once():
    session = Session("local[2]")
    assert shared.shared_dir(session).startswith("file://") and shared.shared_dir(session) == shared.shared_dir(session)


def test_passing_tables_go(spark):
    with shared.passing(spark):
        df = shared.cut(spark.range(5), "passing-test")
        files = df.inputFiles()
        with shared.passing(spark):
            inner = shared.cut(spark.range(2), "inner-test").inputFiles()
        assert not os.path.exists(inner[0].removeprefix("file://")) and os.path.exists(files[0].removeprefix("file://"))
        assert df.count() == 5
    assert not os.path.exists(files[0].removeprefix("file://"))
    assert shared.cut(spark.range(3), "stays").count() == 3


def test_spare_names(spark):
    assert spare(spark.range(1), "x", "y") == ["_x", "_y"]
    df = spark.range(1).selectExpr("id", "1 as _X", "2 as `_y__1`")
    assert spare(df, "x", "y") == ["_x__2", "_y__2"]
