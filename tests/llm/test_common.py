"""The shared folder and the tables in it."""

import os
from types import SimpleNamespace

import pytest

from rasterlake.llm import common


def test_forget_removes_what_was_stored(spark):
    common.forget(spark)
    got = common.stored(spark.range(10), "some-table")
    folder = common.shared_folder(spark).removeprefix("file://")
    assert got.count() == 10 and any(n.startswith("some-table") for n in os.listdir(folder))
    assert common.forget(spark) == 1 and not any(n.startswith("some-table") for n in os.listdir(folder))
    assert common.forget(spark) == 0


def test_no_folder_of_one_machine_on_a_cluster():
    conf = SimpleNamespace(get=lambda name: None)
    session = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="app"))
    with pytest.raises(ValueError):
        common.shared_folder(session)
