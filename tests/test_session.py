"""Where intermediate tables go, and when a table is rewritten."""

from __future__ import annotations

import pytest

from shiftlens import session


class FakeConf:
    def __init__(self, **settings):
        self.settings = {name.replace("_", "."): value for name, value in settings.items()}

    def get(self, name, default=None):
        return self.settings.get(name, default)


class FakeSession:
    def __init__(self, **settings):
        self.conf = FakeConf(**settings)


def test_the_setting_is_followed():
    named = FakeSession(spark_master="spark://host:7077", spark_checkpoint_dir="hdfs://shared/tables/")
    assert session.shared_folder(named) == "hdfs://shared/tables"


def test_a_cluster_needs_the_setting():
    with pytest.raises(RuntimeError):
        session.shared_folder(FakeSession(spark_master="spark://host:7077"))


def test_local_mode_has_one_folder_of_its_own():
    first = session.shared_folder(FakeSession(spark_master="local[4]"))
    assert first.startswith("file:") and first == session.shared_folder(FakeSession(spark_master="local[4]"))


def test_written_tables_lie_in_the_shared_folder(spark):
    rows = session.materialize(spark.range(10).toDF("n"), "numbers")
    assert rows.count() == 10
    assert all(f"{session.shared_folder(spark).removeprefix('file:')}/shiftlens/numbers-" in f for f in rows.inputFiles())

