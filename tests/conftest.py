"""Shared session."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shiftlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """One local session whose checkpoint folder is a test folder."""
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    """Make a small table from tuples."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture()
def tiny_limits(spark):
    """Shrink all limits so that every operator takes its large-data form."""
    changed = {
        "spark.shiftlens.smallPlanBytes": "0",
        "spark.shiftlens.rowsPerBucket": "100",
        "spark.shiftlens.hotRows": "20",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key in changed:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
