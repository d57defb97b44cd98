"""Shared fixtures: one local Spark session for the whole test run."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerlens.session import ensure_checkpoint_dir, get_session

    session = get_session(
        "local[4]",
        app_name="ledgerlens-tests",
        shuffle_partitions=8,
        extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    # tests only: the checkpoint folder is unset locally, so pick our own
    if not session.sparkContext.getCheckpointDir():
        ensure_checkpoint_dir(session, str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def sf_oracle():
    return f"{TESTDATA}/sf0.01"
