"""One local session for all tests; Python workers find the package by the path set here."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from panelforge.session import get_session

    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = get_session("local[4]", 4, **{"spark.checkpoint.dir": f"{shared}/shared", "spark.sql.warehouse.dir": f"{shared}/warehouse", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
