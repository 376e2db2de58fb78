from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from glintframe.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", master="local[8]", partitions=8, spark__driver__memory="6g", spark__sql__execution__pythonUDF__arrow__enabled="true")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SMALL
