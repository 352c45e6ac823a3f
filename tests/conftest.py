from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rolloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"
# Column expressions at module level need a session at import time.
SESSION = local_session(8, shuffle_partitions=8)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def apply(spark):
    """Values of a Column expression over rows of one text column each."""

    def run(expression, rows, schema="s string"):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
        return [r[0] for r in frame.orderBy("i").select(expression).collect()]

    return run
