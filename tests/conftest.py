from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitrep.session import local_session  # noqa: E402


# started on import: column expressions in test modules need a session
SESSION = local_session("tests", 8, memory="6g")
SESSION.conf.set("spark.sql.shuffle.partitions", "2")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def values(spark):
    """Values of one expression over single-column rows."""

    def run(expression, inputs, ddl="c string"):
        rows = [(i, v) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, {ddl}")
        return [r[0] for r in df.orderBy("i").select(expression).collect()]

    return run
