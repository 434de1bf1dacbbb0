from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barflow import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", "local[8]", 4, memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def _engine_lives(request):
    """Stops the run where Spark's JVM has died, instead of failing every test that follows."""
    yield
    if "spark" in request.fixturenames:
        try:
            request.getfixturevalue("spark").sparkContext._jsc.sc().isStopped()
        except Exception as error:
            pytest.exit(f"Spark's JVM is gone: {error}", returncode=3)


@pytest.fixture(params=["single", "blocked"])
def mode(request, spark):
    """Run a test with one task per key and with blocks of 7 rows."""
    if request.param == "blocked":
        spark.conf.set(session.SINGLE_TASK_BYTES[0], "-1")
        spark.conf.set(session.BLOCK_ROWS[0], "7")
    yield request.param
    for name, _ in (session.SINGLE_TASK_BYTES, session.BLOCK_ROWS):
        spark.conf.unset(name)
