"""One local session for all tests; a test that takes the JVM down does not take the others with it."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

_HELD = {}


def _alive(session) -> bool:
    try:
        return not session.sparkContext._jsc.sc().isStopped()
    except Exception:
        return False


def _forget() -> None:
    """Clears what the driver keeps of a JVM that is gone."""
    from pyspark import SparkContext
    from pyspark.sql import SparkSession

    SparkContext._active_spark_context = SparkContext._gateway = SparkContext._jvm = None
    SparkSession._instantiatedSession = None


@pytest.fixture
def spark(tmp_path_factory):
    from weftline.session import session

    if "spark" not in _HELD or not _alive(_HELD["spark"]):
        if "spark" in _HELD:
            _forget()
        _HELD["spark"] = session("weftline-tests", cores=8, spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")))
    return _HELD["spark"]


@pytest.fixture(scope="session", autouse=True)
def _stopped_at_the_end():
    yield
    if "spark" in _HELD and _alive(_HELD["spark"]):
        _HELD["spark"].stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
