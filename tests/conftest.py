import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tonemill.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    # The tables of the tests are tiny.
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()


@pytest.fixture
def only_shuffles(spark):
    """Treat every lookup side as too large to broadcast."""
    spark.conf.set("spark.tonemill.broadcastRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.tonemill.broadcastRows")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
