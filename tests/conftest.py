import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from lendwell.session import local_session  # noqa: E402
from lendwell.sources.adapter import lending_tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"
AS_OF = dt.date(2001, 8, 2)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def many_runs(spark):
    """Keep every shuffle partition, so that ordered work spans several runs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="session")
def small(spark):
    return lending_tables(spark, SMALL)
