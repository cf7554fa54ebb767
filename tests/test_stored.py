"""Stored tables: buckets by key, days replaced alone, opened again by other sessions."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from lendwell.plans import features as feat, feature_queries as fq, reports as rq, scoring
from lendwell.sources import stored, tables

DAY, NEXT = dt.date(2001, 8, 2), dt.date(2001, 8, 3)
AS_OF = DAY


def files(path, day):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/build_day={day}/*.parquet")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """Joins as of tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def wide(small):
    return feat.risk_features(*small.staging)


@pytest.fixture(scope="module")
def kept(wide, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features") / "risk_features")
    tables.store_features(wide, path, DAY)
    return path


def test_round_trip(spark, wide, kept):
    back = tables.read_features(spark, kept)
    assert back.columns == wide.columns and dict(back.dtypes) == dict(wide.dtypes)
    ours, theirs = ([str(r) for r in df.orderBy("loan_id").collect()] for df in (back, wide))
    assert ours == theirs
    assert len(files(kept, DAY)) == stored.BUCKETS


def test_one_day_replaced(spark, wide, tmp_path):
    path = str(tmp_path / "t")
    for day in (DAY, NEXT):
        tables.store_features(wide, path, day)
    before = files(path, DAY)
    tables.store_features(wide.filter("loan_id % 2 = 0"), path, NEXT)
    assert files(path, DAY) == before and stored.days(spark, path) == [DAY, NEXT]
    assert tables.read_features(spark, path).count() == wide.filter("loan_id % 2 = 0").count()
    assert stored.newest_day(spark, path, upto=DAY).count() == wide.count()
    assert stored.newest_day(spark, path, upto=dt.date(2000, 1, 1)).count() == 0
    assert spark.conf.get(stored.OVERWRITE_MODE).lower() == "static"


def test_another_session_learns_days_and_buckets(spark, wide, tmp_path):
    path = str(tmp_path / "t")
    tables.store_features(wide, path, DAY, buckets=3)
    spark.sql(f"DROP TABLE {stored.table_name(path)}")  # as in a session that has not seen the table
    assert len(files(path, DAY)) == 3
    back = tables.read_features(spark, path, by_customer=True)
    assert back.count() == wide.count() and "out of 3" in plan_of(back.groupBy("customer_id").count())
    spark.sql(f"DROP TABLE {stored.table_name(path)}")
    tables.store_features(wide, path, NEXT, buckets=5)  # the stored number holds
    assert stored.layout_of(spark, path).buckets == 3 and stored.days(spark, path) == [DAY, NEXT]


def test_other_key_is_refused(spark, kept, wide):
    with pytest.raises(ValueError):
        stored.replace_days(wide.withColumn("build_day", F.lit(DAY)), kept, "loan_id", "build_day")
    with pytest.raises(ValueError):
        stored.read_stored(spark, kept + "-none")


def exchanges_over_features(plan):
    """Exchanges above the scan of the stored table, by the tree's indentation."""
    lines = plan.split("\n")
    at = [i for i, line in enumerate(lines) if "Scan parquet" in line and "build_day" in line]
    assert at and all("Bucketed: true" in lines[i] for i in at), plan
    found = 0
    for i in at:
        depth = len(lines[i]) - len(lines[i].lstrip(" :+-"))
        for line in reversed(lines[:i]):
            own = len(line) - len(line.lstrip(" :+-"))
            if own < depth:
                depth = own
                found += "Exchange hashpartitioning(customer_id" in line
    return found


def test_no_exchange_of_the_features(spark, small, kept, shuffled):
    features = feat.feature_store(tables.read_features(spark, kept, by_customer=True))
    assert exchanges_over_features(plan_of(scoring.unscored(features, small.risk_scores, dt.date(2001, 6, 1)))) == 0
    by_factor = rq.risk_factors(features, small.credit_history, small.risk_scores, AS_OF)
    assert exchanges_over_features(plan_of(by_factor)) == 0
    best = fq.high_risk_customers(features, small.risk_scores, AS_OF)
    assert exchanges_over_features(plan_of(best)) == 0


def test_hot_customer_is_dealt_out(spark, tmp_path, shuffled):
    path = str(tmp_path / "t")
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("customer_id"), F.col("id").alias("loan_id"), F.lit(DAY).alias("build_day")
    )
    stored.replace_days(rows, path, "customer_id", "build_day", rows_per_task=100)
    assert stored.layout_of(spark, path).hot
    held = spark.read.parquet(path).filter("customer_id = 7").groupBy(F.input_file_name()).count().collect()
    assert len(held) > 3 and sum(r["count"] for r in held) == 1001
    back = stored.newest_day(spark, path)
    assert back.count() == 3000 and "Bucketed: true" not in plan_of(back.groupBy("customer_id").count())


def test_null_keys_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(None, 1), (2, 2), (None, 3)], "customer_id bigint, loan_id bigint").withColumn("build_day", F.lit(DAY))
    stored.replace_days(rows, path, "customer_id", "build_day")
    assert sorted(r["loan_id"] for r in stored.newest_day(spark, path).collect()) == [1, 2, 3]
    stored.replace_days(rows.limit(0), path, "customer_id", "build_day")
    assert stored.newest_day(spark, path).count() == 3
