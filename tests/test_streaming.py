"""Streams equal their batch twins, survive restarts and count late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lendwell.plans import requests as rq
from lendwell.plans import training
from lendwell.plans.features import risk_features
from lendwell.sources.adapter import stream, view
from lendwell.streaming import daily, scoring
from conftest import SMALL

AT = dt.datetime(2001, 8, 2, 12, 0)
SCORES = "prediction_date timestamp_ntz, risk_category string, risk_score double, default_probability double"


def scores(spark, days):
    rows = [(d, "High", 70.0, 0.7) for d in days]
    df = spark.createDataFrame(rows, "d string, risk_category string, risk_score double, default_probability double")
    return df.select(F.col("d").cast("timestamp_ntz").alias("prediction_date"), "risk_category", "risk_score", "default_probability")


def run_daily(spark, source, out, progress):
    daily.write_daily(spark.readStream.schema(SCORES).parquet(source), out, progress).awaitTermination()
    return {str(r["report_date"]): r["total_assessments"] for r in daily.read_daily(spark, out).collect()}


def test_late_rows_count_and_restarts_do_not(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    scores(spark, ["2001-01-01", "2001-01-01 23:00:00", "2001-01-02", "2001-01-05"]).write.mode("append").parquet(source)
    assert run_daily(spark, source, out, progress) == {"2001-01-01": 2, "2001-01-02": 1, "2001-01-05": 1}
    # A restart without new files adds nothing.
    assert run_daily(spark, source, out, progress) == {"2001-01-01": 2, "2001-01-02": 1, "2001-01-05": 1}
    # A row for an old day counts for that day, in a second and a third delivery.
    scores(spark, ["2001-01-01", "2001-01-05 10:00:00", "2001-01-09"]).write.mode("append").parquet(source)
    want = {"2001-01-01": 3, "2001-01-02": 1, "2001-01-05": 2, "2001-01-09": 1}
    assert run_daily(spark, source, out, progress) == want
    scores(spark, ["2000-12-31", "2001-01-02"]).write.mode("append").parquet(source)
    want |= {"2000-12-31": 1, "2001-01-02": 2}
    assert run_daily(spark, source, out, progress) == want
    # All deliveries together equal one batch over the table.
    whole = daily.daily_parts(spark.read.parquet(source)).collect()
    assert {str(r["report_date"]): r["total_assessments"] for r in whole} == want
    assert all(r["avg_risk_score"] == 70.0 for r in daily.read_daily(spark, out).collect())


def test_no_scores_yet(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    scores(spark, []).write.parquet(source)
    assert run_daily(spark, source, out, progress) == {}


def test_days_do_not_depend_on_the_session_zone(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
        scores(spark, ["2001-01-01", "2001-01-01 23:00:00", "2001-01-05"]).write.parquet(source)
        assert run_daily(spark, source, out, progress) == {"2001-01-01": 2, "2001-01-05": 1}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture(scope="module")
def model(small):
    rows = training.prepare(risk_features(*small.staging))
    return training.PipelineModel(
        stages=[*rows.preparation.stages, training.classifier("random_forest", 1).setNumTrees(5).fit(rows.train)])


def test_request_stream_equals_batch(spark, small, model, tmp_path):
    people = rq.customer_table(small.customers, small.credit_history, small.transactions)
    people.write.parquet(str(tmp_path / "people"))
    people = spark.read.parquet(str(tmp_path / "people"))
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        scoring.score_stream(stream(spark, SMALL, "requests"), model, people, out, progress, AT).awaitTermination()
        return spark.read.parquet(out).drop("batch")

    batch = scoring.responses(model, rq.request_features(view(spark, SMALL, "requests"), people), AT)
    columns = sorted(batch.columns)
    expected = sorted(map(str, batch.select(columns).collect()))
    assert sorted(map(str, run().select(columns).collect())) == expected
    assert sorted(map(str, run().select(columns).collect())) == expected
    assert {r["timestamp"] for r in batch.select("status", "timestamp").filter("status = 'success'").collect()} == {AT}
    # The purpose of a request reaches the model.
    assert batch.count() == view(spark, SMALL, "requests").count()
    failed = batch.filter("status = 'error'")
    assert failed.filter("risk_score IS NOT NULL OR message IS NULL OR timestamp IS NOT NULL").count() == 0
