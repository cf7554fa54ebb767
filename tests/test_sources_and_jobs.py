"""Reading, writing, repeated runs and the daily sequence of jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lendwell import schemas
from lendwell.operators.quality import DataQualityError
from lendwell.plans import dashboard, jobs, scoring
from lendwell.sources import tables

AT = dt.datetime(2001, 8, 2, 2, 0)


@pytest.fixture(scope="module")
def linked(small):
    """Staging tables without the credit records that belong to nobody."""
    frames = dict(zip(schemas.STAGING, small.staging))
    frames["credit_history"] = frames["credit_history"].filter("customer_id IS NOT NULL")
    return frames


@pytest.fixture(scope="module")
def staging(linked, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("staging"))
    tables.overwrite_staging(linked, root)
    return root


def test_staging_round_trip(spark, staging, linked):
    data = tables.read_staging(spark, staging)
    for name, schema in schemas.STAGING.items():
        assert data[name].columns == list(schemas.fields(schema))
        assert data[name].count() == linked[name].count()


def test_rerun_of_staging_replaces(spark, staging, linked):
    tables.overwrite_staging({"customers": linked["customers"]}, staging)
    assert tables.read_staging(spark, staging)["customers"].count() == 150


def test_daily_run_twice(spark, staging, tmp_path, monkeypatch):
    monkeypatch.setattr("lendwell.plans.training.MODELS", ("random_forest",))
    monkeypatch.setattr("lendwell.plans.training.TREES", 5)
    result = jobs.daily_run(spark, staging, str(tmp_path), AT)
    assert result["features"] == 1500 and result["predictions"] == 1500
    assert result["quality"]["failures"] == 0
    summary = spark.read.json(f"{tmp_path}/run_summary").first()
    assert (summary["status"], summary["features_generated"], summary["new_predictions"]) == ("success", 1500, 1500)
    assert summary["failures"] == 0 and summary["auc_roc"] == result["metrics"]["auc_roc"]
    stored = tables.read_predictions(spark, f"{tmp_path}/risk_scores")
    assert stored.filter(F.col("prediction_day") == dt.date(2001, 8, 2)).count() == 1500
    features, model = f"{tmp_path}/risk_features", f"{tmp_path}/models/model"
    assert jobs.score(spark, features, model, f"{tmp_path}/risk_scores", AT) == 0
    later = AT + dt.timedelta(days=1)
    assert jobs.score(spark, features, model, f"{tmp_path}/risk_scores", later) == 1500
    assert jobs.importances(spark, f"{tmp_path}/models").count() == 20
    sample = tables.read_features(spark, features).limit(3)
    jobs.deploy(spark, f"{tmp_path}/models", f"{tmp_path}/metadata", sample, 1, "v1.0.0", AT)
    row = tables.read_metadata(spark, f"{tmp_path}/metadata").first()
    assert row["features_used"][0] == "age" and len(row["features_used"]) == 20
    assert row["accuracy"] == result["metrics"]["accuracy"]


def test_failed_quality_stops_the_run(spark, small, tmp_path):
    root = str(tmp_path / "staging")
    tables.overwrite_staging(dict(zip(schemas.STAGING, small.staging)), root)
    with pytest.raises(DataQualityError):
        jobs.daily_run(spark, root, str(tmp_path), AT)
    summary = spark.read.json(f"{tmp_path}/run_summary").first()
    assert summary["status"].startswith("failed: ") and summary["failures"] == 1
    assert summary["features_generated"] == 0 and "auc_roc" not in summary


def test_predictions_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "scores")
    scored = spark.createDataFrame([(1, 10, 0.2), (2, 20, 0.7)], "customer_id bigint, loan_id bigint, default_probability double")
    rows = scoring.prediction_rows(scored, AT)
    assert [r["risk_category"] for r in rows.orderBy("loan_id").collect()] == ["Low", "High"]
    for _ in range(2):
        fresh = scoring.not_yet_stored(rows, tables.read_predictions(spark, path))
        tables.append_predictions(fresh, path)
    stored = tables.read_predictions(spark, path)
    assert stored.count() == 2
    assert tables.read_predictions(spark, path, dt.date(2001, 8, 3)).count() == 0
    assert tables.keep_days(stored, dt.date(2001, 12, 1)).count() == 0
    assert tables.keep_days(stored, dt.date(2001, 9, 1)).count() == 2


def test_day_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "scores")
    scored = spark.createDataFrame([(1, 10, 0.2)], "customer_id bigint, loan_id bigint, default_probability double")
    tables.append_predictions(scoring.prediction_rows(scored, AT), path)
    df = tables.read_predictions(spark, path, dt.date(2001, 8, 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prediction_day" in plan


def test_unscored_excludes_null_keys(spark):
    features = spark.createDataFrame([(1, 1), (2, 2), (None, 3)], "customer_id bigint, loan_id bigint")
    scores = spark.createDataFrame([(1, AT), (None, AT)], "customer_id bigint, prediction_date timestamp_ntz")
    found = scoring.unscored(features, scores, dt.date(2001, 8, 2)).collect()
    assert [r["loan_id"] for r in found] == [2]
    assert scoring.unscored(features, scores, dt.date(2001, 8, 3), limit=1).first()["loan_id"] == 1


def test_metadata_and_json(spark, tmp_path):
    row = tables.metadata_row(spark, 3, "m", "v2", {"accuracy": 0.5}, ["a", "b"], AT)
    assert json.loads(row.first()["features_used"]) == ["a", "b"]
    tables.append_metadata(row, str(tmp_path / "meta"))
    stored = tables.read_metadata(spark, str(tmp_path / "meta")).first()
    assert (stored["recall"], stored["features_used"], stored["algorithm"]) == (0.0, ["a", "b"], "RandomForestClassifier")
    df = spark.createDataFrame([("age", 0.5)], schemas.FEATURE_IMPORTANCE)
    tables.write_json(df, str(tmp_path / "json"))
    assert tables.read_json(spark, str(tmp_path / "json"), schemas.FEATURE_IMPORTANCE).collect() == df.collect()


def test_display_sample(small):
    found = [r["customer_id"] for r in dashboard.display_sample(small.customers, "customer_id", 3).collect()]
    assert found == [0, 1, 2]


def test_full_evaluation_tables(spark):
    scores = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.2)], "model_name string, label int, probability double")
    importance = spark.createDataFrame([("a", 0.1), ("b", 0.9)], schemas.FEATURE_IMPORTANCE)
    found = jobs.full_evaluation(scores, importance, top=1)
    assert found["report"].first()["accuracy"] == 1.0
    assert found["feature_importance"].first()["feature"] == "b"
    assert set(found) == {"report", "confusion_matrix", "roc_curve", "pr_curve", "feature_importance"}
