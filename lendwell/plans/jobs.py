"""The daily run: freshness, quality, features, training, scoring, summary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwell.operators import check_state, evaluation, quality
from lendwell.plans import scoring, training
from lendwell.plans.features import risk_features
from lendwell.schemas import FEATURE_IMPORTANCE, MODEL_METRICS
from lendwell.session import checkpointed, day
from lendwell.sources import models, stored, tables

SERVING_MODEL = "random_forest"


def build_features(
    spark: SparkSession, staging: str, out: str, at: dt.date | None = None, buckets: int = stored.BUCKETS
) -> int:
    """Extract, transform and store the features of the day, today by default; returns their number.

    A second run on a day replaces it; other days stay as they are.
    """
    data = tables.read_staging(spark, staging)
    features = risk_features(
        data["customers"], data["credit_history"], data["transactions"], data["loan_applications"]
    )
    tables.store_features(features, out, at or dt.date.today(), buckets)
    return tables.read_features(spark, out).count()


def check_delivery(spark: SparkSession, staging: str, state: str, at: dt.date) -> dict:
    """Check the rows that were delivered on a day together with all recorded before, without reading those.

    Returns the summary of the suite over all deliveries; a failed check raises, after the day was recorded.
    """
    check_state.record(tables.read_staging(spark, staging), state, at)
    return quality.gate(check_state.suite_from_state(spark, state))


def train(spark: SparkSession, features_path: str, model_root: str) -> dict:
    """Fit all models, save the serving one with importances and metrics."""
    rows = training.prepare(tables.read_features(spark, features_path))
    fitted = {name: training.fit(rows, name) for name in training.MODELS}
    metrics = training.model_comparison(training.test_scores(rows, fitted))
    serving = fitted[SERVING_MODEL]
    models.save_model(serving, f"{model_root}/model")
    tables.write_json(training.feature_importance(serving), f"{model_root}/feature_importance")
    kept = metrics.filter(F.col("model_name") == SERVING_MODEL).drop("model_name")
    tables.write_json(kept, f"{model_root}/metrics")
    return tables.read_json(spark, f"{model_root}/metrics", MODEL_METRICS).first().asDict()


def importances(spark: SparkSession, model_root: str) -> DataFrame:
    return tables.read_json(spark, f"{model_root}/feature_importance", FEATURE_IMPORTANCE)


def deploy(
    spark: SparkSession, model_root: str, metadata_path: str, sample: DataFrame, model_id: int,
    version: str, trained_at: dt.datetime, name: str = "Risk Prediction Model",
) -> None:
    """Check the saved model on a sample, then record its metadata."""
    models.validate_model(f"{model_root}/model", sample)
    metrics = tables.read_json(spark, f"{model_root}/metrics", MODEL_METRICS).first().asDict()
    row = tables.metadata_row(spark, model_id, name, version, metrics, training.FEATURES, trained_at)
    tables.append_metadata(row, metadata_path)


def score(
    spark: SparkSession, features_path: str, model_path: str, predictions_path: str,
    at: dt.datetime, version: str = scoring.MODEL_VERSION,
) -> int:
    """Score customers without a score today; a second run on a day adds nothing."""
    features = tables.read_features(spark, features_path)
    of_the_day = tables.read_predictions(spark, predictions_path, at.date())
    todo = scoring.unscored(features, of_the_day, at.date())
    scored = training.batch_scores(models.load_model(model_path), todo)
    rows = scoring.not_yet_stored(scoring.prediction_rows(scored, at, version), of_the_day)
    # Written once, so that counting them does not score them again.
    fresh = checkpointed(rows)
    tables.append_predictions(fresh, predictions_path)
    return fresh.count()


def full_evaluation(scores: DataFrame, importance: DataFrame | None = None, top: int = 20) -> dict[str, DataFrame]:
    """Every evaluation table of the given test scores, and the top importances."""
    tables_of = {
        "report": evaluation.report(scores),
        "confusion_matrix": evaluation.confusion_matrix(scores),
        "roc_curve": evaluation.roc_curve(scores),
        "pr_curve": evaluation.pr_curve(scores),
    }
    if importance is not None:
        ranked = importance.orderBy(F.col("importance").desc(), "feature")
        tables_of["feature_importance"] = ranked.limit(top)
    return tables_of


def run_summary(
    checks: DataFrame, features: DataFrame, metadata: DataFrame, scores: DataFrame,
    as_of: dt.date | None = None,
) -> DataFrame:
    """One row: check totals, feature rows, newest model and scores of the day."""
    shown = ("algorithm", "accuracy", "auc_roc")
    model = scoring.latest_model(metadata).select(F.struct(*shown).alias("model")).scalar()
    of_the_day = scores.filter(F.col("prediction_date") >= day(as_of))
    total = F.count(F.lit(1))
    return (
        quality.summary(checks)
        .select("total_checks", "passed", "warnings", "failures")
        .withColumns(
            {
                "features_generated": features.agg(total).scalar(),
                "model": model,
                "new_predictions": of_the_day.agg(total).scalar(),
            }
        )
        .select("*", *[F.col(f"model.{c}").alias(c) for c in shown])
        .drop("model")
    )


def daily_run(
    spark: SparkSession, staging: str, root: str, at: dt.datetime, version: str = scoring.MODEL_VERSION
) -> dict:
    """Run the jobs in order; a failed quality check stops the run.

    The summary is written to ``run_summary`` whatever happened, as a last step; after a failed
    step it says so, holds what there is, and the error goes on to the caller.
    """
    data = tables.read_staging(spark, staging)
    four = [data[k] for k in ("customers", "credit_history", "transactions", "loan_applications")]
    customers, credit = four[0], four[1]
    newest = quality.latest_timestamps(*four).first().asDict()
    if newest["latest_customer"] is None:
        raise ValueError("no data in the staging tables")

    def checked(df: DataFrame, table: str) -> DataFrame:
        rules = quality.missing_rules(df) + quality.business_rules(table)
        return quality.row_checks(df, table, ["missing_values", "business_rules"], rules, 0.1)

    relation = quality.RELATIONS[0]
    checks = (
        checked(customers, "customers")
        .unionByName(checked(credit, "credit_history"))
        .unionByName(quality.duplicates(customers, "customers", ["customer_id"]))
        .unionByName(quality.referential_integrity(customers, credit, "customer_id", "customer_id", relation))
    )
    features, predictions = f"{root}/risk_features", f"{root}/risk_scores"
    made = spark.createDataFrame([], "loan_id bigint")
    model = tables.metadata_row(spark, 0, SERVING_MODEL, version, {}, [], at).limit(0)
    result: dict = {"newest": newest}
    status = "success"
    try:
        result["quality"] = quality.gate(checks)
        result["features"] = build_features(spark, staging, features, at.date())
        made = tables.read_features(spark, features)
        result["metrics"] = train(spark, features, f"{root}/models")
        model = tables.metadata_row(spark, 0, SERVING_MODEL, version, result["metrics"], training.FEATURES, at)
        result["predictions"] = score(spark, features, f"{root}/models/model", predictions, at, version)
    except Exception as error:
        status = f"failed: {error}"
        raise
    finally:
        of_the_day = tables.read_predictions(spark, predictions, at.date())
        summary = run_summary(checks, made, model, of_the_day, at.date())
        tables.write_json(summary.withColumn("status", F.lit(status)), f"{root}/run_summary")
    return result
