"""Score columns, stored scores and the work list of the batch job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwell.functions import credit as fx
from lendwell.operators.evaluation import MODEL, report
from lendwell.operators.picks import top_per_key
from lendwell.session import day

KEY = "customer_id"
# Fixed value: version written when a job names none.
MODEL_VERSION = "v1.0.0"
SCORE_KEY = [KEY, "loan_id", "model_version", "prediction_day"]


def categorize(df: DataFrame, probability: str = "default_probability") -> DataFrame:
    """Score, category and recommendation from a default probability."""
    scored = df.withColumn("risk_score", F.col(probability) * 100)
    score = F.col("risk_score")
    return scored.withColumns(
        {"risk_category": fx.risk_category(score), "recommendation": fx.recommendation(score)}
    )


def latest_scores(scores: DataFrame) -> DataFrame:
    """Newest stored score of every customer."""
    columns = [KEY, "prediction_id", "risk_score", "risk_category", "default_probability", "prediction_date"]
    order = [F.col("prediction_date").desc_nulls_last(), F.col("prediction_id").desc()]
    return top_per_key(scores.select(columns), [KEY], order, 1)


def unscored(
    features: DataFrame, scores: DataFrame, as_of: dt.date | None = None, limit: int | None = None
) -> DataFrame:
    """Feature rows of customers without a score on or after the reporting date.

    ``limit`` cuts the work list in order of loan, for callers that score in batches.
    """
    done = scores.filter((F.col("prediction_date") >= day(as_of)) & F.col(KEY).isNotNull())
    open_rows = features.filter(F.col(KEY).isNotNull()).join(done.select(KEY).distinct(), KEY, "left_anti")
    return open_rows if limit is None else open_rows.orderBy("loan_id").limit(limit)


def prediction_rows(
    scored: DataFrame, prediction_date: dt.datetime, model_version: str = MODEL_VERSION
) -> DataFrame:
    """Rows for the score table from a frame with ``default_probability``."""
    key = F.xxhash64(KEY, "loan_id", F.lit(model_version), F.lit(prediction_date.isoformat()))
    stamp = F.lit(prediction_date).cast("timestamp_ntz")
    return categorize(scored).select(
        key.alias("prediction_id"),
        KEY,
        "loan_id",
        "risk_score",
        "risk_category",
        "default_probability",
        F.lit(model_version).alias("model_version"),
        stamp.alias("prediction_date"),
        F.to_date(stamp).alias("prediction_day"),
    )


def not_yet_stored(predictions: DataFrame, stored: DataFrame) -> DataFrame:
    """Predictions whose customer, loan, version and day are not in the table yet."""
    seen = stored.withColumn("prediction_day", F.to_date("prediction_date")).select(SCORE_KEY).distinct()
    return predictions.join(seen, SCORE_KEY, "left_anti")


def scored_loans(loans: DataFrame, scores: DataFrame) -> DataFrame:
    """Outcome and stored probability of every scored loan."""
    outcomes = loans.select("loan_id", F.col("default_flag").cast("int").alias("label"))
    return scores.select(
        "loan_id", "model_version", "prediction_date", F.col("default_probability").alias("probability")
    ).join(outcomes, "loan_id")


def metadata_from_outcomes(scored: DataFrame) -> DataFrame:
    """Model metadata of every version, measured on the outcomes of the loans it scored."""
    by_version = scored.withColumn(MODEL, F.col("model_version"))
    month = F.date_trunc("month", "prediction_date").cast("timestamp_ntz")
    return (
        report(by_version, least="prediction_date")
        .withColumn("training_date", month)
        .select(
            (F.year("training_date") * 100 + F.month("training_date")).alias("model_id"),
            F.lit("Risk Prediction Model").alias("model_name"),
            F.col(MODEL).alias("model_version"),
            F.lit("RandomForestClassifier").alias("algorithm"),
            "accuracy",
            F.col("precision").alias("precision_score"),
            "recall",
            "f1_score",
            "auc_roc",
            "training_date",
        )
    )


def latest_model(metadata: DataFrame) -> DataFrame:
    return (
        metadata.orderBy(F.col("training_date").desc_nulls_last(), F.col("model_id").desc())
        .limit(1)
        .select("model_name", "model_version", "algorithm", "accuracy", "precision_score", "recall",
                "f1_score", "auc_roc", F.date_format("training_date", "yyyy-MM-dd'T'HH:mm:ss").alias("training_date"))
    )
