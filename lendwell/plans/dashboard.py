"""Tables behind the monitoring dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendwell.functions import credit as fx
from lendwell.functions.columns import ratio, rounded

# Histogram layout over the 0-100 score.
BINS = 30
WIDTH = 100 / BINS


def category_share(scores: DataFrame) -> DataFrame:
    """Scores per category and their share of all scores in percent."""
    counts = scores.groupBy("risk_category").agg(F.count(F.lit(1)).alias("assessments"))
    # One row per category by now.
    everything = Window.partitionBy(F.lit(0))
    share = ratio(F.col("assessments"), F.sum("assessments").over(everything)) * 100
    return counts.withColumn("share", rounded(share, 1))


def score_histogram(scores: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts in equal bins from 0 to 100; a score of 100 belongs to the last bin."""
    bin_number = F.least(F.expr(f"width_bucket(risk_score, 0, 100, {bins})"), F.lit(bins))
    return (
        scores.filter(F.col("risk_score").isNotNull())
        .groupBy(bin_number.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("assessments"))
    )


def recent_predictions(scores: DataFrame, limit: int = 100) -> DataFrame:
    """Newest scores with the probability as text; halves round to even."""
    percent = F.bround(F.round(F.col("default_probability") * 100, 10), 2)
    return (
        scores.orderBy(F.col("prediction_date").desc_nulls_last(), F.col("prediction_id").desc())
        .limit(limit)
        .select(
            "prediction_id",
            "customer_id",
            F.bround("risk_score", 2).alias("risk_score"),
            "risk_category",
            F.concat(percent.cast("string"), F.lit("%")).alias("default_probability"),
            "prediction_date",
        )
    )


def key_factors(features: DataFrame) -> DataFrame:
    return features.select("loan_id", *[c.alias(name) for name, c in fx.key_factors().items()])


def display_sample(df: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """The rows a page shows, first keys first."""
    return df.orderBy(key).limit(limit)
