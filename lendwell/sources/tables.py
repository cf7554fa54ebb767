"""Reading and writing the lending tables."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwell import schemas
from lendwell.schemas import conform
from lendwell.sources import stored

# Day of a run that built features.
BUILD_DAY = "build_day"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet with a fixed schema, so no file is opened to infer one."""
    return spark.read.schema(schema).parquet(path)


def read_staging(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, f"{root}/{name}", schema) for name, schema in schemas.STAGING.items()}


def store_features(features: DataFrame, path: str, at: dt.date, buckets: int = stored.BUCKETS) -> None:
    """Keep the wide feature table of a day in buckets of the customer; the day is replaced, others stay."""
    stored.replace_days(features.withColumn(BUILD_DAY, F.lit(at)), path, "customer_id", BUILD_DAY, buckets)


def read_features(spark: SparkSession, path: str, by_customer: bool = False) -> DataFrame:
    """The wide feature table of the newest stored day; its columns are those of the build.

    ``by_customer`` reads it in its buckets, for joins and groupings by customer without an exchange. A
    folder that was written as a whole (``overwrite_features``) is read as it is.
    """
    if stored.layout_of(spark, path) is None:
        return spark.read.parquet(path)
    return stored.newest_day(spark, path, by_customer)


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
    partitions: int, **options: str,
) -> DataFrame:
    """A database table read in ``partitions`` key ranges, one query per task."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.options(
        partitionColumn=partition_column,
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(partitions),
    ).load()


def overwrite_staging(tables: dict[str, DataFrame], root: str) -> None:
    """Replace staging tables; columns take their fixed types and NaN becomes null."""
    for name, df in tables.items():
        conform(df, schemas.STAGING[name]).write.mode("overwrite").parquet(f"{root}/{name}")


def overwrite_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Append scores, one directory per day so that date filters prune."""
    predictions.write.mode("append").partitionBy("prediction_day").parquet(path)


def read_predictions(spark: SparkSession, path: str, first_day: dt.date | None = None) -> DataFrame:
    """Stored scores, or no rows when nothing was stored yet."""
    schema = f"{schemas.RISK_SCORES}, prediction_day date"
    try:
        stored = read_table(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return stored if first_day is None else stored.filter(F.col("prediction_day") >= first_day)


def keep_days(predictions: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """Scores within the retention period."""
    return predictions.filter(F.col("prediction_day") > as_of - dt.timedelta(days=days))


def metadata_row(
    spark: SparkSession, model_id: int, name: str, version: str, metrics: dict,
    features: list[str], training_date: dt.datetime,
) -> DataFrame:
    """One model's metadata; absent metrics count as 0 and features are a JSON list."""
    row = (
        model_id, name, version, metrics.get("algorithm", "RandomForestClassifier"),
        *[float(metrics.get(k, 0)) for k in ("accuracy", "precision", "recall", "f1_score", "auc_roc")],
        training_date, features,
    )
    listed = schemas.MODEL_METADATA.replace("features_used string", "features_used array<string>")
    df = spark.createDataFrame([row], listed)
    return df.withColumn("features_used", F.to_json("features_used"))


def append_metadata(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    stored = read_table(spark, path, schemas.MODEL_METADATA)
    return stored.withColumn("features_used", F.from_json("features_used", "array<string>"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
