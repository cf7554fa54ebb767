"""Daily counts of incoming scores, complete at any time.

A streaming aggregate keeps the sums of every day in a state store. After a micro-batch the sums of
all days replace the older of two written copies; readers take the newer one. So late scores count, a day
needs no end, a repeated micro-batch changes nothing, and files grow with days, not with batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lendwell.functions.columns import ratio, rounded

PARTS = (
    "report_date date, total_assessments bigint, low_risk_count bigint, medium_risk_count bigint, "
    "high_risk_count bigint, score_sum decimal(38,10), scores bigint, probability_sum decimal(38,10), probabilities bigint"
)
# Ten digits after the point; sums of such numbers do not depend on the order of rows.
FIXED = "decimal(28,10)"
STORED = f"{PARTS}, batch_id bigint"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def daily_parts(scores: DataFrame) -> DataFrame:
    """Per day: rows, rows by category, and sums and counts of what is known. Of a table or a stream."""
    category = F.col("risk_category")
    return scores.groupBy(F.to_date("prediction_date").alias("report_date")).agg(
        F.count(F.lit(1)).alias("total_assessments"),
        F.count_if(category == "Low").alias("low_risk_count"),
        F.count_if(category == "Medium").alias("medium_risk_count"),
        F.count_if(category == "High").alias("high_risk_count"),
        F.sum(F.col("risk_score").cast(FIXED)).cast("decimal(38,10)").alias("score_sum"),
        F.count("risk_score").alias("scores"),
        F.sum(F.col("default_probability").cast(FIXED)).cast("decimal(38,10)").alias("probability_sum"),
        F.count("default_probability").alias("probabilities"),
    )


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state in RocksDB, which may outgrow an executor's memory."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ON_DISK)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def write_daily(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the sums of every day below ``out`` up to date; stops when the input is used up."""
    spark = stream.sparkSession
    # So that a reader finds a table before the first batch.
    spark.createDataFrame([], STORED).write.mode("overwrite").parquet(f"{out}/copy=-1")

    def store(sums: DataFrame, batch_id: int) -> None:
        rows = sums.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{out}/copy={batch_id % 2}")

    with state_on_disk(spark):
        return (
            daily_parts(stream)
            .writeStream.outputMode("complete")
            .foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def read_daily(spark: SparkSession, out: str) -> DataFrame:
    """Per day: assessments by category and mean score and probability of all batches so far."""
    copies = spark.read.schema(STORED).parquet(out)
    sums = copies.filter(F.col("batch_id") == copies.agg(F.max("batch_id")).scalar())
    return sums.select(
        "report_date", "total_assessments", "low_risk_count", "medium_risk_count", "high_risk_count",
        rounded(ratio(F.col("score_sum"), F.col("scores")), 2).alias("avg_risk_score"),
        rounded(ratio(F.col("probability_sum"), F.col("probabilities")), 4).alias("avg_default_probability"),
    )
