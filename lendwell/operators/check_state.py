"""State of the quality checks: what every delivery found, stored and merged.

A delivery is the new rows of the staging tables on a day. Of its rows only counts are kept: bad rows per rule,
all rows, the newest time, and how often each key occurs in each table. Counts add up, so the suite over all
deliveries comes from the state alone; a run reads the rows of its own delivery and no others. A delivery that
is recorded again replaces its own part. Keys are kept in buckets, so that they are merged in place.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwell import schemas
from lendwell.operators import quality
from lendwell.operators.quality import Rule
from lendwell.sources import stored

KEY = "customer_id"
# The parent first; the suite checks keys of all four and rows of those named below.
TABLES = ["customers", "credit_history", "transactions", "loan_applications"]
ROW_CHECKED = ["customers", "credit_history", "loan_applications"]
UNIQUE = ("customers", "credit_history")
DELIVERY = "delivery"


def name_of(rule: Rule) -> str:
    return f"{rule.check}/{rule.name}"


def counts(df: DataFrame, table: str) -> DataFrame:
    """One row: what the rules of a table's row checks find, the number of rows and the newest one."""
    _, rules = quality.standard_rules(table, df)
    found = F.create_map(*[c for r in rules for c in (F.lit(name_of(r)), F.count_if(r.bad))])
    return df.agg(
        F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("total"), found.alias("bad"), F.max("created_at").alias("newest")
    )


def record(tables: Mapping[str, DataFrame], path: str, delivery: dt.date) -> None:
    """Keep what a delivery of the four tables, or of some of them, holds."""
    found = [counts(df, name) for name, df in tables.items()]
    rows = reduce(DataFrame.unionByName, found).withColumn(DELIVERY, F.lit(delivery))
    stored.replace_days(rows, f"{path}/rows", "table_name", DELIVERY, buckets=1)
    keys = [
        df.groupBy(F.col(KEY).cast("bigint").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(name))
        for name, df in tables.items()
    ]
    both = reduce(DataFrame.unionByName, keys).withColumn(DELIVERY, F.lit(delivery))
    stored.replace_days(both, f"{path}/keys", "key", DELIVERY)


def suite_from_state(spark: SparkSession, path: str, threshold: float = 0.1, strict: bool = False) -> DataFrame:
    """The thirteen standard checks over all recorded deliveries, as ``quality.suite`` over their rows."""
    state = stored.read_stored(spark, f"{path}/rows", by_key=False)

    def rows_of(table: str) -> DataFrame:
        names, rules = quality.standard_rules(table, spark.createDataFrame([], schemas.STAGING[table]))
        bad = [F.coalesce(F.sum(F.try_element_at("bad", F.lit(name_of(r)))), F.lit(0)) for r in rules]
        merged = state.filter(F.col("table_name") == table).agg(
            F.coalesce(F.sum("total"), F.lit(0)).alias("total"), *[b.alias(f"rule_{i}") for i, b in enumerate(bad)]
        )
        return quality.checks_of_counts(merged, table, names, rules, threshold, strict)

    keys = stored.read_stored(spark, f"{path}/keys")
    per_key = keys.groupBy("key").agg(
        *[F.coalesce(F.sum(F.when(F.col("table_name") == t, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, t in enumerate(TABLES)]
    )
    checks = [*map(rows_of, ROW_CHECKED), quality.checks_of_keys(per_key, TABLES, quality.RELATIONS, UNIQUE)]
    return reduce(DataFrame.unionByName, checks)


def newest_from_state(spark: SparkSession, path: str) -> DataFrame:
    """``table_name, newest, total`` of every table over all deliveries."""
    state = stored.read_stored(spark, f"{path}/rows", by_key=False)
    return state.groupBy("table_name").agg(F.max("newest").alias("newest"), F.sum("total").alias("total"))
