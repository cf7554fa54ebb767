"""Lending tables derived from the order-and-customer test tables.

Each table is one projection over a whole source table, written as SQL expressions
that Spark and DuckDB read alike; ``{ntz}`` stands for the zoneless timestamp type.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "customers": ("customer", {
        "customer_id": "c_custkey",
        "age": "CAST(18 + (c_custkey*37) % 63 AS INT)",
        "gender": "CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Other' END",
        "marital_status": "CASE (c_custkey*3) % 4 WHEN 0 THEN 'Single' WHEN 1 THEN 'Married' "
                          "WHEN 2 THEN 'Divorced' ELSE 'Widowed' END",
        "education_level": "CASE (c_custkey*7) % 4 WHEN 0 THEN 'High School' WHEN 1 THEN 'Bachelor' "
                           "WHEN 2 THEN 'Master' ELSE 'PhD' END",
        "employment_status": "CASE WHEN (c_custkey*5+1) % 7 < 4 THEN 'Employed' "
                             "WHEN (c_custkey*5+1) % 7 < 6 THEN 'Self-Employed' ELSE 'Unemployed' END",
        "annual_income": "CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE (c_acctbal + 1000) * 12 END",
        "years_employed": "CAST((c_custkey*11) % 30 AS INT)",
        "home_ownership": "CASE (c_custkey*2+1) % 3 WHEN 0 THEN 'Own' WHEN 1 THEN 'Rent' ELSE 'Mortgage' END",
        "num_dependents": "CAST(c_custkey % 5 AS INT)",
        "created_at": "CAST('2001-07-' || lpad(CAST(1 + c_custkey % 30 AS STRING), 2, '0') "
                      "|| ' 00:00:00' AS {ntz})",
    }),
    # Every fiftieth credit record is linked to no customer.
    "credit_history": ("customer", {
        "credit_id": "c_custkey",
        "customer_id": "CASE WHEN c_custkey % 50 = 49 THEN NULL ELSE c_custkey END",
        "credit_score": "CASE WHEN c_custkey % 83 = 0 THEN NULL ELSE CAST(300 + (c_custkey*7919) % 551 AS INT) END",
        "num_credit_accounts": "CAST(1 + c_custkey % 14 AS INT)",
        "credit_utilization_ratio": "CAST((c_custkey*31) % 101 AS DOUBLE) / 100",
        "num_delinquent_accounts": "CAST(CASE WHEN (c_custkey*13) % 10 < 7 THEN 0 "
                                   "WHEN (c_custkey*13) % 10 < 9 THEN 1 ELSE 2 END AS INT)",
        "total_debt": "abs(c_acctbal) * 10",
        "bankruptcy_flag": "(c_custkey % 20 = 7)",
        "years_credit_history": "CAST((c_custkey*17) % 25 AS INT)",
        "created_at": "CAST('2001-07-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') "
                      "|| ' 00:00:00' AS {ntz})",
    }),
    "transactions": ("events", {
        "transaction_id": "event_id",
        "customer_id": "user_id",
        "transaction_date": "CAST(ts AS DATE)",
        "transaction_amount": "value",
        "transaction_type": "CASE WHEN event_type IN ('purchase','view','error') THEN 'Debit' ELSE 'Credit' END",
        "category": "event_type",
        "created_at": "ts",
    }),
    "loan_applications": ("orders", {
        "loan_id": "o_orderkey",
        "customer_id": "o_custkey",
        "application_date": "CAST(o_orderdate AS DATE)",
        "loan_amount": "o_totalprice",
        "loan_purpose": "CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'Home' WHEN '2' THEN 'Auto' "
                        "WHEN '3' THEN 'Personal' WHEN '4' THEN 'Education' ELSE 'Business' END",
        "loan_term_months": "CAST(12 * (1 + o_orderkey % 6) AS INT)",
        "interest_rate": "CAST(3 + (o_orderkey*7) % 23 AS DOUBLE) / 100",
        "debt_to_income_ratio": "CAST((o_orderkey*29) % 100 AS DOUBLE) / 100",
        "default_flag": "(o_orderstatus = 'F')",
        "days_past_due": "CASE WHEN o_orderstatus = 'F' THEN CAST(1 + o_orderkey % 90 AS INT) ELSE 0 END",
        "created_at": "o_orderdate",
    }),
    # One score per loan; a model version serves for one calendar month.
    "risk_scores": ("orders", {
        "prediction_id": "o_orderkey",
        "customer_id": "o_custkey",
        "loan_id": "o_orderkey",
        "risk_score": "CAST((o_orderkey*7919) % 1001 AS DOUBLE) / 10",
        "risk_category": "CASE WHEN (o_orderkey*7919) % 1001 < 300 THEN 'Low' "
                         "WHEN (o_orderkey*7919) % 1001 < 600 THEN 'Medium' ELSE 'High' END",
        "default_probability": "CAST((o_orderkey*7919) % 1001 AS DOUBLE) / 1000",
        "model_version": "'v' || CAST(year(o_orderdate) AS STRING) || '.' || CAST(month(o_orderdate) AS STRING)",
        "prediction_date": "o_orderdate",
    }),
    # Loan requests as they arrive, amounts as text, some of them faulty.
    "requests": ("orders", {
        "request_id": "o_orderkey",
        "customer_id": "CASE WHEN o_orderkey % 90 = 0 THEN NULL WHEN o_orderkey % 75 = 0 THEN 'x17' "
                       "WHEN o_orderkey % 70 = 0 THEN CAST(o_custkey + 1000000 AS STRING) "
                       "ELSE CAST(o_custkey AS STRING) END",
        "loan_amount": "CASE WHEN o_orderkey % 110 = 0 THEN 'abc' WHEN o_orderkey % 130 = 0 THEN '-5' "
                       "WHEN o_orderkey % 170 = 0 THEN NULL "
                       "ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END",
        "loan_term_months": "CASE WHEN o_orderkey % 40 = 0 THEN NULL WHEN o_orderkey % 190 = 0 THEN '30' "
                            "WHEN o_orderkey % 230 = 0 THEN 'long' "
                            "ELSE CAST(12 * (1 + o_orderkey % 6) AS STRING) END",
        "loan_purpose": "CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'Home' WHEN '2' THEN 'Auto' "
                        "WHEN '3' THEN 'Personal' WHEN '4' THEN 'Education' ELSE NULL END",
    }),
    # Customers with repeated, missing and unknown keys, wrong ages and extreme incomes.
    "dirty_customers": ("customer", {
        "customer_id": "CASE WHEN c_custkey % 100 = 5 THEN NULL WHEN c_custkey % 25 = 3 THEN c_custkey - 1 "
                       "WHEN c_custkey % 14 = 1 THEN c_custkey + 50000000 ELSE c_custkey END",
        "age": "CASE WHEN c_custkey % 14 = 1 THEN NULL WHEN c_custkey % 100 = 5 THEN 120 "
               "WHEN c_custkey % 25 = 3 THEN CAST((c_custkey*37) % 63 - 52 AS INT) "
               "ELSE CAST(18 + (c_custkey*37) % 63 AS INT) END",
        "annual_income": "CASE WHEN c_custkey % 14 = 1 THEN 99999999.0 WHEN c_custkey % 100 = 5 THEN 0.0 "
                         "WHEN c_custkey % 25 = 3 THEN (c_acctbal + 1000) * -12 "
                         "ELSE (c_acctbal + 1000) * 12 END",
        "employment_status": "CASE WHEN c_custkey % 25 = 3 THEN NULL WHEN c_custkey % 100 = 5 THEN 'Retired' "
                             "ELSE 'Employed' END",
    }),
}


@dataclass(frozen=True)
class LendingTables:
    """The staging tables and the stored scores of one data set."""

    customers: DataFrame
    credit_history: DataFrame
    transactions: DataFrame
    loan_applications: DataFrame
    risk_scores: DataFrame

    @property
    def staging(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return self.customers, self.credit_history, self.transactions, self.loan_applications


@lru_cache
def stored_schema(path: str) -> StructType:
    """Schema of a source table; its footers are read once per process."""
    return SparkSession.active().read.parquet(path).schema


def projected(raw: DataFrame, name: str) -> DataFrame:
    columns = VIEWS[name][1]
    return raw.selectExpr(*[f"{sql.format(ntz='TIMESTAMP_NTZ')} AS {column}" for column, sql in columns.items()])


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{VIEWS[name][0]}.parquet"
    return projected(spark.read.schema(stored_schema(path)).parquet(path), name)


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of its files."""
    source = VIEWS[name][0]
    # A pattern, so that the table may be one file or a folder of files.
    reader = spark.readStream.schema(stored_schema(f"{folder}/{source}.parquet"))
    return projected(reader.parquet(f"{folder}/{source}[.]parquet"), name)


def lending_tables(spark: SparkSession, folder: str) -> LendingTables:
    return LendingTables(**{name: view(spark, folder, name) for name in LendingTables.__annotations__})


def duckdb_view(name: str) -> str:
    """The same projection as a SELECT for DuckDB."""
    source, columns = VIEWS[name]
    body = ", ".join(f"{sql.format(ntz='TIMESTAMP')} AS {column}" for column, sql in columns.items())
    return f"SELECT {body} FROM {source}"

