"""Feature table at loan grain and the transaction aggregates behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell.functions import credit as fx
from lendwell.operators.skew import spread_join


def transaction_features(transactions: DataFrame) -> DataFrame:
    """Per customer: mean, spread, sum and count of transactions."""
    amount = F.col("transaction_amount")
    return (
        transactions.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.avg(amount).alias("avg_monthly_spending"),
            F.stddev_samp(amount).alias("spending_volatility"),
            F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_spending"),
            F.count("transaction_id").alias("transaction_count"),
        )
    )


def aggregate_features(transactions: DataFrame) -> DataFrame:
    """Per customer: the full set of aggregates; a lone transaction has no volatility (0)."""
    amount = F.col("transaction_amount")
    return (
        transactions.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.avg(amount).alias("avg_transaction_amount"),
            F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("transaction_volatility"),
            F.min(amount).alias("min_transaction_amount"),
            F.max(amount).alias("max_transaction_amount"),
            F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_transaction_amount"),
            F.count("transaction_id").alias("transaction_count"),
        )
    )


def payment_consistency(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every customer's payment consistency from one aggregate and one join."""
    history = transaction_features(transactions)
    score = fx.payment_consistency(
        F.col("transaction_count"), F.col("avg_monthly_spending"), F.col("spending_volatility")
    )
    return customers.select("customer_id").join(history, "customer_id", "left").select(
        "customer_id", score.alias("payment_consistency_score")
    )


def derived() -> dict[str, Column]:
    """The four derived features of the feature table, without zero guards."""
    c = F.col
    return {
        "income_category": fx.income_category(c("annual_income")),
        "employment_stability_score": fx.employment_stability(c("age"), c("years_employed"), False),
        "delinquency_score": fx.delinquency_score(
            c("num_delinquent_accounts"), c("credit_utilization_ratio")
        ),
        "loan_to_income_ratio": fx.loan_to_income(c("loan_amount"), c("annual_income"), False),
    }


def newest_credit(credit: DataFrame) -> DataFrame:
    """The last credit record of every customer, the smallest id among equally old ones.

    Written as an aggregate: its result has one row per customer, so a join to it that gives no
    column is dropped from the plan.
    """
    own = [c for c in credit.columns if c != "customer_id"]
    newest = F.max_by(F.struct(*own), F.struct("created_at", -F.col("credit_id"))).alias("newest")
    found = credit.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(newest)
    return found.select(
        *[F.col("customer_id") if c == "customer_id" else F.col(f"newest.{c}").alias(c) for c in credit.columns]
    )


def utilization_categories(credit: DataFrame, loans: DataFrame, **spread) -> DataFrame:
    """Every loan's utilisation category from the newest credit record of its customer; no other table is read."""
    used = newest_credit(credit).select("customer_id", "credit_utilization_ratio")
    joined = spread_join(loans.select("loan_id", "customer_id"), [used], "customer_id", "loan_id", **spread)
    return joined.select("loan_id", fx.utilization_category(F.col("credit_utilization_ratio")).alias("utilization_category"))


def risk_features(
    customers: DataFrame, credit: DataFrame, transactions: DataFrame, loans: DataFrame,
    every_record: bool = False, **spread,
) -> DataFrame:
    """Loans with the features of their customer; loans without a match keep nulls.

    Of a customer's credit records the newest counts. With ``every_record`` a loan appears
    once per record instead: that forms all pairs of a customer's loans and records.
    """
    if not every_record:
        credit = newest_credit(credit)
    lookups = [
        customers.drop("created_at"),
        credit.drop("created_at"),
        transaction_features(transactions),
    ]
    joined = spread_join(loans, lookups, "customer_id", "loan_id", **spread)
    return joined.withColumns(derived())


def feature_store(features: DataFrame) -> DataFrame:
    """The feature table under its stored names, with payment consistency."""
    c = F.col
    consistency = fx.payment_consistency(
        c("transaction_count"), c("avg_monthly_spending"), c("spending_volatility")
    )
    return features.select(
        c("loan_id").alias("feature_id"),
        "customer_id",
        "loan_id",
        "age",
        "income_category",
        "employment_stability_score",
        "credit_score",
        c("credit_utilization_ratio").alias("credit_utilization"),
        "delinquency_score",
        "avg_monthly_spending",
        c("spending_volatility").alias("transaction_volatility"),
        consistency.alias("payment_consistency_score"),
        c("debt_to_income_ratio").alias("debt_to_income"),
        "loan_to_income_ratio",
        "created_at",
    )
