"""Named feature queries, for every customer at once.

Pass one customer's id through ``for_customer`` to narrow any table first.
Ties are broken by the table's key so that results repeat.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendwell.functions import credit as fx
from lendwell.functions.columns import below_bands, ratio, rounded
from lendwell.functions.sketches import distinct_count
from lendwell.operators.picks import top_per_key
from lendwell.operators.skew import spread_join
from lendwell.plans.features import newest_credit
from lendwell.plans.scoring import latest_scores
from lendwell.session import days_before, months_before

KEY = "customer_id"
# Tenure bands.
TENURE = [(10, "Very Stable"), (5, "Stable"), (2, "Moderate")]


def for_customer(df: DataFrame, customer_id: int) -> DataFrame:
    return df.filter(F.col(KEY) == customer_id)


def customer_view(
    customer_id: int, customers: DataFrame, credit: DataFrame, transactions: DataFrame, loans: DataFrame, scores: DataFrame
) -> dict[str, DataFrame]:
    """The queries that ask about one customer, by name.

    Every table is narrowed before anything else, so the filter reaches its scan and no query meets
    rows of other customers.
    """
    own = [for_customer(df, customer_id) for df in (customers, credit, transactions, loans, scores)]
    customers, credit, transactions, loans, scores = own
    return {
        "customer_profile": customer_profile(customers, credit, transactions, loans),
        "transaction_features": transaction_totals(transactions),
        "recent_loans": recent_loans(loans),
        "utilization_trend": utilization_trend(credit),
        "loan_capacity": loan_capacity(customers),
        "employment_stability": employment_stability(customers),
        "risk_trend": risk_trend(scores),
        "latest_credit": latest_credit(credit),
        "latest_score": latest_scores(scores),
    }


def last_first(column: str):
    return F.col(column).desc_nulls_last()


def customer_profile(
    customers: DataFrame, credit: DataFrame, transactions: DataFrame, loans: DataFrame, approx: bool = False
) -> DataFrame:
    """Customer and credit attributes with transaction and loan totals.

    The totals are those of the customer's transactions paired with the customer's
    loans, worked out from per-customer sums: pairing n transactions with m loans
    repeats every transaction m times and every default n times. Ids are counted once, with
    ``approx`` by sketches, whose size does not grow with a customer's rows.
    """
    facts = ["credit_score", "credit_utilization_ratio", "num_delinquent_accounts",
             "total_debt", "bankruptcy_flag"]
    known = F.col(KEY).isNotNull()
    records = credit.filter(known).groupBy(KEY, *facts).agg(F.count(F.lit(1)).alias("copies"))
    amount = F.col("transaction_amount")
    spending = transactions.filter(known).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        distinct_count("transaction_id", approx).alias("transactions"),
        F.count(amount).alias("n_amounts"),
        F.avg(amount).alias("mean"),
        (F.var_pop(amount) * F.count(amount)).alias("squares"),
    )
    borrowing = loans.filter(known).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("m"),
        distinct_count("loan_id", approx).alias("loans"),
        F.count_if(F.col("default_flag")).alias("defaults"),
    )
    joined = (
        customers.join(spending, KEY, "left").join(borrowing, KEY, "left").join(records, KEY, "left")
    )
    c = F.col
    one = F.lit(1)
    repeats = F.greatest(F.coalesce(c("m"), one), one) * F.coalesce(c("copies"), one)
    pairs = c("n_amounts") * repeats
    return joined.select(
        KEY, "age", "annual_income", "years_employed", "employment_status", "home_ownership",
        *facts,
        F.coalesce(c("transactions"), F.lit(0)).alias("total_transactions"),
        c("mean").alias("avg_transaction_amount"),
        F.when(pairs > 1, F.sqrt(c("squares") * repeats / (pairs - 1))).alias("transaction_volatility"),
        F.coalesce(c("loans"), F.lit(0)).alias("total_loans"),
        (
            F.coalesce(c("defaults"), F.lit(0))
            * F.greatest(F.coalesce(c("n"), one), one)
            * F.coalesce(c("copies"), one)
        ).alias("defaulted_loans"),
    )


def transaction_totals(transactions: DataFrame) -> DataFrame:
    amount = F.col("transaction_amount")

    def total(kind: str):
        return F.sum(F.when(F.col("transaction_type") == kind, amount).otherwise(0.0))

    return transactions.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.avg(amount).alias("avg_monthly_spending"),
        F.stddev_samp(amount).alias("spending_volatility"),
        F.min(amount).alias("min_transaction"),
        F.max(amount).alias("max_transaction"),
        total("Debit").alias("total_debits"),
        total("Credit").alias("total_credits"),
    )


def recent_loans(loans: DataFrame, n: int = 5) -> DataFrame:
    columns = [
        "loan_id", KEY, "application_date", "loan_amount", "loan_purpose", "loan_term_months",
        "interest_rate", "debt_to_income_ratio", "default_flag", "days_past_due",
    ]
    order = [last_first("application_date"), F.col("loan_id")]
    return top_per_key(loans.select(columns), [KEY], order, n)


def utilization_trend(credit: DataFrame) -> DataFrame:
    used = F.col("credit_utilization_ratio")
    return credit.groupBy(KEY).agg(
        F.avg(used).alias("avg_utilization"),
        F.max(used).alias("max_utilization"),
        F.min(used).alias("min_utilization"),
    )


def high_risk_customers(
    features: DataFrame, scores: DataFrame, as_of: dt.date | None = None, limit: int = 100,
    loans: DataFrame | None = None,
) -> DataFrame:
    """Highest recent scores beside every feature row of their customer.

    Each score with a feature row yields at least one result, so the best ``limit``
    scores are enough; of each customer's feature rows no more than ``limit`` can
    appear. Neither side is paired in full. A customer has a feature row if they have a
    loan: with ``loans`` their keys decide, and the feature table is built once.
    """
    c = F.col
    recent = scores.filter(
        (c("risk_category") == "High") & (c("prediction_date") >= days_before(as_of, 30)) & c(KEY).isNotNull()
    ).select(KEY, "prediction_id", "risk_score", "risk_category")
    best = top_per_key(recent, [KEY], [last_first("risk_score"), c("prediction_id")], limit)
    ranked = [last_first("risk_score"), c(KEY), c("prediction_id")]
    owners = features if loans is None else loans
    best = best.join(owners.select(KEY).distinct(), KEY, "left_semi").orderBy(*ranked).limit(limit)
    wanted = features.select(KEY, "loan_id", "credit_score", "debt_to_income", "delinquency_score")
    # ``best`` holds at most ``limit`` rows.
    held = wanted.join(F.broadcast(best.select(KEY).distinct()), KEY, "left_semi")
    # A loan has one feature row per credit record of its customer.
    record = [c("loan_id"), c("credit_score").asc_nulls_last(), c("delinquency_score").asc_nulls_last()]
    held = top_per_key(held, [KEY], record, limit)
    return (
        held.join(F.broadcast(best), KEY)
        .orderBy(*ranked, *record)
        .limit(limit)
        .select(KEY, "loan_id", "credit_score", "debt_to_income", "delinquency_score",
                "prediction_id", "risk_score", "risk_category")
    )


def loan_capacity(customers: DataFrame) -> DataFrame:
    """Recommended loan and payment limits; an unknown income takes the last band."""
    income = F.col("annual_income")
    return customers.select(
        KEY,
        "annual_income",
        (income * 3).alias("max_recommended_loan"),
        (income * 0.43).alias("max_monthly_payment"),
        below_bands(income, fx.INCOME_EDGES, fx.INCOME_LABELS).alias("income_category"),
    )


def retraining_set(
    customers: DataFrame, credit: DataFrame, loans: DataFrame, as_of: dt.date | None = None,
    every_record: bool = False, **spread,
) -> DataFrame:
    """Inputs and label of every loan applied for in the last two years.

    Credit records count as in the feature table; ``every_record`` forms all pairs.
    """
    if not every_record:
        credit = newest_credit(credit)
    recent = loans.filter(F.col("application_date") >= months_before(as_of, 24)).select(
        KEY, "loan_id", "loan_amount", "loan_term_months", "interest_rate",
        "debt_to_income_ratio", "default_flag",
    )
    people = customers.select(KEY, "age", "annual_income", "years_employed", "num_dependents")
    records = credit.select(
        KEY, "credit_score", "num_credit_accounts", "credit_utilization_ratio",
        "num_delinquent_accounts", "total_debt", "years_credit_history",
    )
    joined = spread_join(recent, [people, records], KEY, "loan_id", "inner", **spread)
    return joined.select(
        KEY, "age", "annual_income", "years_employed", "num_dependents", "credit_score",
        "num_credit_accounts", "credit_utilization_ratio", "num_delinquent_accounts", "total_debt",
        "years_credit_history", "loan_id", "loan_amount", "loan_term_months", "interest_rate",
        "debt_to_income_ratio", "default_flag",
    )


def employment_stability(customers: DataFrame) -> DataFrame:
    years = F.col("years_employed")
    band = F
    for least, label in TENURE:
        band = band.when(years >= least, label)
    return customers.select(
        KEY,
        "age",
        "years_employed",
        fx.employment_stability(F.col("age"), years, guarded=False).alias("employment_stability_score"),
        band.otherwise("Unstable").alias("employment_stability_category"),
    )


def risk_trend(scores: DataFrame, n: int = 12) -> DataFrame:
    """Last ``n`` scores per customer with the change since the score before.

    One row more than shown is kept per customer, so the oldest shown row still
    sees its predecessor.
    """
    kept = top_per_key(
        scores.select(KEY, "prediction_id", "risk_score", "risk_category", "prediction_date"),
        [KEY],
        [last_first("prediction_date"), F.col("prediction_id").desc()],
        n + 1,
        rank="age_rank",
    )
    older = Window.partitionBy(KEY).orderBy(F.col("age_rank").desc())
    previous = F.lag("risk_score").over(older)
    return (
        kept.withColumn("previous_risk_score", previous)
        .filter(F.col("age_rank") <= n)
        .withColumn("risk_change", F.col("risk_score") - F.col("previous_risk_score"))
        .drop("age_rank")
    )


def latest_credit(credit: DataFrame) -> DataFrame:
    columns = [KEY, "credit_id", "credit_score", "num_delinquent_accounts",
               "credit_utilization_ratio", "created_at"]
    order = [last_first("created_at"), F.col("credit_id")]
    return top_per_key(credit.select(columns), [KEY], order, 1)


def default_by_purpose(loans: DataFrame) -> DataFrame:
    defaults = F.count_if(F.col("default_flag"))
    total = F.count(F.lit(1))
    return (
        loans.groupBy("loan_purpose")
        .agg(
            total.alias("total_loans"),
            defaults.alias("defaulted_loans"),
            rounded(ratio(defaults, total) * 100, 2).alias("default_rate"),
            F.avg("loan_amount").alias("avg_loan_amount"),
            F.avg("interest_rate").alias("avg_interest_rate"),
        )
        .orderBy(F.col("default_rate").desc_nulls_last(), "loan_purpose")
    )


def high_dti_good_credit(
    customers: DataFrame, credit: DataFrame, loans: DataFrame, limit: int = 50
) -> DataFrame:
    """Most indebted loans of customers with good credit.

    Every qualifying loan yields at least one row, so the best ``limit`` loans are
    picked before credit records are joined to them.
    """
    c = F.col
    good = credit.filter((c("credit_score") >= 700) & c(KEY).isNotNull()).select(
        KEY, "credit_id", "credit_score"
    )
    people = customers.select(KEY, "annual_income")
    rank = [last_first("debt_to_income_ratio"), c("loan_id")]
    heavy = loans.filter((c("debt_to_income_ratio") > fx.HIGH_DTI) & c(KEY).isNotNull()).select(
        KEY, "loan_id", "debt_to_income_ratio", "loan_amount"
    )
    best = (
        top_per_key(heavy, [KEY], rank, limit)
        .join(good.select(KEY).distinct(), KEY, "left_semi")
        .join(people, KEY)
        .orderBy(*rank)
        .limit(limit)
    )
    # ``best`` holds at most ``limit`` rows.
    held = good.join(F.broadcast(best.select(KEY).distinct()), KEY, "left_semi")
    held = top_per_key(held, [KEY], [c("credit_id")], limit)
    return (
        held.join(F.broadcast(best), KEY)
        .orderBy(*rank, "credit_id")
        .limit(limit)
        .select(KEY, "annual_income", "credit_score", "debt_to_income_ratio", "loan_amount", "loan_id")
    )
