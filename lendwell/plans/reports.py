"""Named portfolio reports.

Where a report pairs all scores with all loans of a customer, each side is first
summed per customer and the sums are multiplied, so no pair is ever built.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell.functions.columns import below_bands, ratio, rounded
from lendwell.functions.sketches import distinct_count, sketch, sketched
from lendwell.operators.ordered import in_runs, neighbour
from lendwell.operators.picks import top_per_key
from lendwell.operators.prefix import prefix_sums
from lendwell.session import day, days_before, months_before

KEY = "customer_id"
# Report bands.
AGE_BANDS = ([30, 40, 50, 60], ["18-29", "30-39", "40-49", "50-59", "60+"])
AMOUNT_BANDS = ([25000, 50000, 100000, 200000], ["0-25K", "25K-50K", "50K-100K", "100K-200K", "200K+"])
SCORE_BANDS = ([600, 650, 700, 750], ["300-599", "600-649", "650-699", "700-749", "750+"])
INCOME_SEGMENTS = (
    [30000, 60000, 100000],
    ["Low Income", "Medium Income", "High Income", "Very High Income"],
)
CREDIT_SEGMENTS = ([650, 700, 750], ["Poor Credit", "Fair Credit", "Good Credit", "Excellent Credit"])


def rows() -> Column:
    return F.count(F.lit(1))


def high() -> Column:
    return F.count_if(F.col("risk_category") == "High")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return rounded(ratio(part, whole) * 100, digits)


def weighted(total: str, weight: str) -> Column:
    """Sum of per-customer ``total`` repeated ``weight`` times."""
    return F.sum(F.col(total) * F.col(weight))


def since(scores: DataFrame, cutoff: Column) -> DataFrame:
    return scores.filter(F.col("prediction_date") >= cutoff)


def score_sums(scores: DataFrame, *extra: str) -> DataFrame:
    """Per customer (and ``extra``): score rows, non-null scores, their sum, high-risk rows."""
    return scores.filter(F.col(KEY).isNotNull()).groupBy(KEY, *extra).agg(
        rows().alias("score_rows"),
        F.count("risk_score").alias("scored"),
        F.sum("risk_score").alias("score_sum"),
        high().alias("high_rows"),
    )


def daily_summary(scores: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    category = F.col("risk_category")
    return (
        since(scores, days_before(as_of, 30))
        .groupBy(F.to_date("prediction_date").alias("report_date"))
        .agg(
            rows().alias("total_assessments"),
            F.count_if(category == "Low").alias("low_risk_count"),
            F.count_if(category == "Medium").alias("medium_risk_count"),
            high().alias("high_risk_count"),
            rounded(F.avg("risk_score"), 2).alias("avg_risk_score"),
            rounded(F.avg("default_probability"), 4).alias("avg_default_probability"),
        )
        .orderBy(F.col("report_date").desc())
    )


def model_metrics(metadata: DataFrame, limit: int = 5) -> DataFrame:
    """The most recently trained models with rounded metrics."""
    renamed = {"precision_score": "precision"}
    metrics = ["accuracy", "precision_score", "recall", "f1_score", "auc_roc"]
    return (
        metadata.orderBy(F.col("training_date").desc_nulls_last(), F.col("model_id").desc())
        .limit(limit)
        .select(
            "model_name", "model_version", "algorithm",
            *[rounded(F.col(m), 4).alias(renamed.get(m, m)) for m in metrics],
            "training_date",
        )
    )


def risk_by_demographics(
    customers: DataFrame, scores: DataFrame, as_of: dt.date | None = None
) -> DataFrame:
    recent = score_sums(since(scores, days_before(as_of, 7)))
    return (
        customers.join(recent, KEY)
        .groupBy(below_bands(F.col("age"), *AGE_BANDS).alias("age_group"), "employment_status")
        .agg(
            F.sum("score_rows").alias("customer_count"),
            rounded(ratio(F.sum("score_sum"), F.sum("scored")), 2).alias("avg_risk_score"),
            F.sum("high_rows").alias("high_risk_count"),
        )
        .orderBy("age_group", F.col("employment_status").asc_nulls_last())
    )


def loans_by_amount(loans: DataFrame) -> DataFrame:
    defaults = F.count_if(F.col("default_flag"))
    return (
        loans.groupBy(below_bands(F.col("loan_amount"), *AMOUNT_BANDS).alias("loan_range"))
        .agg(
            rows().alias("total_loans"),
            defaults.alias("defaults"),
            percent(defaults, rows()).alias("default_rate"),
            rounded(F.avg("interest_rate") * 100, 2).alias("avg_interest_rate"),
            rounded(F.avg("debt_to_income_ratio"), 2).alias("avg_dti"),
        )
        .orderBy("loan_range")
    )


def default_by_score(credit: DataFrame, loans: DataFrame, approx: bool = False) -> DataFrame:
    """Loans and defaults by credit-score band; a band counts a loan id once, and loan
    rows and their defaults once per credit record of the customer in the band.

    With ``approx`` loan ids are counted by sketches, which are merged per customer first.
    """
    known = F.col(KEY).isNotNull()
    band = below_bands(F.col("credit_score"), *SCORE_BANDS).alias("credit_score_range")
    records = credit.filter(known).groupBy(KEY, band).agg(rows().alias("records"))
    counts = [rows().alias("loans"), F.count_if(F.col("default_flag")).alias("defaults")]
    totals = [
        weighted("defaults", "records").alias("defaults"),
        percent(weighted("defaults", "records"), weighted("loans", "records")).alias("default_rate"),
    ]
    band_name = "credit_score_range"
    if approx:
        # One row per customer, however many loans; a customer has a few bands at most.
        borrowing = loans.filter(known).groupBy(KEY).agg(*counts, sketch("loan_id").alias("loan_ids"))
        total = sketched(F.hll_union_agg("loan_ids")).alias("total_loans")
        by_band = borrowing.join(records, KEY).groupBy(band_name).agg(total, *totals)
        return by_band.orderBy(band_name)
    per_id = loans.filter(known).groupBy(KEY, "loan_id").agg(*counts)
    borrowing = per_id.groupBy(KEY).agg(
        F.sum("loans").alias("loans"), F.sum("defaults").alias("defaults"), F.count("loan_id").alias("ids")
    )
    by_band = borrowing.join(records, KEY).groupBy(band_name).agg(F.sum("ids").alias("ids"), *totals)
    # Ids of several customers count once a band: only they meet the records one by one.
    shared = per_id.filter(F.col("loan_id").isNotNull()).groupBy("loan_id").agg(rows().alias("owners")).filter("owners > 1")
    again = (
        per_id.select(KEY, "loan_id")
        .join(shared.select("loan_id"), "loan_id")
        .join(records.select(KEY, band_name), KEY)
        .groupBy(band_name, "loan_id")
        .agg((rows() - 1).alias("more"))
        .groupBy(band_name)
        .agg(F.sum("more").alias("more"))
        .withColumnRenamed(band_name, "again_in")
    )
    total = (F.col("ids") - F.coalesce("more", F.lit(0))).alias("total_loans")
    joined = by_band.join(again, F.col(band_name).eqNullSafe(F.col("again_in")), "left")
    return joined.select(band_name, total, "defaults", "default_rate").orderBy(band_name)


def risk_factors(
    features: DataFrame, credit: DataFrame, scores: DataFrame, as_of: dt.date | None = None
) -> DataFrame:
    """Scores of the last week beside four risk factors, counted per matching record."""
    c = F.col
    recent = score_sums(since(scores, days_before(as_of, 7)))
    labels = {
        "High DTI": "high_dti",
        "Low Credit Score": "low_score",
        "High Delinquency": "delinquent",
        "Bankruptcy History": "bankrupt",
    }
    from_features = features.filter(c(KEY).isNotNull()).groupBy(KEY).agg(
        F.count_if(c("debt_to_income") > 0.43).alias("high_dti"),
        F.count_if(c("credit_score") < 650).alias("low_score"),
    )
    from_credit = credit.filter(c(KEY).isNotNull()).groupBy(KEY).agg(
        F.count_if(c("num_delinquent_accounts") >= 2).alias("delinquent"),
        F.count_if(c("bankruptcy_flag")).alias("bankrupt"),
    )
    joined = recent.join(from_features, KEY, "left").join(from_credit, KEY, "left")
    zero = F.lit(0)

    def factor(label: str, column: str) -> Column:
        total = F.sum(F.when(c(column) > 0, c("score_sum") * c(column)))
        return F.struct(
            F.lit(label).alias("risk_factor"),
            F.coalesce(weighted("score_rows", column), zero).alias("customer_count"),
            rounded(ratio(total, weighted("scored", column)), 2).alias("avg_risk_score"),
        )

    factors = joined.agg(F.array(*[factor(k, v) for k, v in labels.items()]).alias("factors"))
    return factors.select(F.inline("factors")).orderBy(
        F.col("avg_risk_score").desc_nulls_last(), "risk_factor"
    )


def monthly_trend(scores: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return (
        since(scores, months_before(as_of, 12))
        .groupBy(F.date_trunc("month", "prediction_date").cast("timestamp_ntz").alias("month"))
        .agg(
            rows().alias("total_predictions"),
            rounded(F.avg("risk_score"), 2).alias("avg_risk_score"),
            high().alias("high_risk_count"),
            percent(high(), rows()).alias("high_risk_percentage"),
        )
        .orderBy(F.col("month").desc())
    )


def purpose_risk(loans: DataFrame, scores: DataFrame) -> DataFrame:
    """Loans by purpose, each loan counted once per score of its customer (at least once)."""
    c = F.col
    borrowing = loans.groupBy(KEY, "loan_purpose").agg(
        rows().alias("loans"),
        F.count_if(c("default_flag")).alias("defaults"),
        F.count("loan_amount").alias("amounts"),
        F.sum("loan_amount").alias("amount_sum"),
        F.count("interest_rate").alias("rates"),
        F.sum("interest_rate").alias("rate_sum"),
    )
    joined = borrowing.join(score_sums(scores), KEY, "left").withColumn(
        "copies", F.coalesce(c("score_rows"), F.lit(1))
    )
    return (
        joined.groupBy("loan_purpose")
        .agg(
            weighted("loans", "copies").alias("total_applications"),
            weighted("defaults", "copies").alias("defaults"),
            percent(weighted("defaults", "copies"), weighted("loans", "copies")).alias("default_rate"),
            rounded(ratio(weighted("score_sum", "loans"), weighted("scored", "loans")), 2).alias(
                "avg_predicted_risk"
            ),
            rounded(ratio(weighted("amount_sum", "copies"), weighted("amounts", "copies")), 2).alias(
                "avg_loan_amount"
            ),
            percent(weighted("rate_sum", "copies"), weighted("rates", "copies")).alias("avg_interest_rate"),
        )
        .orderBy(F.col("default_rate").desc_nulls_last(), "loan_purpose")
    )


def segments(
    customers: DataFrame, credit: DataFrame, scores: DataFrame, as_of: dt.date | None = None, approx: bool = False
) -> DataFrame:
    """Income by credit segments; a customer counts once per segment, scores once per record."""
    recent = score_sums(since(scores, days_before(as_of, 30)))
    band = below_bands(F.col("credit_score"), *CREDIT_SEGMENTS).alias("credit_segment")
    records = credit.filter(F.col(KEY).isNotNull()).groupBy(KEY, band).agg(rows().alias("records"))
    income = below_bands(F.col("annual_income"), *INCOME_SEGMENTS).alias("income_segment")
    return (
        customers.select(KEY, income)
        .join(recent, KEY)
        .join(records, KEY)
        .groupBy("income_segment", "credit_segment")
        .agg(
            distinct_count(KEY, approx).alias("customer_count"),
            rounded(ratio(weighted("score_sum", "records"), weighted("scored", "records")), 2).alias(
                "avg_risk_score"
            ),
            weighted("high_rows", "records").alias("high_risk_count"),
        )
        .orderBy("income_segment", "credit_segment")
    )


def calibration(
    scores: DataFrame, loans: DataFrame, as_of: dt.date | None = None, per_loan: bool = False
) -> DataFrame:
    """Predicted beside actual default rate by category.

    Scores meet all loans of their customer; ``per_loan`` pairs them by loan instead.
    """
    c = F.col
    keys = [KEY, "loan_id"] if per_loan else [KEY]
    predicted = (
        since(scores, months_before(as_of, 6))
        .filter(c(KEY).isNotNull())
        .groupBy(*keys, "risk_category")
        .agg(
            rows().alias("score_rows"),
            F.count("default_probability").alias("probabilities"),
            F.sum("default_probability").alias("probability_sum"),
        )
    )
    actual = loans.filter(c(KEY).isNotNull()).groupBy(*keys).agg(
        rows().alias("loans"), F.count_if(c("default_flag")).alias("defaults")
    )
    return (
        predicted.join(actual, keys)
        .groupBy("risk_category")
        .agg(
            weighted("score_rows", "loans").alias("predictions"),
            weighted("score_rows", "defaults").alias("actual_defaults"),
            percent(weighted("score_rows", "defaults"), weighted("score_rows", "loans")).alias(
                "actual_default_rate"
            ),
            percent(weighted("probability_sum", "loans"), weighted("probabilities", "loans")).alias(
                "predicted_default_rate"
            ),
        )
        .orderBy(c("risk_category").asc_nulls_last())
    )


def potential_loss(
    customers: DataFrame, credit: DataFrame, loans: DataFrame, scores: DataFrame,
    as_of: dt.date | None = None, limit: int = 100,
) -> DataFrame:
    """Largest loan amount times default probability over all loan and score pairs.

    The largest loan with the largest probability is a customer's best pair. Only the
    ``limit`` customers with the best ones can be in the result; loans and scores of all
    others are left out before pairing. Within a customer the pair of the i-th largest loan
    and the j-th largest probability has at least i*j - 1 pairs before it, so pairs with i*j
    above ``limit`` are filtered out; at most ``limit`` customers form up to limit * limit.
    """
    c = F.col
    known = c(KEY).isNotNull()
    all_large = loans.filter(known & (c("loan_amount") > 50000)).select(KEY, "loan_id", "loan_amount")
    all_risky = (
        since(scores, days_before(as_of, 30))
        .filter(known & c("risk_category").isin("Medium", "High"))
        .select(KEY, "prediction_id", "risk_score", "risk_category", "default_probability")
    )
    most, chance = c("most"), c("chance")
    best = (
        all_large.groupBy(KEY).agg(F.max("loan_amount").alias("most"))
        .join(all_risky.groupBy(KEY).agg(F.max("default_probability").alias("chance")), KEY)
        .join(customers.select(KEY), KEY, "left_semi")
        .join(credit.select(KEY), KEY, "left_semi")
        .orderBy((most * chance).desc_nulls_last(), most.desc(), chance.desc_nulls_last(), KEY)
        .limit(limit)
        .select(KEY)
    )
    # ``best`` holds at most ``limit`` rows.
    large = top_per_key(
        all_large.join(F.broadcast(best), KEY, "left_semi"),
        [KEY], [c("loan_amount").desc(), c("loan_id")], limit, rank="loan_rank",
    )
    risky = top_per_key(
        all_risky.join(F.broadcast(best), KEY, "left_semi"),
        [KEY], [c("default_probability").desc_nulls_last(), c("prediction_id")], limit, rank="score_rank",
    )
    records = top_per_key(
        credit.filter(known).select(KEY, "credit_id", "credit_score"), [KEY], [c("credit_id")], limit
    )
    loss = c("loan_amount") * c("default_probability")
    return (
        risky.join(large, KEY)
        .filter(c("loan_rank") * c("score_rank") <= limit)
        .withColumn("potential_loss", loss)
        .join(customers.select(KEY, "annual_income"), KEY)
        .join(records, KEY)
        .orderBy(
            c("potential_loss").desc_nulls_last(), c("loan_amount").desc(),
            c("default_probability").desc_nulls_last(), KEY, "loan_id", "prediction_id", "credit_id",
        )
        .limit(limit)
        .select(KEY, "annual_income", "credit_score", "loan_amount", "risk_score", "risk_category",
                "potential_loss", "loan_id", "prediction_id")
    )


def feature_distribution(customers: DataFrame, credit: DataFrame, loans: DataFrame) -> DataFrame:
    def spread(df: DataFrame, label: str, column: str) -> DataFrame:
        return df.agg(
            F.lit(label).alias("feature"),
            rounded(F.avg(column), 2).alias("mean_value"),
            rounded(F.stddev_samp(column), 2).alias("std_dev"),
            F.min(column).cast("double").alias("min_value"),
            F.max(column).cast("double").alias("max_value"),
        )

    return reduce(
        DataFrame.unionByName,
        [
            spread(credit, "Credit Score", "credit_score"),
            spread(customers, "Annual Income", "annual_income"),
            spread(loans, "Debt to Income", "debt_to_income_ratio"),
        ],
    )


def weekly_alerts(
    scores: DataFrame, as_of: dt.date | None = None, ids_per_row: int = 1000
) -> DataFrame:
    """New high-risk scores and sudden increases, with the customers concerned.

    The list of customers is written in numbered parts of ``ids_per_row`` ids in
    order of prediction, so that it stays whole at any length; a short list is one
    part. Increases are looked for within the last 30 days only.
    """
    c = F.col
    month = since(scores, days_before(as_of, 30)).select(
        KEY, "prediction_id", "prediction_date", "risk_score", "risk_category"
    )
    new_high = since(month, days_before(as_of, 7)).filter(c("risk_category") == "High")
    order = ["prediction_date", "prediction_id"]
    runs = in_runs(month, [KEY], order)
    jumps = neighbour(runs, [KEY], order, ["risk_score"]).filter(
        c("risk_score") - c("near_risk_score") > 20
    )
    alerts = reduce(
        DataFrame.unionByName,
        [
            df.select(F.lit(label).alias("alert_type"), KEY, "prediction_id")
            for label, df in (("New High Risk Customers", new_high), ("Sudden Risk Increase", jumps))
        ],
    )
    placed = prefix_sums(alerts, ["alert_type"], "prediction_id", {"position": F.lit(1)})
    enough = c("all_position") > F.when(c("alert_type") == "New High Risk Customers", 10).otherwise(0)
    part = F.floor((c("position") - 1) / ids_per_row) + 1
    ids = F.transform(
        F.array_sort(F.collect_list(F.struct("position", KEY))), lambda row: row[KEY].cast("string")
    )
    return (
        placed.filter(enough)
        .groupBy("alert_type", part.alias("part"))
        .agg(F.max("all_position").alias("alert_count"), F.array_join(ids, ", ").alias("customer_ids"))
        .select(day(as_of).alias("report_date"), "alert_type", "alert_count", "part", "customer_ids")
        .orderBy("alert_type", "part")
    )


def profitability(scores: DataFrame, loans: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Interest, losses and profit by category, each loan counted once per score."""
    c = F.col
    counts = (
        since(scores, months_before(as_of, 12))
        .filter(c(KEY).isNotNull())
        .groupBy(KEY, "risk_category")
        .agg(rows().alias("score_rows"))
    )
    interest = c("loan_amount") * c("interest_rate") * (c("loan_term_months") / 12)
    borrowing = loans.filter(c(KEY).isNotNull()).groupBy(KEY).agg(
        rows().alias("loans"),
        F.count("loan_amount").alias("amounts"),
        F.sum("loan_amount").alias("amount_sum"),
        F.count("interest_rate").alias("rates"),
        F.sum("interest_rate").alias("rate_sum"),
        F.sum(interest).alias("interest"),
        F.sum(F.when(c("default_flag"), c("loan_amount")).otherwise(0.0)).alias("loss"),
    )
    revenue, lost = weighted("interest", "score_rows"), weighted("loss", "score_rows")
    return (
        counts.join(borrowing, KEY)
        .groupBy("risk_category")
        .agg(
            weighted("loans", "score_rows").alias("loan_count"),
            rounded(ratio(weighted("amount_sum", "score_rows"), weighted("amounts", "score_rows")), 2).alias(
                "avg_loan_amount"
            ),
            percent(weighted("rate_sum", "score_rows"), weighted("rates", "score_rows")).alias(
                "avg_interest_rate"
            ),
            rounded(revenue, 2).alias("total_interest_revenue"),
            rounded(lost, 2).alias("total_loss_from_defaults"),
            rounded(revenue - lost, 2).alias("net_profit"),
        )
        .orderBy(c("risk_category").asc_nulls_last())
    )


def data_quality(customers: DataFrame, credit: DataFrame, loans: DataFrame) -> DataFrame:
    """Row counts, nulls of two columns and last update; column names follow the first table."""

    def table(df: DataFrame, label: str, first: str, second: str) -> DataFrame:
        return df.agg(
            F.lit(label).alias("table_name"),
            rows().alias("total_records"),
            F.count_if(F.col(first).isNull()).alias("null_age"),
            F.count_if(F.col(second).isNull()).alias("null_income"),
            F.max("created_at").alias("last_updated"),
        )

    return reduce(
        DataFrame.unionByName,
        [
            table(customers, "Customers", "age", "annual_income"),
            table(credit, "Credit History", "credit_score", "credit_utilization_ratio"),
            table(loans, "Loan Applications", "loan_amount", "interest_rate"),
        ],
    )
