"""Entry points for verification: flagship query, all queries, and their DuckDB twins."""

from __future__ import annotations

import datetime as dt
import importlib.util
import os
import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import oracles  # noqa: E402
from lendwell.functions import credit as fx  # noqa: E402
from lendwell.functions.columns import rounded as exact  # noqa: E402
from lendwell.operators import check_state, evaluation, quality  # noqa: E402
from lendwell.plans import (  # noqa: E402
    dashboard, feature_queries as fq, features as feat, jobs, reports as rq, requests as req, scoring, training,
)
from lendwell.sources import tables  # noqa: E402
from lendwell.sources.adapter import LendingTables, lending_tables, stream, view  # noqa: E402
from lendwell.session import release, scratch_path  # noqa: E402
from lendwell.streaming import daily, scoring as stream_scoring  # noqa: E402

AS_OF = dt.date(2001, 8, 2)
AT = dt.datetime(2001, 8, 2, 12, 0)
Query = Callable[[SparkSession, str], DataFrame]
c = F.col


def rounded(df: DataFrame, digits: int | dict[str, int]) -> DataFrame:
    """Pin doubles to a number of digits, for one column set or for every double."""
    if isinstance(digits, int):
        digits = {name: digits for name, kind in df.dtypes if kind == "double"}
    return df.withColumns({name: exact(c(name), n) for name, n in digits.items()})


def wide_features(t: LendingTables) -> DataFrame:
    return feat.risk_features(*t.staging)


def stored_features(t: LendingTables) -> DataFrame:
    return feat.feature_store(wide_features(t))


def etl_risk_features(t: LendingTables) -> DataFrame:
    return rounded(
        wide_features(t),
        {"avg_monthly_spending": 6, "spending_volatility": 6, "total_spending": 4,
         "employment_stability_score": 6, "delinquency_score": 6, "loan_to_income_ratio": 6},
    )


def scored(t: LendingTables) -> DataFrame:
    """Stored probabilities and the rule scorecard on the same loans, as two models."""
    stored = scoring.scored_loans(t.loan_applications, t.risk_scores).select(
        F.lit("stored_score").alias("model_name"), "label", "probability"
    )
    rules = wide_features(t).select(
        F.lit("rule_scorecard").alias("model_name"),
        c("default_flag").cast("int").alias("label"),
        exact(rule_probability(), 6).alias("probability"),
    )
    return stored.unionByName(rules)


def rule_probability():
    return fx.rule_scorecard(
        c("credit_score"), c("debt_to_income_ratio"), c("employment_status"), c("num_delinquent_accounts")
    )


def metadata(t: LendingTables) -> DataFrame:
    return scoring.metadata_from_outcomes(scoring.scored_loans(t.loan_applications, t.risk_scores))


def suite(t: LendingTables) -> DataFrame:
    return quality.suite(*t.staging)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def loan_feature(name: str, column, digits: int | None = 6) -> Callable[[LendingTables], DataFrame]:
    def run(t: LendingTables) -> DataFrame:
        value = column() if digits is None else exact(column(), digits)
        return wide_features(t).select("loan_id", value.alias(name))

    return run


def of(table: str, key: str, name: str, column, digits: int | None = 6) -> Callable[[LendingTables], DataFrame]:
    def run(t: LendingTables) -> DataFrame:
        value = column() if digits is None else exact(column(), digits)
        return getattr(t, table).select(key, value.alias(name))

    return run


LOAN_TERMS = lambda: (c("loan_amount"), c("interest_rate"), c("loan_term_months"))

# Queries over the five lending tables.
TABLE_QUERIES: dict[str, Callable[[LendingTables], DataFrame]] = {
    "fe_income_category": of("customers", "customer_id", "income_category",
                             lambda: fx.income_category(c("annual_income"), include_lowest=True), None),
    "fe_employment_stability": of("customers", "customer_id", "employment_stability_score",
                                  lambda: fx.employment_stability(c("age"), c("years_employed"))),
    "fe_delinquency_penalised": of(
        "credit_history", "credit_id", "delinquency_score",
        lambda: fx.delinquency_penalised(c("num_delinquent_accounts"), c("credit_utilization_ratio"))),
    "fe_delinquency_score": of(
        "credit_history", "credit_id", "delinquency_score",
        lambda: fx.delinquency_score(c("num_delinquent_accounts"), c("credit_utilization_ratio"))),
    "fe_loan_to_income": loan_feature("loan_to_income_ratio",
                                      lambda: fx.loan_to_income(c("loan_amount"), c("annual_income"))),
    "fe_monthly_payment": of("loan_applications", "loan_id", "monthly_payment",
                             lambda: fx.monthly_payment(*LOAN_TERMS()), 4),
    "fe_debt_to_income": loan_feature("debt_to_income",
                                      lambda: fx.debt_to_income(*LOAN_TERMS(), c("annual_income"))),
    "fe_credit_age_score": loan_feature("credit_age_score",
                                        lambda: fx.credit_age_score(c("years_credit_history"), c("age"))),
    "fe_debt_burden": loan_feature("debt_burden", lambda: fx.debt_burden(c("total_debt"), c("annual_income"))),
    "fe_utilization_category": lambda t: feat.utilization_categories(t.credit_history, t.loan_applications),
    "fe_payment_consistency": lambda t: rounded(feat.payment_consistency(t.customers, t.transactions), 6),
    "fe_interactions": lambda t: rounded(
        wide_features(t).select("loan_id", *[v.alias(k) for k, v in fx.interactions().items()]), 6),
    "fe_risk_flags": lambda t: wide_features(t).select(
        "loan_id", *[v.alias(k) for k, v in fx.risk_flags().items()]),
    "fe_binned": lambda t: wide_features(t).select("loan_id", *[v.alias(k) for k, v in fx.binned().items()]),
    "fe_transaction_aggregates": lambda t: rounded(
        feat.aggregate_features(t.transactions),
        {"avg_transaction_amount": 6, "transaction_volatility": 6, "total_transaction_amount": 4}),
    "fe_rate_tier": lambda t: t.credit_history.select(
        "credit_id", *[v.alias(k) for k, v in fx.rate_tier(c("credit_score")).items()]),
    "fe_rule_scorecard": loan_feature("default_probability", rule_probability),
    "fe_base_credit_score": of("customers", "customer_id", "base_credit_score",
                               lambda: fx.base_credit_score(c("annual_income"), c("years_employed"))),
    "etl_risk_features": etl_risk_features,
    "etl_feature_row_count": lambda t: wide_features(t).agg(
        F.count(F.lit(1)).alias("feature_rows"), F.count("credit_id").alias("with_credit"),
        F.count("transaction_count").alias("with_transactions"),
        F.count_distinct("customer_id").alias("customers")),
    "etl_feature_store": lambda t: rounded(
        stored_features(t),
        {k: 6 for k in ("employment_stability_score", "delinquency_score", "avg_monthly_spending",
                        "transaction_volatility", "payment_consistency_score", "loan_to_income_ratio")}),
    "fq_customer_profile": lambda t: rounded(
        fq.customer_profile(*t.staging), {"avg_transaction_amount": 8, "transaction_volatility": 8}),
    "fq_transaction_features": lambda t: rounded(
        fq.transaction_totals(t.transactions),
        {"avg_monthly_spending": 6, "spending_volatility": 6, "total_debits": 4, "total_credits": 4}),
    "fq_recent_loans": lambda t: fq.recent_loans(t.loan_applications),
    "fq_utilization_trend": lambda t: rounded(fq.utilization_trend(t.credit_history), {"avg_utilization": 6}),
    "fq_loan_capacity": lambda t: rounded(
        fq.loan_capacity(t.customers), {"max_recommended_loan": 4, "max_monthly_payment": 4}),
    "fq_retraining_set": lambda t: fq.retraining_set(t.customers, t.credit_history, t.loan_applications, AS_OF),
    "fq_employment_stability": lambda t: rounded(fq.employment_stability(t.customers), 6),
    "fq_risk_trend": lambda t: rounded(fq.risk_trend(t.risk_scores), {"risk_change": 6}),
    "fq_latest_credit": lambda t: fq.latest_credit(t.credit_history),
    "fq_default_by_purpose": lambda t: rounded(
        fq.default_by_purpose(t.loan_applications), {"avg_loan_amount": 4, "avg_interest_rate": 6}),
    "fq_high_dti_good_credit": lambda t: fq.high_dti_good_credit(
        t.customers, t.credit_history, t.loan_applications),
    "rq_daily_summary": lambda t: rq.daily_summary(t.risk_scores, AS_OF),
    "rq_model_metrics": lambda t: rq.model_metrics(metadata(t)),
    "rq_risk_by_demographics": lambda t: rq.risk_by_demographics(t.customers, t.risk_scores, AS_OF),
    "rq_loans_by_amount": lambda t: rq.loans_by_amount(t.loan_applications),
    "rq_default_by_score": lambda t: rq.default_by_score(t.credit_history, t.loan_applications),
    "rq_monthly_trend": lambda t: rq.monthly_trend(t.risk_scores, AS_OF),
    "rq_purpose_risk": lambda t: rq.purpose_risk(t.loan_applications, t.risk_scores),
    "rq_segments": lambda t: rq.segments(t.customers, t.credit_history, t.risk_scores, AS_OF),
    "rq_calibration": lambda t: rq.calibration(t.risk_scores, t.loan_applications, AS_OF),
    "rq_potential_loss": lambda t: rq.potential_loss(
        t.customers, t.credit_history, t.loan_applications, t.risk_scores, AS_OF),
    "rq_feature_distribution": lambda t: rq.feature_distribution(
        t.customers, t.credit_history, t.loan_applications),
    "rq_weekly_alerts": lambda t: rq.weekly_alerts(t.risk_scores, AS_OF),
    "rq_profitability": lambda t: rq.profitability(t.risk_scores, t.loan_applications, AS_OF),
    "rq_data_quality": lambda t: rq.data_quality(t.customers, t.credit_history, t.loan_applications),
    "dq_freshness": lambda t: union(
        [quality.freshness(df, name, "created_at", AS_OF)
         for name, df in zip(("customers", "credit_history", "transactions", "loan_applications"), t.staging)]),
    "dq_summary": lambda t: quality.summary(suite(t)),
    "dq_suite": suite,
    "dq_latest_timestamps": lambda t: quality.latest_timestamps(*t.staging),
    "dq_documented_rules": lambda t: documented(t),
    "ml_stratified_split": lambda t: training.stratified_split(
        t.loan_applications.select("loan_id", c("default_flag").cast("int").alias("label")), "label", "loan_id"),
    "score_categorize": lambda t: rounded(
        scoring.categorize(t.risk_scores.select("loan_id", "default_probability")).drop("default_probability"), 6),
    "score_categorize_right_closed": lambda t: t.risk_scores.select(
        "loan_id", fx.risk_category_right_closed(c("risk_score")).alias("risk_category")),
    "ev_report": lambda t: rounded(evaluation.report(scored(t)), 6),
    "ev_roc_curve": lambda t: rounded(evaluation.roc_curve(scored(t)), {"fpr": 6, "tpr": 6}),
    "ev_auc": lambda t: rounded(evaluation.report(scored(t)).select("model_name", "auc_roc"), 6),
    "ev_pr_curve": lambda t: rounded(evaluation.pr_curve(scored(t)), {"precision": 6, "recall": 6}),
    "ev_average_precision": lambda t: rounded(
        evaluation.report(scored(t)).select("model_name", "average_precision"), 6),
    "ev_confusion_matrix": lambda t: evaluation.confusion_matrix(scored(t)),
    "ev_threshold_sweep": lambda t: rounded(
        evaluation.threshold_sweep(scored(t)), {"precision": 6, "recall": 6, "f1_score": 6}),
    "ev_optimal_threshold": lambda t: rounded(evaluation.optimal_threshold(scored(t)), {"f1_score": 6}),
    "ev_compare_models": lambda t: rounded(
        evaluation.compare_models(evaluation.report(scored(t)), ["stored_score", "rule_scorecard"]), 6),
    "latest_risk_score": lambda t: scoring.latest_scores(t.risk_scores),
    "latest_model_metrics": lambda t: rounded(scoring.latest_model(metadata(t)), 6),
    "daily_run_summary": lambda t: rounded(
        jobs.run_summary(suite(t), wide_features(t), metadata(t), t.risk_scores, dt.date(2001, 7, 1)), 6),
    "performance_drop_alerts": lambda t: rounded(training.performance_drops(metadata(t)).drop("model_name"), 6),
    "dash_category_share": lambda t: dashboard.category_share(t.risk_scores),
    "dash_score_histogram": lambda t: dashboard.score_histogram(t.risk_scores),
    "dash_recent_predictions": lambda t: dashboard.recent_predictions(t.risk_scores),
    "dash_key_factors": lambda t: dashboard.key_factors(wide_features(t)),
}


def documented(t: LendingTables) -> DataFrame:
    """Documented rules of the four tables; credit records meet their customer's age."""
    credit = quality.with_owner_age(t.credit_history, t.customers)
    frames = [t.customers, credit, t.transactions, t.loan_applications]
    names = ["customers", "credit_history", "transactions", "loan_applications"]
    return union([
        quality.count_rules(df, name, quality.documented_rules(name, AS_OF)) for name, df in zip(names, frames)
    ])


# Queries that also read the faulty customers or the request table.
def dq_missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union([
        rounded(quality.missing_values(view(spark, sf_dir, name), name, 0.05), 6)
        for name in ("customers", "credit_history", "dirty_customers")
    ])


def dq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union([
        quality.duplicates(view(spark, sf_dir, name), name, ["customer_id"])
        for name in ("dirty_customers", "customers", "credit_history")
    ])


def dq_value_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union([
        quality.count_rules(view(spark, sf_dir, name), name, quality.range_rules(quality.RANGES[rules]))
        for name, rules in (("dirty_customers", "customers"), ("credit_history", "credit_history"))
    ])


def dq_referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = view(spark, sf_dir, "customers")
    children = {
        "dirty_customers": "customers -> dirty_customers",
        "credit_history": "customers -> credit_history",
        "transactions": "customers -> transactions",
        "loan_applications": "customers -> loans",
    }
    # One grouping of all keys; every table is read once.
    named = {relation: (name, view(spark, sf_dir, name)) for name, relation in children.items()}
    return quality.key_checks(parent, named, "customer_id", "customers", unique=())


def dq_suite_from_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suite from the state of three deliveries that hold all rows of the tables between them."""
    t = lending_tables(spark, sf_dir)
    path = scratch_path(spark, "check-state")
    for number in range(3):
        rows = {name: df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(3)) == number)
                for name, df in zip(check_state.TABLES, t.staging)}
        check_state.record(rows, path, AS_OF + dt.timedelta(days=number))
    return check_state.suite_from_state(spark, path)


def dq_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers by column, beside the check of their table."""
    return quality.with_anomaly_check(
        quality.outlier_counts(view(spark, sf_dir, "dirty_customers"), "dirty_customers", ["age", "annual_income"]))


def dq_data_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = {"request_id": "bigint", "customer_id": "bigint", "loan_amount": "double", "loan_term_months": "int"}
    requests = view(spark, sf_dir, "requests")
    check = quality.data_types(requests, "requests", expected).first()
    return quality.unreadable_values(requests, "requests", expected).withColumns(
        {"status": F.lit(check["status"]), "bad": F.lit(check["bad"]).cast("long"), "messages": F.lit(check["messages"])}
    )


def dq_business_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = {"dirty_customers": "customers", "customers": "customers",
              "credit_history": "credit_history", "loan_applications": "loan_applications"}
    return union([
        quality.count_rules(view(spark, sf_dir, name), name, quality.business_rules(rules))
        for name, rules in checked.items()
    ])


def dq_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.impute(
        view(spark, sf_dir, "dirty_customers"), ["age", "annual_income"], ["employment_status"])


def request_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lending_tables(spark, sf_dir)
    people = req.customer_table(t.customers, t.credit_history, t.transactions)
    return req.request_features(view(spark, sf_dir, "requests"), people)


def req_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.validate(view(spark, sf_dir, "requests")).select("request_id", "valid", "message")


def req_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = request_frame(spark, sf_dir).filter(c("valid") & c("found"))
    digits = {k: 6 for k in ("avg_monthly_spending", "spending_volatility", "employment_stability_score",
                             "delinquency_score", "loan_to_income_ratio", "debt_to_income_ratio")}
    return rounded(ready, digits).drop(
        "valid", "found", "message", "loan_purpose", "employment_status", "home_ownership")


def req_batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.with_status(request_frame(spark, sf_dir)).select("request_id", "customer_id", "status", "message")


def req_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.batch_summary(req.with_status(request_frame(spark, sf_dir)))


# Queries over the stored feature table, which is built once for a session and folder.
_STORED: dict[tuple, str] = {}


def kept_features(spark: SparkSession, sf_dir: str, by_customer: bool = True) -> DataFrame:
    """The wide feature table as the daily job stores it: a day's folder, in buckets of the customer."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch_path(spark, "features")
        tables.store_features(wide_features(lending_tables(spark, sf_dir)), path, AS_OF)
        release(spark)
        _STORED[key] = path
    return tables.read_features(spark, _STORED[key], by_customer)


def fq_high_risk_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = feat.feature_store(kept_features(spark, sf_dir))
    scores = view(spark, sf_dir, "risk_scores")
    return rounded(fq.high_risk_customers(features, scores, AS_OF), {"delinquency_score": 6})


def rq_risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lending_tables(spark, sf_dir)
    return rq.risk_factors(feat.feature_store(kept_features(spark, sf_dir)), t.credit_history, t.risk_scores, AS_OF)


def unscored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = feat.feature_store(kept_features(spark, sf_dir))
    return scoring.unscored(features, view(spark, sf_dir, "risk_scores"), dt.date(2001, 6, 1)).select(
        "customer_id", "loan_id", "credit_score", "debt_to_income")


# Queries that fit models; rows and fits are kept for all queries of a session and folder.
_ROWS: dict[tuple, training.Rows] = {}
_FITTED: dict[tuple, training.PipelineModel] = {}


def rows(spark: SparkSession, sf_dir: str) -> training.Rows:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROWS:
        _ROWS[key] = training.prepare(kept_features(spark, sf_dir, by_customer=False))
    return _ROWS[key]


def fitted(spark: SparkSession, sf_dir: str, name: str) -> training.PipelineModel:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FITTED:
        _FITTED[key] = training.fit(rows(spark, sf_dir), name)
    return _FITTED[key]


def forest(spark: SparkSession, sf_dir: str) -> training.PipelineModel:
    return fitted(spark, sf_dir, "random_forest")


def ml_feature_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model inputs of every loan under the encoding that was fitted on the training rows."""
    inputs = training.model_inputs(kept_features(spark, sf_dir, by_customer=False), "loan_id")
    encoded = rows(spark, sf_dir).preparation.transform(inputs)
    codes = [c(name).cast("int").alias(name) for name in training.ENCODED]
    return rounded(
        encoded.select("loan_id", "annual_income", "credit_score", "loan_to_income_ratio", *codes),
        {"loan_to_income_ratio": 6})


def ml_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = {name: fitted(spark, sf_dir, name) for name in training.MODELS}
    return training.model_comparison(training.test_scores(rows(spark, sf_dir), models))


def ml_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.feature_importance(forest(spark, sf_dir))


def ml_batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_features(spark, sf_dir, by_customer=False)
    return scoring.categorize(training.batch_scores(forest(spark, sf_dir), rows))


def ml_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.explain(forest(spark, sf_dir), kept_features(spark, sf_dir, by_customer=False))


def req_batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_scoring.responses(forest(spark, sf_dir), request_frame(spark, sf_dir), AT)


# Streams over the order table, run until the input is used up.
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "daily-counts")
    daily.write_daily(stream(spark, sf_dir, "risk_scores"), out, f"{out}-progress").awaitTermination()
    return daily.read_daily(spark, out)


def stream_request_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lending_tables(spark, sf_dir)
    people = scratch_path(spark, "customers")
    req.customer_table(t.customers, t.credit_history, t.transactions).write.parquet(people)
    out = scratch_path(spark, "request-scores")
    stream_scoring.score_stream(
        stream(spark, sf_dir, "requests"), forest(spark, sf_dir), spark.read.parquet(people),
        out, f"{out}-progress", AT,
    ).awaitTermination()
    return spark.read.parquet(out).drop("batch")


# What must hold of model results, whatever was fitted; rows are counted and compared with the tables.
def per_loan_scores(scores: DataFrame) -> DataFrame:
    category = fx.risk_category(c("risk_score"))
    return scores.groupBy("loan_id").agg(
        F.count(F.lit(1)).alias("scores"),
        F.count_if(c("default_probability").between(0, 1)).alias("in_range"),
        F.count_if(F.abs(c("risk_score") - 100 * c("default_probability")) < 1e-9).alias("percents"),
        F.count_if(c("risk_category") == category).alias("in_category"),
    )


def ml_batch_scores_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every loan has one score, its probability in percent and in its category."""
    return per_loan_scores(ml_batch_scores(spark, sf_dir))


# Loans whose explanations are checked at once; the rows that meet are some times the feature table's.
CHECKED_AT_ONCE = 10_000_000


def ml_explain_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every loan has five places, each of another feature, with the feature table's value."""
    t = lending_tables(spark, sf_dir)
    parts = max(1, -(-t.loan_applications.count() // CHECKED_AT_ONCE))
    values = training.model_inputs(wide_features(t), "loan_id")
    # Narrow rows meet, and the map is made after the join. Both sides have rows for every loan, more than
    # their files' bytes tell: neither may be sent to all tasks.
    table = values.select("loan_id", F.struct(*training.NUMERIC_FEATURES).alias("own"))
    own = F.create_map(*[x for name in training.NUMERIC_FEATURES for x in (F.lit(name), c("own")[name])])
    explained = ml_explain(spark, sf_dir)

    def checked(part: int) -> DataFrame:
        sides = [df if parts == 1 else df.filter(F.pmod(F.xxhash64("loan_id"), F.lit(parts)) == part) for df in (explained, table)]
        return sides[0].join(sides[1].hint("merge"), "loan_id").groupBy("loan_id").agg(
            F.count_distinct("place").alias("places"),
            F.count_distinct("feature").alias("features"),
            F.count_if(
                F.map_contains_key(own, c("feature")) & ~c("value").eqNullSafe(F.try_element_at(own, c("feature")))
            ).alias("other_values"),
        )

    if parts == 1:
        return checked(0)
    path = scratch_path(spark, "checked")
    for part in range(parts):
        checked(part).write.mode("append").parquet(path)
        release(spark)
    return spark.read.parquet(path)


def ml_importance_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twenty features, with importances that add up to 1."""
    return ml_feature_importance(spark, sf_dir).agg(
        F.count_distinct("feature").alias("features"), F.round(F.sum("importance"), 6).alias("total")
    )


def ml_comparison_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models, each with five metrics from 0 to 1."""
    metrics = F.array("accuracy", "precision", "recall", "f1_score", "auc_roc")
    good = F.size(F.filter(metrics, lambda m: m.between(0, 1)))
    return ml_model_comparison(spark, sf_dir).select("model_name", good.alias("metrics_in_range"))


def answered(responses: DataFrame) -> DataFrame:
    return responses.select(
        "request_id", "status", "message",
        (c("risk_score").isNotNull() & c("risk_category").isNotNull()
         & c("default_probability").between(0, 1)).alias("has_score"))


def req_batch_scores_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request has its status and message, and a score exactly when it succeeded."""
    return answered(req_batch_scores(spark, sf_dir))


def stream_request_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the request stream."""
    return answered(stream_request_scores(spark, sf_dir))


FOLDER_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        dq_suite_from_deliveries, dq_missing_values, dq_duplicates, dq_value_ranges, dq_referential_integrity, dq_anomalies,
        dq_data_types, dq_business_rules, dq_impute, req_validate, req_features, req_batch_status, req_batch_summary,
        ml_feature_prep, ml_model_comparison, ml_feature_importance, ml_batch_scores, ml_explain, req_batch_scores,
        fq_high_risk_customers, rq_risk_factors, unscored_customers,
        stream_daily_counts, stream_request_scores,
        ml_batch_scores_invariants, ml_explain_invariants, ml_importance_invariants, ml_comparison_invariants,
        req_batch_scores_invariants, stream_request_invariants,
    )
}


def over_tables(plan: Callable[[LendingTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(lending_tables(spark, sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    """The loan-grain feature table over the smallest data set."""
    return etl_risk_features(lending_tables(spark, "/root/testdata/sf0.001"))


def present(module: str) -> bool:
    """True if the module can be found; a left-over empty folder does not count."""
    try:
        return importlib.util.find_spec(module) is not None
    except ModuleNotFoundError:
        return False


def training_data_queries() -> dict[str, Query]:
    """Queries of the optional subpackage for training data, and its pipeline."""
    found: dict[str, Query] = {}
    if present("lendwell.llm.queries"):
        from lendwell.llm.queries import QUERIES

        found.update(QUERIES)
        if present("corpus_pipeline"):
            import corpus_pipeline

            found["pipeline"] = corpus_pipeline.run
    return found


def training_data_sql() -> dict[str, str]:
    if present("lendwell.llm.oracles"):
        from lendwell.llm.oracles import ORACLE_SQL

        return ORACLE_SQL
    return {}


def queries() -> dict[str, Query]:
    plans = {name: over_tables(plan) for name, plan in TABLE_QUERIES.items()}
    return {**plans, **FOLDER_QUERIES, **training_data_queries()}


def oracle_sql() -> dict[str, str]:
    return {**oracles.oracle_sql(), **training_data_sql()}
