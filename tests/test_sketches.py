"""Sketches beside exact counts, and the queries about one customer."""

import datetime as dt

from pyspark.sql import functions as F

from lendwell.functions import sketches as sk
from lendwell.plans import feature_queries as fq, reports as rq, scoring

AS_OF = dt.date(2001, 8, 2)


def near(found, exact):
    return abs(found - exact) <= max(1, sk.ERROR * exact)


def test_error_of_many_ids(spark):
    ids = spark.range(300_000).select((F.col("id") * 7919 % 123_457).alias("id"), (F.col("id") % 10).alias("d"))
    exact = ids.agg(F.count_distinct("id")).first()[0]
    assert near(ids.agg(sk.distinct_count("id", approx=True)).first()[0], exact)
    assert ids.agg(sk.distinct_count("id")).first()[0] == exact


def test_reports_by_sketches(small):
    customers, credit, transactions, loans = small.staging
    both = [{r["credit_score_range"]: r.asDict() for r in rq.default_by_score(credit, loans, approx=a).collect()} for a in (False, True)]
    assert both[0].keys() == both[1].keys() and both[0]
    for band, exact in both[0].items():
        assert near(both[1][band].pop("total_loans"), exact.pop("total_loans")) and both[1][band] == exact
    both = [
        {(r["income_segment"], r["credit_segment"]): r.asDict() for r in rq.segments(customers, credit, small.risk_scores, AS_OF, approx=a).collect()}
        for a in (False, True)
    ]
    assert both[0].keys() == both[1].keys()
    for key, exact in both[0].items():
        assert near(both[1][key].pop("customer_count"), exact.pop("customer_count")) and both[1][key] == exact
    both = [{r["customer_id"]: r.asDict() for r in fq.customer_profile(*small.staging, approx=a).collect()} for a in (False, True)]
    for key, exact in both[0].items():
        found = both[1][key]
        assert near(found["total_transactions"], exact["total_transactions"]) and near(found["total_loans"], exact["total_loans"])


def test_stored_days_merge(spark, small, tmp_path):
    path = str(tmp_path / "sketches")
    day = F.to_date("prediction_date")
    sk.daily_sketches(small.risk_scores, day, "customer_id").write.parquet(path)
    first, last = dt.date(2001, 1, 1), dt.date(2001, 7, 1)
    found = sk.distinct_between(spark.read.parquet(path), first, last).first()["ids"]
    exact = small.risk_scores.filter(day.between(F.lit(first), F.lit(last))).agg(F.count_distinct("customer_id")).first()[0]
    assert exact > 50 and near(found, exact)
    none = sk.distinct_between(spark.read.parquet(path), dt.date(1900, 1, 1), dt.date(1900, 1, 2)).first()["ids"]
    assert none == 0


def test_one_customer(small):
    customers, credit, transactions, loans = small.staging
    scores = small.risk_scores
    whole = {
        "customer_profile": fq.customer_profile(*small.staging),
        "transaction_features": fq.transaction_totals(transactions),
        "recent_loans": fq.recent_loans(loans),
        "utilization_trend": fq.utilization_trend(credit),
        "loan_capacity": fq.loan_capacity(customers),
        "employment_stability": fq.employment_stability(customers),
        "risk_trend": fq.risk_trend(scores),
        "latest_credit": fq.latest_credit(credit),
        "latest_score": scoring.latest_scores(scores),
    }
    for customer in (7, 49, -1):  # 49 has no linked credit record
        views = fq.customer_view(customer, *small.staging, scores)
        assert views.keys() == whole.keys()
        for name, df in views.items():
            assert sorted(map(str, df.collect())) == sorted(map(str, whole[name].filter(F.col("customer_id") == customer).collect())), name
    plan = fq.customer_view(7, *small.staging, scores)["loan_capacity"]._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,7)" in plan  # the filter reaches the scan


def test_loan_ids_of_several_customers_count_once(spark):
    credit = spark.createDataFrame([(1, 620), (1, 630), (2, 640), (3, 800), (4, 610), (None, 620)], "customer_id long, credit_score int")
    loans = spark.createDataFrame(
        [(1, 10, True), (1, 10, False), (2, 10, True), (3, 10, False), (2, 11, None), (4, None, True), (3, 12, True), (3, 12, True), (None, 13, True)],
        "customer_id long, loan_id long, default_flag boolean",
    )
    want = {
        (r["credit_score_range"], r["n"], r["d"])
        for r in loans.join(credit.withColumn("credit_score_range", F.when(F.col("credit_score") < 650, "600-649").otherwise("750+")), "customer_id")
        .groupBy("credit_score_range").agg(F.count_distinct("loan_id").alias("n"), F.count_if("default_flag").alias("d")).collect()
    }
    for approx in (False, True):
        got = rq.default_by_score(credit, loans, approx=approx).collect()
        assert {(r["credit_score_range"], r["total_loans"], r["defaults"]) for r in got} == want
