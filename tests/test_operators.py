"""Skew-safe joins, ordered work across runs, picks and the split."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendwell.operators import ordered, skew
from lendwell.operators.picks import top_per_key
from lendwell.operators.skew import hot_keys, spread_join
from lendwell.operators.split import stratified_split
from lendwell.plans.feature_queries import recent_loans
from lendwell.plans.reports import potential_loss
from lendwell.session import CHECKPOINT_CONF, shared_folder


def skewed(spark, rows=900):
    return spark.range(rows).select(
        F.col("id"),
        F.expr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 50 = 1 THEN NULL ELSE id % 40 END").alias("k"),
        F.expr("id * 7919 % 1000").alias("t"),
    )


def test_hot_keys(spark):
    found = {r["hot_key"]: r["parts"] for r in hot_keys(skewed(spark), "k", 100).collect()}
    assert found == {1: 4}


def test_the_list_of_hot_keys_has_a_bound(spark, monkeypatch):
    """Many warm keys: no more come out than the bound, whatever their number."""
    monkeypatch.setattr(skew, "MOST_HOT_KEYS", 20)
    warm = spark.range(4000).select((F.col("id") % 400).alias("k"), F.lit("x").alias("v"))
    assert hot_keys(warm, "k", 5).count() == 0
    hot = warm.union(spark.range(2000).select(F.lit(7).cast("long"), F.lit("y")))
    assert [r["hot_key"] for r in hot_keys(hot, "k", 5).collect()] == [7]


def test_a_known_hot_list_is_used(spark):
    left = skewed(spark)
    right = spark.range(40).select(F.col("id").cast("int").alias("k"), F.col("id").alias("r"))
    known = hot_keys(left, "k", 10)
    again = spread_join(left, [right], "k", "id", rows_per_task=10, hot=known)
    assert sorted(map(str, again.collect())) == sorted(
        map(str, spread_join(left, [right], "k", "id", rows_per_task=10).collect())
    )


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_equals_plain_join(spark, how):
    left = skewed(spark)
    right = spark.range(60).select((F.col("id") % 30).alias("k"), F.col("id").alias("r"))
    plain = left.filter("k IS NOT NULL OR 'left' = '%s'" % how).join(right, "k", how)
    spread = spread_join(left, [right], "k", "id", how, rows_per_task=10)
    columns = ["id", "k", "t", "r"]
    assert sorted(map(str, spread.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))


def test_hot_key_is_cut_into_parts(spark):
    """No salted key carries more than about twice the allowed rows."""
    hot = hot_keys(skewed(spark, 3000), "k", 100)
    dealt = skewed(spark, 3000).join(F.broadcast(hot), F.col("k") == F.col("hot_key")).groupBy(
        F.pmod(F.xxhash64("id"), "parts").alias("part")
    ).count()
    assert dealt.agg(F.max("count")).first()[0] < 200


def test_neighbours_across_runs(spark, many_runs):
    df = skewed(spark)
    runs = ordered.in_runs(df, ["k"], ["t", "id"])
    assert runs.select(ordered.RUN).distinct().count() > 1
    con = duckdb.connect()
    con.register("rows_", df.toPandas().astype({"k": "Int64"}))
    for step, function in ((-1, "lag"), (1, "lead")):
        ours = ordered.neighbour(runs, ["k"], ["t", "id"], ["t"], step)
        ours = sorted((r["id"], r["near_t"]) for r in ours.collect())
        theirs = con.execute(
            f"SELECT id, {function}(t) OVER (PARTITION BY k ORDER BY t, id) FROM rows_ ORDER BY id").fetchall()
        assert ours == theirs


def test_running_totals_across_runs(spark, many_runs):
    df = skewed(spark)
    runs = ordered.in_runs(df, ["k"], ["t", "id"])
    ours = ordered.running_totals(runs, ["k"], ["t", "id"], {"total": F.col("t")})
    con = duckdb.connect()
    con.register("rows_", df.toPandas().astype({"k": "Int64"}))
    theirs = con.execute("""SELECT id, sum(t) OVER (PARTITION BY k ORDER BY t, id ROWS UNBOUNDED PRECEDING)::BIGINT,
                                   sum(t) OVER (PARTITION BY k)::BIGINT FROM rows_ ORDER BY id""").fetchall()
    assert sorted((r["id"], r["total"], r["all_total"]) for r in ours.collect()) == theirs


def test_numbering_without_groups(spark, many_runs):
    found = ordered.numbered(skewed(spark, 100), [], ["t", "id"]).orderBy("t", "id").collect()
    assert [r["position"] for r in found] == list(range(1, 101))
    assert {r["all_position"] for r in found} == {100}


def test_ordered_work_on_no_rows(spark):
    empty = skewed(spark).filter("id < 0")
    assert ordered.numbered(empty, ["k"], ["t", "id"]).count() == 0


def test_top_per_key_is_cut_before_the_shuffle(spark, small):
    df = recent_loans(small.loan_applications)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_per_key_keeps_rank(spark):
    found = top_per_key(skewed(spark), ["k"], [F.col("id")], 2, rank="place").filter("k = 1").collect()
    assert sorted((r["place"], r["id"]) for r in found) == [(1, 0), (2, 3)]


@given(st.lists(st.booleans(), min_size=1, max_size=60), st.sampled_from([0.1, 0.2, 0.5]))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_split_shares_are_exact(spark, labels, share):
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "id bigint, label int")
    found = stratified_split(df, "label", "id", share).groupBy("label").agg(
        F.count_if(F.col("split") == "test").alias("test"), F.count(F.lit(1)).alias("n"))
    for row in found.collect():
        assert row["test"] == int(row["n"] * share + 0.5)


def test_split_keeps_copies_together(spark):
    df = spark.range(300).select(F.expr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END").alias("id"), F.lit(1).alias("label"))
    found = stratified_split(df, "label", "id")
    assert found.count() == 300
    assert found.filter("id = 5").select("split").distinct().count() == 1


def test_potential_loss_with_a_hot_customer(spark):
    """Many loans and scores of one customer: the pruned pairs equal the best of all pairs."""
    loans = spark.range(400).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 9 END AS customer_id", "id AS loan_id",
        "CAST(60000 + id * 37 % 50 * 1000 AS DOUBLE) AS loan_amount")
    scores = spark.range(400).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 9 END AS customer_id", "id AS prediction_id",
        "CAST(id % 10 AS DOUBLE) / 10 AS default_probability", "CAST(id % 101 AS DOUBLE) AS risk_score",
        "'High' AS risk_category", "TIMESTAMP_NTZ'2001-08-01 00:00:00' AS prediction_date")
    people = spark.range(9).selectExpr("id AS customer_id", "1.0D AS annual_income")
    credit = spark.range(30).selectExpr("id % 9 AS customer_id", "id AS credit_id", "700 AS credit_score")
    import datetime as dt
    found = potential_loss(people, credit, loans, scores, dt.date(2001, 8, 2), limit=40).collect()
    con = duckdb.connect()
    for name, df in (("loans", loans), ("scores", scores), ("credit", credit)):
        con.register(name, df.toPandas())
    best = con.execute("""
        SELECT l.loan_id, s.prediction_id, loan_amount * default_probability FROM loans l
        JOIN scores s USING (customer_id) JOIN credit c USING (customer_id)
        ORDER BY 3 DESC, loan_amount DESC, default_probability DESC, customer_id, loan_id, prediction_id, credit_id
        LIMIT 40""").fetchall()
    assert [(r["loan_id"], r["prediction_id"], r["potential_loss"]) for r in found] == best


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get(CHECKPOINT_CONF)
    assert spark.sparkContext.getCheckpointDir() is not None
