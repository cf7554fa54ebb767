"""Edge values of features, bins and scores on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from lendwell.functions import credit as fx
from lendwell.functions.columns import at_least, clamp, flag, ratio, rounded
from lendwell.schemas import conform

c = F.col


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    "income, feature, table",
    [(0.0, "Low", None), (30000.0, "Low", "Low"), (30000.01, "Medium", "Medium"),
     (100000.0, "High", "High"), (1e9, "Very High", "Very High"), (-5.0, None, None), (None, None, None)],
)
def test_income_bins(spark, income, feature, table):
    row = spark.createDataFrame([(income,)], "i double").select(
        fx.income_category(c("i"), include_lowest=True), fx.income_category(c("i"))
    ).first()
    assert tuple(row) == (feature, table)


def test_age_bins(spark):
    found = values(spark, fx.binned()["age_group"], [(0, 0, 0.0), (30, 0, 0.0), (31, 0, 0.0), (101, 0, 0.0)],
                   "age int, credit_score int, loan_amount double")
    assert found == [None, "18-30", "31-40", None]


def test_payment(spark):
    found = values(spark, fx.monthly_payment(c("p"), c("r"), c("m")),
                   [(1200.0, 0.0, 12), (50000.0, 0.08, 36), (1200.0, 0.1, 0), (None, 0.1, 12)],
                   "p double, r double, m int")
    assert found[0] == 100.0
    r = 0.08 / 12
    assert math.isclose(found[1], 50000 * r * (1 + r) ** 36 / ((1 + r) ** 36 - 1))
    assert found[2:] == [None, None]


def test_request_dti_without_income(spark):
    found = values(spark, fx.request_debt_to_income(c("p"), c("r"), c("m"), c("i")),
                   [(1200.0, 0.0, 12, 0.0), (1200.0, 0.0, 12, None), (1200.0, 0.0, 12, 2400.0)],
                   "p double, r double, m int, i double")
    assert found == [0.0, 0.0, 0.5]


def test_stability(spark):
    row = spark.createDataFrame([(0, 5)], "a int, y int").select(
        fx.employment_stability(c("a"), c("y")), fx.employment_stability(c("a"), c("y"), guarded=False)
    ).first()
    assert tuple(row) == (500.0, None)


def test_payment_consistency(spark):
    rows = [(None, None, None), (3, 0.0, 1.0), (1, 20.0, None), (4, 10.0, 10.0), (4, 10.0, 90.0), (4, -10.0, 5.0)]
    found = values(spark, fx.payment_consistency(c("n"), c("m"), c("s")), rows, "n bigint, m double, s double")
    assert found == [50.0, 50.0, 100.0, 50.0, 0.0, 100.0]


def test_utilization_category(spark):
    found = values(spark, fx.utilization_category(c("u")), [(0.29,), (0.3,), (0.5,), (0.7,), (None,)], "u double")
    assert found == ["Excellent", "Good", "Fair", "Poor", "Unknown"]


def test_flags_on_nulls(spark):
    schema = ("debt_to_income_ratio double, credit_score int, credit_utilization_ratio double, "
              "num_delinquent_accounts int, employment_status string")
    rows = [(None,) * 5, (0.5, 600, 0.8, 1, "Unemployed"), (0.43, 650, 0.7, 0, "Employed")]
    flags = fx.risk_flags()
    found = spark.createDataFrame(rows, schema).select([v.alias(k) for k, v in flags.items()]).collect()
    assert [r["multiple_risk_factors"] for r in found] == [0, 4, 0]
    assert [r["unemployed_flag"] for r in found] == [0, 1, 0]


def test_risk_categories(spark):
    rows = [(0.0,), (30.0,), (60.0,), (100.0,), (None,)]
    assert values(spark, fx.risk_category(c("s")), rows, "s double") == ["Low", "Medium", "High", "High", None]
    assert values(spark, fx.risk_category_right_closed(c("s")), rows, "s double") == [None, "Low", "Medium", "High", None]
    assert values(spark, fx.recommendation(c("s")), rows, "s double")[1] == "Review - Manual underwriting recommended"


def test_scorecard_cap(spark):
    schema = "s int, d double, e string, n int"
    rows = [(500, 0.5, "Unemployed", 3), (None, None, None, None), (699, 0.4, "Employed", 0)]
    found = values(spark, fx.rule_scorecard(c("s"), c("d"), c("e"), c("n")), rows, schema)
    assert [round(v, 10) for v in found] == [0.9, 0.05, 0.3]


def test_rate_tier(spark):
    tiers = fx.rate_tier(c("s"))
    df = spark.createDataFrame([(750,), (700,), (650,), (649,), (None,)], "s int")
    found = [tuple(r) for r in df.select(tiers["rate_low"], tiers["rate_high"], tiers["rate_mid"]).collect()]
    assert found == [(0.03, 0.06, 0.045), (0.06, 0.1, 0.08), (0.1, 0.15, 0.125), (0.15, 0.25, 0.2), (0.15, 0.25, 0.2)]


def test_request_codes(spark):
    codes = fx.request_encodings()
    df = spark.createDataFrame([("Unemployed", "Mortgage"), ("Retired", None)],
                               "employment_status string, home_ownership string")
    assert [tuple(r) for r in df.select(*codes.values()).collect()] == [(2, 2), (0, 0)]


def test_null_safe_helpers(spark):
    row = spark.createDataFrame([(None, 0.0, 5.0)], "n double, z double, v double").select(
        at_least(c("n"), 1), clamp(c("n"), 0, 1), clamp(c("v"), 0, 1), flag(c("n") > 1), ratio(c("v"), c("z"))
    ).first()
    assert tuple(row) == (None, None, 1.0, 0, None)


def test_rounding_sees_halves_through_noise(spark):
    rows = [(0.23425,), (0.23424999999999999,), (1.005,), (-2.5,)]
    assert values(spark, rounded(c("x"), 4), rows[:2], "x double") == [0.2343, 0.2343]
    assert values(spark, rounded(c("x"), 2), rows[2:], "x double") == [1.01, -2.5]


def test_conform_turns_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"), "7")], "b double, a string")
    out = conform(df, "a bigint, b double, d date")
    assert out.dtypes == [("a", "bigint"), ("b", "double"), ("d", "date")]
    assert tuple(out.first()) == (7, None, None)
