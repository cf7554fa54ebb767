"""Data-quality checks on small frames with known faults."""

import datetime as dt

import pytest

from lendwell.operators import quality


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, 17, 100.0, None), (1, 101, 0.0, None), (2, 18, -1.0, "a"), (None, 30, None, "b"), (None, 40, 5.0, "b")]
    return spark.createDataFrame(rows, "customer_id bigint, age int, annual_income double, note string")


def test_missing_values_levels(people):
    found = {r["column_name"]: (r["missing_rows"], r["level"]) for r in quality.missing_values(people, "p", 0.3).collect()}
    assert found == {"customer_id": (2, "error"), "annual_income": (1, "warning"), "note": (2, "error")}


def test_missing_values_check_never_fails_unless_strict(people):
    assert only(quality.check_missing_values(people, "p", 0.3))["status"] == "warning"
    assert only(quality.check_missing_values(people, "p", 0.3, strict=True))["status"] == "fail"
    complete = people.select("age")
    row = only(quality.check_missing_values(complete, "p"))
    assert (row["status"], row["messages"]) == ("pass", "")


def test_duplicates_count_all_rows_and_equal_nulls(people, spark):
    row = only(quality.duplicates(people, "p", ["customer_id"]))
    assert (row["status"], row["bad"], row["messages"]) == ("fail", 4, "p has 4 duplicate records")
    assert only(quality.duplicates(spark.range(5), "p", ["id"]))["status"] == "pass"
    assert only(quality.duplicates(spark.range(0), "p", ["id"]))["bad"] == 0


def test_ranges_are_strict_and_skip_nulls(people):
    row = only(quality.check_value_ranges(people, "p", {"age": {"min": 18, "max": 100}, "annual_income": {"min": 0},
                                                        "absent": {"min": 0}}))
    assert row["status"] == "warning"
    assert row["messages"] == ("1 age values above maximum 100; 1 age values below minimum 18; "
                               "1 annual_income values below minimum 0")


def test_business_rules(people):
    row = only(quality.check_business_rules(people, "customers"))
    assert row["messages"] == "2 customers with invalid age; 2 customers with non-positive income"
    assert only(quality.check_business_rules(people, "transactions"))["status"] == "pass"


def test_data_types(people):
    row = only(quality.data_types(people, "p", {"age": "bigint", "note": "string", "absent": "int"}))
    assert (row["status"], row["messages"]) == ("warning", "p.age: expected bigint, got int")


def test_orphans_count_keys_once_and_null_once(spark, people):
    child = spark.createDataFrame([(1,), (9,), (9,), (None,), (None,)], "k bigint")
    parent = people.filter("customer_id IS NOT NULL")
    assert only(quality.referential_integrity(parent, child, "customer_id", "k", "a -> b"))["bad"] == 2
    assert only(quality.referential_integrity(people, child, "customer_id", "k", "a -> b"))["bad"] == 1


def test_anomalies_need_more_than_five_percent(spark):
    rows = [(float(v),) for v in [0.0] * 14 + [1000.0]]
    df = spark.createDataFrame(rows, "v double")
    found = only(quality.outlier_counts(df, "t", ["v", "absent"]))
    assert found["bad_rows"] == 1
    assert only(quality.check_anomalies(df, "t", ["v"]))["messages"] == "v: 1 outliers (6.67%)"
    many = spark.createDataFrame([(0.0,)] * 30 + [(1000.0,)], "v double")
    assert only(quality.check_anomalies(many, "t", ["v"]))["status"] == "pass"
    constant = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert only(quality.check_anomalies(constant, "t", ["v"]))["status"] == "pass"


def test_freshness_counts_whole_days(spark):
    day = dt.date(2024, 1, 10)
    df = spark.createDataFrame([("2024-01-02 12:00:00",), ("2024-01-01 00:00:00",), ("nonsense",)], "at string")
    assert only(quality.freshness(df, "t", "at", day))["age_days"] == 7
    assert only(quality.check_freshness(df, "t", "at", day, 6))["messages"] == "t: Data is 7 days old (threshold: 6)"
    assert only(quality.freshness(df, "t", "absent", day))["status"] == "pass"


def test_gate(people, spark):
    bad = quality.duplicates(people, "p", ["customer_id"])
    with pytest.raises(quality.DataQualityError, match="1 failures"):
        quality.gate(bad)
    good = quality.duplicates(spark.range(3), "p", ["id"])
    assert quality.gate(good)["success_rate"] == "100.00%"
    assert only(quality.summary(good.limit(0)))["success_rate"] == "0%"


def test_suite_has_thirteen_checks(small):
    checks = quality.suite(*small.staging)
    assert checks.count() == 13
    assert checks.filter("check = 'missing_values'").count() == 3


def test_impute(people):
    found = quality.impute(people, ["annual_income"], ["note"]).collect()
    assert [r["note"] for r in found].count("b") == 4
    assert sum(r["annual_income"] == 26.0 for r in found) == 1
