"""Checks from stored counts of deliveries equal checks over all rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lendwell import schemas
from lendwell.operators import check_state as cs, quality
from lendwell.plans import jobs
from lendwell.sources import stored, tables

DAY = dt.date(2001, 8, 1)


def deliveries(small, parts=3):
    """All rows of the four tables, dealt over some deliveries; credit records repeat, customers are missing."""
    frames = dict(zip(cs.TABLES, small.staging))
    frames["credit_history"] = frames["credit_history"].union(frames["credit_history"].limit(20))
    frames["customers"] = frames["customers"].filter("customer_id % 40 <> 7")
    return [{n: df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(parts)) == i) for n, df in frames.items()} for i in range(parts)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def whole(parts):
    return quality.suite(*[parts[0][n].union(parts[1][n]).union(parts[2][n]) for n in cs.TABLES], threshold=0.01)


def test_state_equals_a_scan(spark, small, tmp_path):
    parts, path = deliveries(small), str(tmp_path / "state")
    for number, part in enumerate(parts):
        cs.record(part, path, DAY + dt.timedelta(days=number))
    want = rows(whole(parts))
    assert rows(cs.suite_from_state(spark, path, threshold=0.01)) == want and len(want) == 13
    assert any(r[2] == "fail" for r in want) and any(r[2] == "warning" for r in want)
    assert rows(cs.suite_from_state(spark, path, 0.01, strict=True)) == rows(
        quality.suite(*[parts[0][n].union(parts[1][n]).union(parts[2][n]) for n in cs.TABLES], threshold=0.01, strict=True))
    newest = {r["table_name"]: (r["newest"], r["total"]) for r in cs.newest_from_state(spark, path).collect()}
    for n in cs.TABLES:
        both = parts[0][n].union(parts[1][n]).union(parts[2][n])
        assert newest[n] == both.agg(F.max("created_at"), F.count(F.lit(1))).first()


def test_a_repeated_delivery_replaces_itself(spark, small, tmp_path):
    parts, path = deliveries(small), str(tmp_path / "state")
    cs.record(parts[0], path, DAY)
    cs.record(parts[2], path, DAY + dt.timedelta(days=1))  # wrong rows at first
    cs.record(parts[1], path, DAY + dt.timedelta(days=1))
    cs.record(parts[2], path, DAY + dt.timedelta(days=2))
    assert rows(cs.suite_from_state(spark, path, threshold=0.01)) == rows(whole(parts))
    assert len(stored.days(spark, f"{path}/rows")) == 3


def test_a_run_reads_no_earlier_rows(spark, small, tmp_path):
    """The rows of a delivery may be gone when the next one is checked."""
    state = str(tmp_path / "state")
    frames = dict(zip(schemas.STAGING, small.staging))
    frames["credit_history"] = frames["credit_history"].filter("customer_id IS NOT NULL")
    total = None
    for number in range(2):
        root = str(tmp_path / f"staging-{number}")
        tables.overwrite_staging({n: df.filter(F.col("customer_id") % 2 == number) for n, df in frames.items()}, root)
        total = jobs.check_delivery(spark, root, state, DAY + dt.timedelta(days=number))
    assert total["failures"] == 0 and total["total_checks"] == 13
    again = str(tmp_path / "staging-again")
    tables.overwrite_staging({n: df.filter("customer_id = 4") for n, df in frames.items()}, again)
    with pytest.raises(quality.DataQualityError):  # customer 4 came before
        jobs.check_delivery(spark, again, state, DAY + dt.timedelta(days=5))
    newest = cs.newest_from_state(spark, state).filter("table_name = 'customers'").first()
    assert newest["total"] == frames["customers"].count() + 1
