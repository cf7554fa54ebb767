"""All table queries on tables where one customer holds a third of everything, and on tables with repeated ids.

The tables also hold null and unknown customers, several credit records per customer
and gaps in the measured columns. DuckDB joins them in full.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from checks import oracles
from checks.compare import canonical
from lendwell.operators import skew
from lendwell.sources.adapter import LendingTables

OWNER = "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 41 = 1 THEN NULL WHEN id % 43 = 1 THEN 9000 ELSE id % 150 END"
TABLES = {
    "customers": (150, """
        id AS customer_id, CAST(18 + id * 37 % 63 AS INT) AS age,
        CASE id % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'X' END AS gender, 'Single' AS marital_status,
        'PhD' AS education_level,
        CASE id % 4 WHEN 0 THEN 'Employed' WHEN 1 THEN 'Self-Employed' WHEN 2 THEN 'Unemployed' END AS employment_status,
        CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN 0.0 ELSE CAST(id * 977 % 120000 AS DOUBLE) END AS annual_income,
        CAST(id * 11 % 30 AS INT) AS years_employed,
        CASE id % 3 WHEN 0 THEN 'Own' WHEN 1 THEN 'Rent' ELSE 'Mortgage' END AS home_ownership,
        CAST(id % 5 AS INT) AS num_dependents, TIMESTAMP_NTZ'2001-07-30 12:00:00' AS created_at"""),
    "credit_history": (180, f"""
        id AS credit_id, CAST({OWNER} AS BIGINT) AS customer_id,
        CASE WHEN id % 17 = 0 THEN NULL ELSE CAST(300 + id % 5 * 130 AS INT) END AS credit_score,
        CAST(1 + id % 14 AS INT) AS num_credit_accounts, CAST(id % 2 * 60 + 10 AS DOUBLE) / 100 AS credit_utilization_ratio,
        CAST(id % 3 AS INT) AS num_delinquent_accounts, CAST(id % 4 * 1000 AS DOUBLE) AS total_debt,
        (id % 5 = 2) AS bankruptcy_flag, CAST(id * 17 % 25 AS INT) AS years_credit_history,
        CAST('2001-07-' || lpad(CAST(1 + id % 28 AS STRING), 2, '0') || ' 00:00:00' AS TIMESTAMP_NTZ) AS created_at"""),
    "transactions": (360, f"""
        id AS transaction_id, CAST({OWNER} AS BIGINT) AS customer_id, DATE'2001-07-01' AS transaction_date,
        CASE WHEN id % 19 = 0 THEN NULL ELSE CAST(id * 31 % 997 AS DOUBLE) / 4 END AS transaction_amount,
        CASE WHEN id % 2 = 0 THEN 'Debit' ELSE 'Credit' END AS transaction_type, 'Other' AS category,
        TIMESTAMP_NTZ'2001-07-20 08:00:00' AS created_at"""),
    "loan_applications": (360, f"""
        id AS loan_id, CAST({OWNER} AS BIGINT) AS customer_id,
        date_add(DATE'2001-08-01', CAST(-(id * 13 % 900) AS INT)) AS application_date,
        CASE WHEN id % 23 = 0 THEN NULL ELSE CAST(id * 7919 % 400000 AS DOUBLE) + 1000 END AS loan_amount,
        CASE id % 3 WHEN 0 THEN 'Home' WHEN 1 THEN 'Auto' END AS loan_purpose,
        CAST(12 * (1 + id % 6) AS INT) AS loan_term_months,
        CASE WHEN id % 29 = 0 THEN NULL ELSE CAST(id % 20 AS DOUBLE) / 100 END AS interest_rate,
        CAST(id * 29 % 100 AS DOUBLE) / 100 AS debt_to_income_ratio,
        CASE WHEN id % 31 = 30 THEN NULL ELSE id % 4 = 1 END AS default_flag, CAST(id % 90 AS INT) AS days_past_due,
        TIMESTAMP_NTZ'2001-07-31 00:00:00' AS created_at"""),
    "risk_scores": (360, f"""
        id AS prediction_id, CAST({OWNER} AS BIGINT) AS customer_id, id AS loan_id,
        CASE WHEN id % 37 = 0 THEN NULL ELSE CAST(id * 7919 % 1001 AS DOUBLE) / 10 END AS risk_score,
        CASE WHEN id * 7919 % 1001 < 300 THEN 'Low' WHEN id * 7919 % 1001 < 600 THEN 'Medium' ELSE 'High' END AS risk_category,
        CASE WHEN id % 37 = 0 THEN NULL ELSE CAST(id * 7919 % 1001 AS DOUBLE) / 1000 END AS default_probability,
        'v' || CAST(id % 3 AS STRING) AS model_version,
        CAST(date_add(DATE'2001-08-01', CAST(-(id % 9 * (id % 12)) AS INT)) AS TIMESTAMP_NTZ) AS prediction_date"""),
}
# Outcomes or scores that are unknown have no place in a curve.
KNOWN_ONLY = {"ml_stratified_split"} | {n for n in oracles.BODIES if n.startswith("ev_")} | {
    "rq_model_metrics", "latest_model_metrics", "daily_run_summary", "performance_drop_alerts", "dash_score_histogram",
    "score_categorize", "unscored_customers",
}
NAMES = sorted(set(entry.TABLE_QUERIES) & set(oracles.BODIES) - KNOWN_ONLY)
SQL = oracles.oracle_sql(given=tuple(TABLES))


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    frames = {}
    for name, (rows, columns) in TABLES.items():
        path = f"{folder}/{name}"
        spark.range(rows).createOrReplaceTempView("ids")
        spark.sql(f"SELECT {columns} FROM ids").write.parquet(path)
        frames[name] = spark.read.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return LendingTables(**frames), con


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Loans, transactions, credit records and customers of which some occur twice."""
    folder = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    frames = {}
    for name, (rows, columns) in TABLES.items():
        path = f"{folder}/{name}"
        again = "id % 4 = 0" if name != "risk_scores" else "false"
        spark.range(rows).createOrReplaceTempView("ids")
        spark.sql(f"SELECT {columns} FROM ids UNION ALL SELECT {columns} FROM ids WHERE {again}").write.parquet(path)
        frames[name] = spark.read.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return LendingTables(**frames), con


@pytest.mark.parametrize("name", ["rq_default_by_score", "rq_segments"])
def test_ids_that_repeat_count_once(repeated, name):
    tables, con = repeated
    df = entry.TABLE_QUERIES[name](tables)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, cursor.fetchall())


def test_profile_counts_ids_once(repeated):
    tables, con = repeated
    found = entry.TABLE_QUERIES["fq_customer_profile"](tables).select(
        "customer_id", "total_transactions", "total_loans").distinct().collect()
    want = con.execute("""
        SELECT c.customer_id, (SELECT count(DISTINCT transaction_id) FROM transactions t WHERE t.customer_id = c.customer_id),
               (SELECT count(DISTINCT loan_id) FROM loan_applications l WHERE l.customer_id = c.customer_id)
        FROM (SELECT DISTINCT customer_id FROM customers) c""").fetchall()
    assert sorted(map(tuple, found)) == sorted(want)


@pytest.mark.parametrize("name", NAMES)
def test_equal_under_skew(spark, skewed, many_runs, monkeypatch, name):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 25)
    tables, con = skewed
    df = entry.TABLE_QUERIES[name](tables)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, cursor.fetchall())


# Plans that the registered queries run over the stored feature table.
OVER_STORED = {
    "fq_high_risk_customers": lambda f, t: entry.rounded(
        entry.fq.high_risk_customers(f, t.risk_scores, entry.AS_OF), {"delinquency_score": 6}),
    "rq_risk_factors": lambda f, t: entry.rq.risk_factors(f, t.credit_history, t.risk_scores, entry.AS_OF),
}


@pytest.mark.parametrize("name", sorted(OVER_STORED))
def test_stored_features_under_skew(spark, skewed, many_runs, monkeypatch, tmp_path, name):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 25)
    tables, con = skewed
    path = str(tmp_path / "features")
    entry.tables.store_features(entry.wide_features(tables), path, entry.AS_OF)
    assert entry.tables.stored.layout_of(spark, path).hot
    features = entry.feat.feature_store(entry.tables.read_features(spark, path, by_customer=True))
    df = OVER_STORED[name](features, tables)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, cursor.fetchall())
