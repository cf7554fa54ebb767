"""One DuckDB statement per registered query, written independently of the Spark plans.

Where the Spark plan sums per customer before joining, the statement here joins the
tables in full, so that agreement also proves the rewrite.
"""

from __future__ import annotations

from lendwell.sources.adapter import VIEWS, duckdb_view

AS_OF = "DATE '2001-08-02'"

PRELUDE = {
    **{name: duckdb_view(name) for name in VIEWS},
    "spending": """
        SELECT customer_id, avg(transaction_amount) AS avg_monthly_spending,
               stddev_samp(transaction_amount) AS spending_volatility,
               coalesce(sum(transaction_amount), 0) AS total_spending, count(transaction_id) AS transaction_count
        FROM transactions WHERE customer_id IS NOT NULL GROUP BY customer_id""",
    "newest_credit": """
        SELECT * FROM credit_history WHERE customer_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC NULLS LAST, credit_id) = 1""",
    "features": """
        SELECT l.*, c.age, c.gender, c.marital_status, c.education_level, c.employment_status,
               c.annual_income, c.years_employed, c.home_ownership, c.num_dependents,
               h.credit_id, h.credit_score, h.num_credit_accounts, h.credit_utilization_ratio,
               h.num_delinquent_accounts, h.total_debt, h.bankruptcy_flag, h.years_credit_history,
               s.avg_monthly_spending, s.spending_volatility, s.total_spending, s.transaction_count,
               CASE WHEN annual_income > 0 AND annual_income <= 30000 THEN 'Low'
                    WHEN annual_income > 30000 AND annual_income <= 60000 THEN 'Medium'
                    WHEN annual_income > 60000 AND annual_income <= 100000 THEN 'High'
                    WHEN annual_income > 100000 THEN 'Very High' END AS income_category,
               years_employed / nullif(age, 0) * 100 AS employment_stability_score,
               num_delinquent_accounts * 20 + (1 - credit_utilization_ratio) * 30 AS delinquency_score,
               loan_amount / nullif(annual_income, 0) AS loan_to_income_ratio
        FROM loan_applications l
        LEFT JOIN customers c ON l.customer_id = c.customer_id
        LEFT JOIN newest_credit h ON l.customer_id = h.customer_id
        LEFT JOIN spending s ON l.customer_id = s.customer_id""",
    "risk_features": """
        SELECT customer_id, loan_id, credit_score, credit_utilization_ratio AS credit_utilization,
               delinquency_score, debt_to_income_ratio AS debt_to_income, loan_to_income_ratio
        FROM features""",
    "rate": """
        SELECT credit_id, credit_score,
               CASE WHEN credit_score >= 750 THEN 0.03 WHEN credit_score >= 700 THEN 0.06
                    WHEN credit_score >= 650 THEN 0.10 ELSE 0.15 END::DOUBLE AS rate_low,
               CASE WHEN credit_score >= 750 THEN 0.06 WHEN credit_score >= 700 THEN 0.10
                    WHEN credit_score >= 650 THEN 0.15 ELSE 0.25 END::DOUBLE AS rate_high,
               CASE WHEN credit_score >= 750 THEN 0.045 WHEN credit_score >= 700 THEN 0.08
                    WHEN credit_score >= 650 THEN 0.125 ELSE 0.2 END::DOUBLE AS rate_mid
        FROM credit_history""",
    "scorecard": """
        SELECT loan_id, default_flag,
               least(0.05::DOUBLE
                     + CASE WHEN credit_score < 600 THEN 0.3 WHEN credit_score < 700 THEN 0.15 ELSE 0 END::DOUBLE
                     + CASE WHEN debt_to_income_ratio > 0.43 THEN 0.2
                            WHEN debt_to_income_ratio > 0.35 THEN 0.1 ELSE 0 END::DOUBLE
                     + CASE WHEN employment_status = 'Unemployed' THEN 0.25 ELSE 0 END::DOUBLE
                     + coalesce(num_delinquent_accounts, 0) * 0.1::DOUBLE, 0.9::DOUBLE) AS rule_probability
        FROM features""",
    # Probabilities are compared after rounding to 6 digits in both engines.
    "scored": """
        SELECT 'stored_score' AS model_name, l.default_flag::INT AS label,
               s.default_probability AS probability
        FROM risk_scores s JOIN loan_applications l ON s.loan_id = l.loan_id
        UNION ALL
        SELECT 'rule_scorecard', default_flag::INT, round(rule_probability, 6) FROM scorecard""",
    "by_version": """
        SELECT s.model_version AS model_name, l.default_flag::INT AS label,
               s.default_probability AS probability, s.prediction_date
        FROM risk_scores s JOIN loan_applications l ON s.loan_id = l.loan_id""",
}


def curve(source: str) -> str:
    return f"""
        SELECT model_name, threshold, pos, neg,
               sum(pos) OVER w AS tps, sum(neg) OVER w AS fps,
               sum(pos) OVER (PARTITION BY model_name) AS p, sum(neg) OVER (PARTITION BY model_name) AS n,
               lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS place
        FROM (SELECT model_name, probability AS threshold, count(*) FILTER (label = 1) AS pos,
                     count(*) FILTER (label = 0) AS neg FROM {source} GROUP BY ALL)
        WINDOW w AS (PARTITION BY model_name ORDER BY threshold DESC)"""


def report(source: str) -> str:
    return f"""
        SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
               coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
               coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
               coalesce(2 * (coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0))
                 / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0) AS f1_score,
               coalesce(tn / nullif(tn + fp, 0), 0) AS specificity
        FROM (SELECT model_name, count(*) FILTER (label = 1 AND probability > 0.5) AS tp,
                     count(*) FILTER (label = 0 AND probability > 0.5) AS fp,
                     count(*) FILTER (label = 1 AND probability <= 0.5) AS fn,
                     count(*) FILTER (label = 0 AND probability <= 0.5) AS tn
              FROM {source} GROUP BY model_name)
        JOIN (SELECT model_name, sum((tps - pos / 2) * neg) / nullif(max(p) * max(n), 0) AS auc_roc,
                     sum(pos * tps / (tps + fps)) / nullif(max(p), 0) AS average_precision
              FROM ({curve(source)}) GROUP BY model_name) USING (model_name)"""


PRELUDE["metadata"] = f"""
    SELECT CAST(year(training_date) * 100 + month(training_date) AS INT) AS model_id,
           'Risk Prediction Model' AS model_name, model_name AS model_version,
           'RandomForestClassifier' AS algorithm, accuracy, precision AS precision_score, recall,
           f1_score, auc_roc, training_date
    FROM ({report('by_version')})
    JOIN (SELECT model_name, date_trunc('month', min(prediction_date))::TIMESTAMP AS training_date
          FROM by_version GROUP BY model_name) USING (model_name)"""


def with_tables(body: str, given: tuple[str, ...] = ()) -> str:
    """Put the table definitions before a statement, but for those that exist already."""
    tables = ", ".join(f"{name} AS ({sql})" for name, sql in PRELUDE.items() if name not in given)
    return f"WITH {tables} {body}"


def missing(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_rows, "
        f"count(*) AS total_rows FROM {table}"
        for c in VIEWS[table][1]
    )


def missing_check(table: str, threshold: float) -> str:
    return f"""
        SELECT 'missing_values' AS "check", '{table}' AS subject,
               CASE WHEN count(*) > 0 THEN 'warning' ELSE 'pass' END AS status, count(*) AS bad,
               coalesce(string_agg(text, '; ' ORDER BY text), '') AS messages
        FROM (SELECT format('{{}} has {{:.2f}}% missing values', column_name, missing_rows / total_rows * 100)
                     || CASE WHEN missing_rows / total_rows > {threshold} THEN ' (threshold: {threshold:.2%})' ELSE '' END AS text
              FROM ({missing(table)}) WHERE missing_rows > 0)"""


def rule_rows(table: str, rules: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS total_rows, '{name}' AS rule, "
        f"count(*) FILTER ({bad}) AS bad_rows, '{text}' AS text FROM {table}"
        for name, (bad, text) in rules.items()
    )


def rule_check(check: str, table: str, rules: dict[str, tuple[str, str]]) -> str:
    return f"""
        SELECT '{check}' AS "check", '{table}' AS subject,
               CASE WHEN count(*) > 0 THEN 'warning' ELSE 'pass' END AS status, count(*) AS bad,
               coalesce(string_agg(msg, '; ' ORDER BY msg), '') AS messages
        FROM (SELECT bad_rows || ' ' || text AS msg FROM ({rule_rows(table, rules)}) WHERE bad_rows > 0)"""


RANGES = {
    "customers": {
        "age_min": ("age < 18", "age values below minimum 18"),
        "age_max": ("age > 100", "age values above maximum 100"),
        "annual_income_min": ("annual_income < 0", "annual_income values below minimum 0"),
    },
    "credit_history": {
        "credit_score_min": ("credit_score < 300", "credit_score values below minimum 300"),
        "credit_score_max": ("credit_score > 850", "credit_score values above maximum 850"),
        "credit_utilization_ratio_min": (
            "credit_utilization_ratio < 0", "credit_utilization_ratio values below minimum 0"),
        "credit_utilization_ratio_max": (
            "credit_utilization_ratio > 1", "credit_utilization_ratio values above maximum 1"),
    },
}
RANGES["dirty_customers"] = RANGES["customers"]
RULES = {
    "customers": {
        "age": ("age < 18 OR age > 100", "customers with invalid age"),
        "annual_income": ("annual_income <= 0", "customers with non-positive income"),
    },
    "credit_history": {
        "credit_score": ("credit_score NOT BETWEEN 300 AND 850", "records with invalid credit score"),
        "credit_utilization_ratio": (
            "credit_utilization_ratio NOT BETWEEN 0 AND 1", "records with invalid credit utilization"),
    },
    "loan_applications": {
        "loan_amount": ("loan_amount <= 0", "loans with non-positive amount"),
        "interest_rate": ("interest_rate <= 0 OR interest_rate > 0.5", "loans with invalid interest rate"),
    },
}
RULES["dirty_customers"] = RULES["customers"]


def duplicate_check(table: str, key: str) -> str:
    return f"""
        SELECT 'duplicates' AS "check", '{table}' AS subject,
               CASE WHEN bad > 0 THEN 'fail' ELSE 'pass' END AS status, bad,
               CASE WHEN bad > 0 THEN '{table} has ' || bad || ' duplicate records' ELSE '' END AS messages
        FROM (SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS bad
              FROM (SELECT count(*) AS n FROM {table} GROUP BY {key}))"""


def orphan_check(child: str, relation: str) -> str:
    return f"""
        SELECT 'referential_integrity' AS "check", '{relation}' AS subject,
               CASE WHEN bad > 0 THEN 'fail' ELSE 'pass' END AS status, bad,
               CASE WHEN bad > 0 THEN '{relation}: ' || bad || ' orphaned records found' ELSE '' END AS messages
        FROM (SELECT count(*) AS bad FROM (SELECT customer_id FROM {child} EXCEPT SELECT customer_id FROM customers))"""


SUITE = " UNION ALL ".join(
    [
        missing_check("customers", 0.1),
        duplicate_check("customers", "customer_id"),
        rule_check("value_ranges", "customers", RANGES["customers"]),
        rule_check("business_rules", "customers", RULES["customers"]),
        missing_check("credit_history", 0.1),
        duplicate_check("credit_history", "customer_id"),
        rule_check("value_ranges", "credit_history", RANGES["credit_history"]),
        rule_check("business_rules", "credit_history", RULES["credit_history"]),
        orphan_check("credit_history", "customers -> credit_history"),
        orphan_check("transactions", "customers -> transactions"),
        orphan_check("loan_applications", "customers -> loans"),
        missing_check("loan_applications", 0.1),
        rule_check("business_rules", "loan_applications", RULES["loan_applications"]),
    ]
)
SUMMARY = f"""
    SELECT count(*) AS total_checks, count(*) FILTER (status = 'pass') AS passed,
           count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'fail') AS failures,
           format('{{:.2f}}%', count(*) FILTER (status = 'pass') / count(*) * 100) AS success_rate
    FROM ({SUITE})"""


def domain(column: str, values: str) -> dict[str, tuple[str, str]]:
    return {f"{column}_domain": (f"{column} NOT IN ({values})", "unknown values")}


def absent(column: str) -> dict[str, tuple[str, str]]:
    return {f"{column}_missing": (f"{column} IS NULL", "missing values")}


DOCUMENTED = {
    "customers": {
        **absent("customer_id"),
        "years_employed": ("years_employed > age - 18", "employed before 18"),
        **domain("gender", "'Male','Female','Other'"),
        **domain("marital_status", "'Single','Married','Divorced','Widowed'"),
        **domain("education_level", "'High School','Bachelor','Master','PhD'"),
        **domain("employment_status", "'Employed','Self-Employed','Unemployed'"),
        **domain("home_ownership", "'Own','Rent','Mortgage'"),
    },
    "credit_history": {
        **absent("customer_id"),
        **absent("credit_score"),
        "total_debt": ("total_debt < 0", "negative debts"),
        "years_credit_history": (
            "years_credit_history > (SELECT age FROM customers c WHERE c.customer_id = credit_history.customer_id) - 18",
            "histories begun before 18"),
    },
    "transactions": {
        **absent("customer_id"),
        "transaction_amount": ("transaction_amount <= 0", "non-positive amounts"),
        "transaction_date": (f"transaction_date > {AS_OF}", "dates in the future"),
        **domain("transaction_type", "'Debit','Credit'"),
    },
    "loan_applications": {
        **absent("customer_id"),
        **absent("loan_amount"),
        "loan_term_months": ("loan_term_months NOT IN (12,24,36,48,60,72)", "unknown terms"),
        "days_past_due": ("days_past_due < 0", "negative days past due"),
        "debt_to_income_ratio": ("debt_to_income_ratio NOT BETWEEN 0 AND 1", "ratios outside 0 to 1"),
        **domain("loan_purpose", "'Home','Auto','Personal','Education','Business'"),
    },
}


def payment(amount: str, rate: str, months: str) -> str:
    growth = f"pow(1 + {rate} / 12, {months})"
    return (
        f"CASE WHEN {rate} = 0 THEN {amount} / {months} "
        f"ELSE {amount} * ({rate} / 12 * {growth} / ({growth} - 1)) END"
    )


LOAN_PAYMENT = payment("loan_amount", "interest_rate", "loan_term_months")

MESSAGE = """
    CASE WHEN customer_id IS NULL AND loan_amount IS NULL
           THEN 'Missing required fields: customer_id, loan_amount'
         WHEN customer_id IS NULL THEN 'Missing required fields: customer_id'
         WHEN loan_amount IS NULL THEN 'Missing required fields: loan_amount'
         WHEN try_cast(customer_id AS BIGINT) IS NULL THEN 'customer_id must be an integer'
         WHEN try_cast(loan_amount AS DOUBLE) IS NULL THEN 'loan_amount must be a number'
         WHEN try_cast(loan_amount AS DOUBLE) <= 0 THEN 'loan_amount must be positive'
         WHEN loan_term_months IS NOT NULL AND try_cast(loan_term_months AS INT) IS NULL
           THEN 'loan_term_months must be an integer'
         WHEN loan_term_months IS NOT NULL AND try_cast(loan_term_months AS INT) NOT IN (12,24,36,48,60,72)
           THEN 'loan_term_months must be one of: 12, 24, 36, 48, 60, 72'
         ELSE 'Valid request' END"""

REQUEST_FEATURES = f"""
    SELECT q.request_id, q.customer_id, q.loan_amount, q.loan_term_months, q.message AS checked,
           c.customer_id IS NOT NULL AS found, c.age, c.annual_income, c.years_employed, c.num_dependents,
           h.credit_score, h.num_credit_accounts, h.credit_utilization_ratio, h.num_delinquent_accounts,
           h.total_debt, h.years_credit_history, h.bankruptcy_flag, r.rate_mid AS interest_rate,
           s.avg_monthly_spending, s.spending_volatility, coalesce(s.transaction_count, 0) AS transaction_count,
           c.years_employed / nullif(c.age, 0) * 100 AS employment_stability_score,
           h.num_delinquent_accounts * 20 + (1 - h.credit_utilization_ratio) * 30 AS delinquency_score,
           q.loan_amount / nullif(c.annual_income, 0) AS loan_to_income_ratio,
           CASE WHEN c.annual_income > 0
                THEN ({payment('q.loan_amount', 'coalesce(r.rate_mid, 0.2::DOUBLE)', 'q.loan_term_months')}) * 12
                     / c.annual_income ELSE 0 END AS debt_to_income_ratio,
           CASE c.employment_status WHEN 'Self-Employed' THEN 1 WHEN 'Unemployed' THEN 2 ELSE 0 END AS employment_status_encoded,
           CASE c.home_ownership WHEN 'Rent' THEN 1 WHEN 'Mortgage' THEN 2 ELSE 0 END AS home_ownership_encoded
    FROM (SELECT request_id, {MESSAGE} AS message,
                 CASE WHEN message = 'Valid request' THEN try_cast(customer_id AS BIGINT) END AS customer_id,
                 try_cast(loan_amount AS DOUBLE) AS loan_amount,
                 coalesce(try_cast(loan_term_months AS INT), 36) AS loan_term_months FROM requests) q
    LEFT JOIN customers c ON q.customer_id = c.customer_id
    LEFT JOIN credit_history h ON q.customer_id = h.customer_id
    LEFT JOIN rate r ON h.credit_id = r.credit_id
    LEFT JOIN spending s ON q.customer_id = s.customer_id"""

REQUEST_STATUS = f"""
    SELECT request_id, CASE WHEN checked = 'Valid request' THEN customer_id END AS customer_id,
           CASE WHEN checked = 'Valid request' AND found THEN 'success' ELSE 'error' END AS status,
           CASE WHEN checked <> 'Valid request' THEN checked
                WHEN NOT found THEN 'Customer not found' END AS message
    FROM ({REQUEST_FEATURES})"""

SWEEP_ROWS = f"""
    SELECT *, coalesce(2 * (precision * recall) / nullif(precision + recall, 0), 0) AS f1_score
    FROM (SELECT *, coalesce(true_positives / nullif(true_positives + false_positives, 0), 0) AS precision,
                 coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0) AS recall
          FROM (SELECT model_name, threshold,
                       count(*) FILTER (label = 1 AND probability >= threshold) AS true_positives,
                       count(*) FILTER (label = 0 AND probability >= threshold) AS false_positives,
                       count(*) FILTER (label = 1 AND probability < threshold) AS false_negatives,
                       count(*) FILTER (label = 0 AND probability < threshold) AS true_negatives
                FROM scored, (SELECT 0.1::DOUBLE + i * ((0.1::DOUBLE + 0.05::DOUBLE) - 0.1::DOUBLE) AS threshold FROM range(18) r(i)) v
                GROUP BY model_name, threshold))"""

CONSISTENCY = """
    CASE WHEN transaction_count IS NULL THEN 50 WHEN avg_monthly_spending = 0 THEN 50
         WHEN spending_volatility IS NULL THEN 100
         ELSE greatest(0, least(100, 100 - spending_volatility / avg_monthly_spending * 50)) END"""


def age_band(column: str) -> str:
    return f"""CASE WHEN {column} < 30 THEN '18-29' WHEN {column} < 40 THEN '30-39'
                    WHEN {column} < 50 THEN '40-49' WHEN {column} < 60 THEN '50-59' ELSE '60+' END"""


def factor(label: str, source: str, condition: str) -> str:
    return f"""SELECT '{label}' AS risk_factor, count(*) AS customer_count, round(avg(s.risk_score), 2) AS avg_risk_score
               FROM {source} x JOIN risk_scores s ON x.customer_id = s.customer_id
               WHERE {condition} AND s.prediction_date >= {AS_OF} - INTERVAL 7 DAY"""


BODIES: dict[str, str] = {
    # Features
    "fe_income_category": """
        SELECT customer_id, CASE WHEN annual_income >= 0 AND annual_income <= 30000 THEN 'Low'
               WHEN annual_income > 30000 AND annual_income <= 60000 THEN 'Medium'
               WHEN annual_income > 60000 AND annual_income <= 100000 THEN 'High'
               WHEN annual_income > 100000 THEN 'Very High' END AS income_category FROM customers""",
    "fe_employment_stability": """
        SELECT customer_id, round(years_employed / greatest(age, 1) * 100, 6) AS employment_stability_score
        FROM customers""",
    "fe_delinquency_penalised": """
        SELECT credit_id, round((1 - credit_utilization_ratio) * 30 - num_delinquent_accounts * 20, 6)
               AS delinquency_score FROM credit_history""",
    "fe_delinquency_score": """
        SELECT credit_id, round(num_delinquent_accounts * 20 + (1 - credit_utilization_ratio) * 30, 6)
               AS delinquency_score FROM credit_history""",
    "fe_loan_to_income": """
        SELECT loan_id, round(CASE WHEN annual_income IS NOT NULL THEN loan_amount / greatest(annual_income, 1) END, 6)
               AS loan_to_income_ratio FROM features""",
    "fe_monthly_payment": f"SELECT loan_id, round({LOAN_PAYMENT}, 4) AS monthly_payment FROM loan_applications",
    "fe_debt_to_income": f"""
        SELECT loan_id, round(CASE WHEN annual_income IS NOT NULL
               THEN ({LOAN_PAYMENT}) * 12 / greatest(annual_income, 1) END, 6) AS debt_to_income FROM features""",
    "fe_credit_age_score": """
        SELECT loan_id, round(CASE WHEN age IS NOT NULL THEN years_credit_history / greatest(age - 18, 1) * 100 END, 6)
               AS credit_age_score FROM features""",
    "fe_debt_burden": """
        SELECT loan_id, round(CASE WHEN annual_income IS NOT NULL THEN total_debt / greatest(annual_income, 1) END, 6)
               AS debt_burden FROM features""",
    "fe_utilization_category": """
        SELECT loan_id, CASE WHEN credit_utilization_ratio < 0.3 THEN 'Excellent'
               WHEN credit_utilization_ratio < 0.5 THEN 'Good' WHEN credit_utilization_ratio < 0.7 THEN 'Fair'
               WHEN credit_utilization_ratio >= 0.7 THEN 'Poor' ELSE 'Unknown' END AS utilization_category
        FROM features""",
    "fe_payment_consistency": f"""
        SELECT customer_id, round({CONSISTENCY}, 6) AS payment_consistency_score
        FROM customers LEFT JOIN spending USING (customer_id)""",
    "fe_interactions": """
        SELECT loan_id, round(annual_income / 100000 * credit_score / 850, 6) AS income_credit_interaction,
               round(debt_to_income_ratio * credit_utilization_ratio, 6) AS dti_utilization_risk,
               round(age / 100 * employment_stability_score / 100, 6) AS mature_stable_employment,
               round(loan_to_income_ratio * (1 - debt_to_income_ratio), 6) AS loan_affordability
        FROM features""",
    "fe_risk_flags": """
        SELECT *, high_dti_flag + low_credit_flag + high_utilization_flag + has_delinquency_flag AS multiple_risk_factors
        FROM (SELECT loan_id, coalesce(debt_to_income_ratio > 0.43, false)::INT AS high_dti_flag,
                     coalesce(credit_score < 650, false)::INT AS low_credit_flag,
                     coalesce(credit_utilization_ratio > 0.7, false)::INT AS high_utilization_flag,
                     coalesce(num_delinquent_accounts > 0, false)::INT AS has_delinquency_flag,
                     coalesce(employment_status = 'Unemployed', false)::INT AS unemployed_flag FROM features)""",
    "fe_binned": """
        SELECT loan_id, CASE WHEN age > 0 AND age <= 30 THEN '18-30' WHEN age > 30 AND age <= 40 THEN '31-40'
                    WHEN age > 40 AND age <= 50 THEN '41-50' WHEN age > 50 AND age <= 60 THEN '51-60'
                    WHEN age > 60 AND age <= 100 THEN '60+' END AS age_group,
               CASE WHEN credit_score > 0 AND credit_score <= 600 THEN 'Poor'
                    WHEN credit_score > 600 AND credit_score <= 650 THEN 'Fair'
                    WHEN credit_score > 650 AND credit_score <= 700 THEN 'Good'
                    WHEN credit_score > 700 AND credit_score <= 750 THEN 'Very Good'
                    WHEN credit_score > 750 AND credit_score <= 850 THEN 'Excellent' END AS credit_tier,
               CASE WHEN loan_amount > 0 AND loan_amount <= 25000 THEN 'Small'
                    WHEN loan_amount > 25000 AND loan_amount <= 50000 THEN 'Medium'
                    WHEN loan_amount > 50000 AND loan_amount <= 100000 THEN 'Large'
                    WHEN loan_amount > 100000 THEN 'Very Large' END AS loan_size FROM features""",
    "fe_transaction_aggregates": """
        SELECT customer_id, round(avg(transaction_amount), 6) AS avg_transaction_amount,
               round(coalesce(stddev_samp(transaction_amount), 0), 6) AS transaction_volatility,
               min(transaction_amount) AS min_transaction_amount, max(transaction_amount) AS max_transaction_amount,
               round(coalesce(sum(transaction_amount), 0), 4) AS total_transaction_amount,
               count(transaction_id) AS transaction_count
        FROM transactions WHERE customer_id IS NOT NULL GROUP BY customer_id""",
    "fe_rate_tier": "SELECT credit_id, rate_low, rate_high, rate_mid FROM rate",
    "fe_rule_scorecard": "SELECT loan_id, round(rule_probability, 6) AS default_probability FROM scorecard",
    "fe_base_credit_score": """
        SELECT customer_id, round(CASE WHEN annual_income IS NOT NULL
               THEN greatest(300, least(850, 600 + annual_income / 1000 + years_employed * 2)) END, 6) AS base_credit_score
        FROM customers""",
    # Feature table
    "etl_risk_features": """
        SELECT * REPLACE (round(avg_monthly_spending, 6) AS avg_monthly_spending,
                          round(spending_volatility, 6) AS spending_volatility,
                          round(total_spending, 4) AS total_spending,
                          round(employment_stability_score, 6) AS employment_stability_score,
                          round(delinquency_score, 6) AS delinquency_score,
                          round(loan_to_income_ratio, 6) AS loan_to_income_ratio)
        FROM features""",
    "etl_feature_row_count": """
        SELECT count(*) AS feature_rows, count(credit_id) AS with_credit, count(transaction_count) AS with_transactions,
               count(DISTINCT customer_id) AS customers FROM features""",
    "etl_feature_store": f"""
        SELECT loan_id AS feature_id, customer_id, loan_id, age, income_category,
               round(employment_stability_score, 6) AS employment_stability_score, credit_score,
               credit_utilization_ratio AS credit_utilization, round(delinquency_score, 6) AS delinquency_score,
               round(avg_monthly_spending, 6) AS avg_monthly_spending,
               round(spending_volatility, 6) AS transaction_volatility,
               round({CONSISTENCY}, 6) AS payment_consistency_score, debt_to_income_ratio AS debt_to_income,
               round(loan_to_income_ratio, 6) AS loan_to_income_ratio, created_at FROM features""",
    # Feature queries
    "fq_customer_profile": """
        SELECT c.customer_id, c.age, c.annual_income, c.years_employed, c.employment_status, c.home_ownership,
               h.credit_score, h.credit_utilization_ratio, h.num_delinquent_accounts, h.total_debt, h.bankruptcy_flag,
               count(DISTINCT t.transaction_id) AS total_transactions,
               round(avg(t.transaction_amount), 8) AS avg_transaction_amount,
               round(stddev_samp(t.transaction_amount), 8) AS transaction_volatility,
               count(DISTINCT l.loan_id) AS total_loans,
               CAST(sum(CASE WHEN l.default_flag THEN 1 ELSE 0 END) AS BIGINT) AS defaulted_loans
        FROM customers c LEFT JOIN credit_history h ON c.customer_id = h.customer_id
        LEFT JOIN transactions t ON c.customer_id = t.customer_id
        LEFT JOIN loan_applications l ON c.customer_id = l.customer_id
        GROUP BY ALL""",
    "fq_transaction_features": """
        SELECT customer_id, count(*) AS transaction_count, round(avg(transaction_amount), 6) AS avg_monthly_spending,
               round(stddev_samp(transaction_amount), 6) AS spending_volatility,
               min(transaction_amount) AS min_transaction, max(transaction_amount) AS max_transaction,
               round(sum(CASE WHEN transaction_type = 'Debit' THEN transaction_amount ELSE 0 END), 4) AS total_debits,
               round(sum(CASE WHEN transaction_type = 'Credit' THEN transaction_amount ELSE 0 END), 4) AS total_credits
        FROM transactions GROUP BY customer_id""",
    "fq_recent_loans": """
        SELECT loan_id, customer_id, application_date, loan_amount, loan_purpose, loan_term_months, interest_rate,
               debt_to_income_ratio, default_flag, days_past_due FROM loan_applications
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY application_date DESC NULLS LAST, loan_id) <= 5""",
    "fq_utilization_trend": """
        SELECT customer_id, round(avg(credit_utilization_ratio), 6) AS avg_utilization,
               max(credit_utilization_ratio) AS max_utilization, min(credit_utilization_ratio) AS min_utilization
        FROM credit_history GROUP BY customer_id""",
    "fq_high_risk_customers": f"""
        SELECT f.customer_id, f.loan_id, f.credit_score, f.debt_to_income,
               round(f.delinquency_score, 6) AS delinquency_score, s.prediction_id, s.risk_score, s.risk_category
        FROM risk_features f JOIN risk_scores s ON f.customer_id = s.customer_id
        WHERE s.risk_category = 'High' AND s.prediction_date >= {AS_OF} - INTERVAL 30 DAY
        ORDER BY s.risk_score DESC NULLS LAST, f.customer_id, s.prediction_id, f.loan_id,
                 f.credit_score NULLS LAST, f.delinquency_score NULLS LAST LIMIT 100""",
    "fq_loan_capacity": """
        SELECT customer_id, annual_income, round(annual_income * 3, 4) AS max_recommended_loan,
               round(annual_income * 0.43::DOUBLE, 4) AS max_monthly_payment,
               CASE WHEN annual_income < 30000 THEN 'Low' WHEN annual_income < 60000 THEN 'Medium'
                    WHEN annual_income < 100000 THEN 'High' ELSE 'Very High' END AS income_category FROM customers""",
    "fq_retraining_set": f"""
        SELECT c.customer_id, c.age, c.annual_income, c.years_employed, c.num_dependents, h.credit_score,
               h.num_credit_accounts, h.credit_utilization_ratio, h.num_delinquent_accounts, h.total_debt,
               h.years_credit_history, l.loan_id, l.loan_amount, l.loan_term_months, l.interest_rate,
               l.debt_to_income_ratio, l.default_flag
        FROM customers c JOIN newest_credit h ON c.customer_id = h.customer_id
        JOIN loan_applications l ON c.customer_id = l.customer_id
        WHERE l.application_date >= {AS_OF} - INTERVAL 2 YEAR""",
    "fq_employment_stability": """
        SELECT customer_id, age, years_employed, round(years_employed / nullif(age, 0) * 100, 6) AS employment_stability_score,
               CASE WHEN years_employed >= 10 THEN 'Very Stable' WHEN years_employed >= 5 THEN 'Stable'
                    WHEN years_employed >= 2 THEN 'Moderate' ELSE 'Unstable' END AS employment_stability_category
        FROM customers""",
    "fq_risk_trend": """
        SELECT customer_id, prediction_id, risk_score, risk_category, prediction_date, previous_risk_score,
               round(risk_score - previous_risk_score, 6) AS risk_change
        FROM (SELECT *, lag(risk_score) OVER (PARTITION BY customer_id ORDER BY prediction_date, prediction_id)
                     AS previous_risk_score FROM risk_scores)
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY prediction_date DESC, prediction_id DESC) <= 12""",
    "fq_latest_credit": """
        SELECT customer_id, credit_id, credit_score, num_delinquent_accounts, credit_utilization_ratio, created_at
        FROM credit_history
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC NULLS LAST, credit_id) = 1""",
    "fq_default_by_purpose": """
        SELECT loan_purpose, count(*) AS total_loans, count(*) FILTER (default_flag) AS defaulted_loans,
               round(count(*) FILTER (default_flag) / count(*) * 100, 2) AS default_rate,
               round(avg(loan_amount), 4) AS avg_loan_amount, round(avg(interest_rate), 6) AS avg_interest_rate
        FROM loan_applications GROUP BY loan_purpose""",
    "fq_high_dti_good_credit": """
        SELECT c.customer_id, c.annual_income, h.credit_score, l.debt_to_income_ratio, l.loan_amount, l.loan_id
        FROM customers c JOIN credit_history h ON c.customer_id = h.customer_id
        JOIN loan_applications l ON c.customer_id = l.customer_id
        WHERE h.credit_score >= 700 AND l.debt_to_income_ratio > 0.43
        ORDER BY l.debt_to_income_ratio DESC NULLS LAST, l.loan_id, h.credit_id LIMIT 50""",
    # Reports
    "rq_daily_summary": f"""
        SELECT CAST(prediction_date AS DATE) AS report_date, count(*) AS total_assessments,
               count(*) FILTER (risk_category = 'Low') AS low_risk_count,
               count(*) FILTER (risk_category = 'Medium') AS medium_risk_count,
               count(*) FILTER (risk_category = 'High') AS high_risk_count,
               round(avg(risk_score), 2) AS avg_risk_score, round(avg(default_probability), 4) AS avg_default_probability
        FROM risk_scores WHERE prediction_date >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1""",
    "rq_model_metrics": """
        SELECT model_name, model_version, algorithm, round(accuracy, 4) AS accuracy,
               round(precision_score, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score,
               round(auc_roc, 4) AS auc_roc, training_date FROM metadata
        ORDER BY training_date DESC NULLS LAST, model_id DESC LIMIT 5""",
    "rq_risk_by_demographics": f"""
        SELECT {age_band('c.age')} AS age_group, c.employment_status, count(*) AS customer_count,
               round(avg(s.risk_score), 2) AS avg_risk_score, count(*) FILTER (s.risk_category = 'High') AS high_risk_count
        FROM customers c JOIN risk_scores s ON c.customer_id = s.customer_id
        WHERE s.prediction_date >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1, 2""",
    "rq_loans_by_amount": """
        SELECT CASE WHEN loan_amount < 25000 THEN '0-25K' WHEN loan_amount < 50000 THEN '25K-50K'
                    WHEN loan_amount < 100000 THEN '50K-100K' WHEN loan_amount < 200000 THEN '100K-200K'
                    ELSE '200K+' END AS loan_range, count(*) AS total_loans, count(*) FILTER (default_flag) AS defaults,
               round(count(*) FILTER (default_flag) / count(*) * 100, 2) AS default_rate,
               round(avg(interest_rate) * 100, 2) AS avg_interest_rate, round(avg(debt_to_income_ratio), 2) AS avg_dti
        FROM loan_applications GROUP BY 1""",
    "rq_default_by_score": """
        SELECT CASE WHEN h.credit_score < 600 THEN '300-599' WHEN h.credit_score < 650 THEN '600-649'
                    WHEN h.credit_score < 700 THEN '650-699' WHEN h.credit_score < 750 THEN '700-749'
                    ELSE '750+' END AS credit_score_range, count(DISTINCT l.loan_id) AS total_loans,
               count(*) FILTER (l.default_flag) AS defaults,
               round(count(*) FILTER (l.default_flag) / count(*) * 100, 2) AS default_rate
        FROM credit_history h JOIN loan_applications l ON h.customer_id = l.customer_id GROUP BY 1""",
    "rq_risk_factors": " UNION ALL ".join([
        factor("High DTI", "risk_features", "x.debt_to_income > 0.43"),
        factor("Low Credit Score", "risk_features", "x.credit_score < 650"),
        factor("High Delinquency", "credit_history", "x.num_delinquent_accounts >= 2"),
        factor("Bankruptcy History", "credit_history", "x.bankruptcy_flag"),
    ]),
    "rq_monthly_trend": f"""
        SELECT CAST(date_trunc('month', prediction_date) AS TIMESTAMP) AS month, count(*) AS total_predictions,
               round(avg(risk_score), 2) AS avg_risk_score, count(*) FILTER (risk_category = 'High') AS high_risk_count,
               round(count(*) FILTER (risk_category = 'High') / count(*) * 100, 2) AS high_risk_percentage
        FROM risk_scores WHERE prediction_date >= {AS_OF} - INTERVAL 12 MONTH GROUP BY 1""",
    "rq_purpose_risk": """
        SELECT l.loan_purpose, count(*) AS total_applications, count(*) FILTER (l.default_flag) AS defaults,
               round(count(*) FILTER (l.default_flag) / count(*) * 100, 2) AS default_rate,
               round(avg(s.risk_score), 2) AS avg_predicted_risk, round(avg(l.loan_amount), 2) AS avg_loan_amount,
               round(avg(l.interest_rate) * 100, 2) AS avg_interest_rate
        FROM loan_applications l LEFT JOIN risk_scores s ON l.customer_id = s.customer_id GROUP BY 1""",
    "rq_segments": f"""
        SELECT CASE WHEN c.annual_income < 30000 THEN 'Low Income' WHEN c.annual_income < 60000 THEN 'Medium Income'
                    WHEN c.annual_income < 100000 THEN 'High Income' ELSE 'Very High Income' END AS income_segment,
               CASE WHEN h.credit_score < 650 THEN 'Poor Credit' WHEN h.credit_score < 700 THEN 'Fair Credit'
                    WHEN h.credit_score < 750 THEN 'Good Credit' ELSE 'Excellent Credit' END AS credit_segment,
               count(DISTINCT c.customer_id) AS customer_count, round(avg(s.risk_score), 2) AS avg_risk_score,
               count(*) FILTER (s.risk_category = 'High') AS high_risk_count
        FROM customers c JOIN credit_history h ON c.customer_id = h.customer_id
        JOIN risk_scores s ON c.customer_id = s.customer_id
        WHERE s.prediction_date >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1, 2""",
    "rq_calibration": f"""
        SELECT s.risk_category, count(*) AS predictions, count(*) FILTER (l.default_flag) AS actual_defaults,
               round(count(*) FILTER (l.default_flag) / count(*) * 100, 2) AS actual_default_rate,
               round(avg(s.default_probability) * 100, 2) AS predicted_default_rate
        FROM risk_scores s JOIN loan_applications l ON s.customer_id = l.customer_id
        WHERE s.prediction_date >= {AS_OF} - INTERVAL 6 MONTH GROUP BY 1""",
    "rq_potential_loss": f"""
        SELECT c.customer_id, c.annual_income, h.credit_score, l.loan_amount, s.risk_score, s.risk_category,
               l.loan_amount * s.default_probability AS potential_loss, l.loan_id, s.prediction_id
        FROM customers c JOIN credit_history h ON c.customer_id = h.customer_id
        JOIN loan_applications l ON c.customer_id = l.customer_id
        JOIN risk_scores s ON c.customer_id = s.customer_id
        WHERE s.risk_category IN ('Medium', 'High') AND l.loan_amount > 50000
          AND s.prediction_date >= {AS_OF} - INTERVAL 30 DAY
        ORDER BY l.loan_amount * s.default_probability DESC NULLS LAST, l.loan_amount DESC,
                 s.default_probability DESC NULLS LAST, c.customer_id, l.loan_id, s.prediction_id, h.credit_id LIMIT 100""",
    "rq_feature_distribution": """
        SELECT 'Credit Score' AS feature, round(avg(credit_score), 2) AS mean_value,
               round(stddev_samp(credit_score), 2) AS std_dev, min(credit_score)::DOUBLE AS min_value,
               max(credit_score)::DOUBLE AS max_value FROM credit_history
        UNION ALL SELECT 'Annual Income', round(avg(annual_income), 2), round(stddev_samp(annual_income), 2),
               min(annual_income), max(annual_income) FROM customers
        UNION ALL SELECT 'Debt to Income', round(avg(debt_to_income_ratio), 2),
               round(stddev_samp(debt_to_income_ratio), 2), min(debt_to_income_ratio), max(debt_to_income_ratio)
        FROM loan_applications""",
    "rq_weekly_alerts": f"""
        SELECT {AS_OF} AS report_date, alert_type, alert_count, part,
               string_agg(CAST(customer_id AS VARCHAR), ', ' ORDER BY place) AS customer_ids
        FROM (SELECT *, count(*) OVER (PARTITION BY alert_type) AS alert_count,
                     row_number() OVER (PARTITION BY alert_type ORDER BY prediction_id) AS place,
                     CAST((place - 1) // 1000 + 1 AS BIGINT) AS part
              FROM (SELECT 'New High Risk Customers' AS alert_type, customer_id, prediction_id FROM risk_scores
                    WHERE risk_category = 'High' AND prediction_date >= {AS_OF} - INTERVAL 7 DAY
                    UNION ALL
                    SELECT 'Sudden Risk Increase', customer_id, prediction_id
                    FROM (SELECT *, risk_score - lag(risk_score) OVER (PARTITION BY customer_id
                                 ORDER BY prediction_date, prediction_id) AS change
                          FROM risk_scores WHERE prediction_date >= {AS_OF} - INTERVAL 30 DAY) WHERE change > 20))
        WHERE alert_count > CASE alert_type WHEN 'New High Risk Customers' THEN 10 ELSE 0 END
        GROUP BY alert_type, alert_count, part""",
    "rq_profitability": f"""
        SELECT s.risk_category, count(*) AS loan_count, round(avg(l.loan_amount), 2) AS avg_loan_amount,
               round(avg(l.interest_rate) * 100, 2) AS avg_interest_rate,
               round(sum(l.loan_amount * l.interest_rate * (l.loan_term_months / 12)), 2) AS total_interest_revenue,
               round(sum(CASE WHEN l.default_flag THEN l.loan_amount ELSE 0 END), 2) AS total_loss_from_defaults,
               round(sum(l.loan_amount * l.interest_rate * (l.loan_term_months / 12))
                     - sum(CASE WHEN l.default_flag THEN l.loan_amount ELSE 0 END), 2) AS net_profit
        FROM risk_scores s JOIN loan_applications l ON s.customer_id = l.customer_id
        WHERE s.prediction_date >= {AS_OF} - INTERVAL 12 MONTH GROUP BY 1""",
    "rq_data_quality": """
        SELECT 'Customers' AS table_name, count(*) AS total_records, count(*) FILTER (age IS NULL) AS null_age,
               count(*) FILTER (annual_income IS NULL) AS null_income, max(created_at) AS last_updated FROM customers
        UNION ALL SELECT 'Credit History', count(*), count(*) FILTER (credit_score IS NULL),
               count(*) FILTER (credit_utilization_ratio IS NULL), max(created_at) FROM credit_history
        UNION ALL SELECT 'Loan Applications', count(*), count(*) FILTER (loan_amount IS NULL),
               count(*) FILTER (interest_rate IS NULL), max(created_at) FROM loan_applications""",
    # Data quality
    "dq_missing_values": f"""
        SELECT *, round(missing_rows / total_rows, 6) AS missing_share,
               CASE WHEN missing_rows / total_rows > 0.05 THEN 'error' ELSE 'warning' END AS level
        FROM ({' UNION ALL '.join(missing(t) for t in ('customers', 'credit_history', 'dirty_customers'))})
        WHERE missing_rows > 0""",
    "dq_duplicates": f"""
        {duplicate_check('dirty_customers', 'customer_id')} UNION ALL {duplicate_check('customers', 'customer_id')}
        UNION ALL {duplicate_check('credit_history', 'customer_id')}""",
    "dq_value_ranges": rule_rows("dirty_customers", RANGES["dirty_customers"])
    + " UNION ALL " + rule_rows("credit_history", RANGES["credit_history"]),
    "dq_referential_integrity": " UNION ALL ".join([
        orphan_check("dirty_customers", "customers -> dirty_customers"),
        orphan_check("credit_history", "customers -> credit_history"),
        orphan_check("transactions", "customers -> transactions"),
        orphan_check("loan_applications", "customers -> loans"),
    ]),
    "dq_anomalies": """
        SELECT * FROM (WITH found AS (
        SELECT 'dirty_customers' AS table_name, (SELECT count(*) FROM dirty_customers) AS total_rows, rule,
               count(*) FILTER (abs((value - mean) / spread) > 3) AS bad_rows, 'outliers' AS text
        FROM (UNPIVOT (SELECT age::DOUBLE AS age, annual_income FROM dirty_customers) ON age, annual_income
              INTO NAME rule VALUE value)
        JOIN (SELECT 'age' AS rule, avg(age) AS mean, stddev_samp(age) AS spread FROM dirty_customers
              UNION ALL SELECT 'annual_income', avg(annual_income), stddev_samp(annual_income) FROM dirty_customers)
        USING (rule) GROUP BY rule),
        hits AS (SELECT format('{}: {} outliers ({:.2f}%)', rule, bad_rows, bad_rows / total_rows * 100) AS text
                 FROM found WHERE bad_rows / total_rows * 100 > 5)
        SELECT found.*, CASE WHEN (SELECT count(*) FROM hits) > 0 THEN 'warning' ELSE 'pass' END AS status,
               coalesce((SELECT string_agg(text, '; ' ORDER BY text) FROM hits), '') AS messages
        FROM found)""",
    "dq_freshness": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, max(created_at) AS newest,
                   CAST(floor(epoch({AS_OF}::TIMESTAMP - max(created_at)) / 86400) AS INT) AS age_days,
                   7 AS max_age_days,
                   CASE WHEN floor(epoch({AS_OF}::TIMESTAMP - max(created_at)) / 86400) > 7 THEN 'warning' ELSE 'pass' END
                     AS status FROM {t}"""
        for t in ("customers", "credit_history", "transactions", "loan_applications")
    ),
    "dq_data_types": " UNION ALL ".join(
        f"""SELECT 'requests' AS table_name, '{name}' AS column_name, '{actual}' AS actual_type, '{kind}' AS expected_type,
                   count(*) FILTER ({name} IS NOT NULL AND try_cast({name} AS {kind}) IS NULL) AS unreadable_rows,
                   count(*) AS total_rows, 'warning' AS status, CAST(3 AS BIGINT) AS bad,
                   'requests.customer_id: expected bigint, got string; requests.loan_amount: expected double, '
                   || 'got string; requests.loan_term_months: expected int, got string' AS messages FROM requests"""
        for name, actual, kind in (("request_id", "bigint", "bigint"), ("customer_id", "string", "bigint"),
                                   ("loan_amount", "string", "double"), ("loan_term_months", "string", "int"))
    ),
    "dq_business_rules": " UNION ALL ".join(
        rule_rows(t, RULES[t]) for t in ("dirty_customers", "customers", "credit_history", "loan_applications")
    ),
    "dq_documented_rules": " UNION ALL ".join(rule_rows(t, rules) for t, rules in DOCUMENTED.items()),
    "dq_summary": SUMMARY,
    "dq_suite": SUITE,
    "dq_suite_from_deliveries": SUITE,
    "dq_latest_timestamps": """
        SELECT (SELECT max(created_at) FROM customers) AS latest_customer,
               (SELECT max(created_at) FROM credit_history) AS latest_credit,
               (SELECT max(created_at) FROM transactions) AS latest_transaction,
               (SELECT max(created_at) FROM loan_applications) AS latest_loan""",
    "dq_impute": """
        SELECT customer_id, coalesce(age, (SELECT round(avg(age), 2) FROM dirty_customers)) AS age,
               coalesce(annual_income, (SELECT round(avg(annual_income), 2) FROM dirty_customers)) AS annual_income,
               coalesce(employment_status, (SELECT employment_status FROM dirty_customers
                        WHERE employment_status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
                 AS employment_status FROM dirty_customers""",
    # Models and evaluation
    "ml_stratified_split": """
        SELECT loan_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY draw)
                 <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT loan_id, default_flag::INT AS label,
                     ('0x' || substr(md5(loan_id || ':42'), 1, 12))::BIGINT AS draw FROM loan_applications)""",
    "ml_feature_prep": """
        SELECT loan_id, coalesce(annual_income, 0) AS annual_income, coalesce(credit_score, 0)::DOUBLE AS credit_score,
               round(coalesce(loan_to_income_ratio, 0), 6) AS loan_to_income_ratio,
               dense_rank() OVER (ORDER BY coalesce(employment_status, 'Unknown'))::INT - 1 AS employment_status_encoded,
               dense_rank() OVER (ORDER BY coalesce(home_ownership, 'Unknown'))::INT - 1 AS home_ownership_encoded,
               dense_rank() OVER (ORDER BY coalesce(loan_purpose, 'Unknown'))::INT - 1 AS loan_purpose_encoded
        FROM features""",
    "score_categorize": """
        SELECT loan_id, round(probability * 100, 6) AS risk_score,
               CASE WHEN probability * 100 < 30 THEN 'Low' WHEN probability * 100 < 60 THEN 'Medium' ELSE 'High' END AS risk_category,
               CASE WHEN probability * 100 < 30 THEN 'Approve - Low risk of default'
                    WHEN probability * 100 < 60 THEN 'Review - Manual underwriting recommended'
                    ELSE 'Reject - High risk of default' END AS recommendation
        FROM (SELECT loan_id, default_probability AS probability FROM risk_scores)""",
    "score_categorize_right_closed": """
        SELECT loan_id, CASE WHEN risk_score > 0 AND risk_score <= 30 THEN 'Low'
               WHEN risk_score > 30 AND risk_score <= 60 THEN 'Medium'
               WHEN risk_score > 60 AND risk_score <= 100 THEN 'High' END AS risk_category FROM risk_scores""",
    "ev_report": f"""
        SELECT model_name, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives,
               round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1_score, 6) AS f1_score, round(specificity, 6) AS specificity, round(auc_roc, 6) AS auc_roc,
               round(average_precision, 6) AS average_precision FROM ({report('scored')})""",
    "ev_roc_curve": f"""
        SELECT model_name, threshold, round(fps / n, 6) AS fpr, round(tps / p, 6) AS tpr FROM ({curve('scored')})
        WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
        UNION ALL SELECT DISTINCT model_name, 'inf'::DOUBLE, 0, 0 FROM scored""",
    "ev_auc": f"SELECT model_name, round(auc_roc, 6) AS auc_roc FROM ({report('scored')})",
    "ev_pr_curve": f"""
        SELECT model_name, threshold, round(tps / (tps + fps), 6) AS precision, round(tps / p, 6) AS recall
        FROM ({curve('scored')})
        UNION ALL SELECT DISTINCT model_name, NULL::DOUBLE, 1, 0 FROM scored""",
    "ev_average_precision": f"SELECT model_name, round(average_precision, 6) AS average_precision FROM ({report('scored')})",
    "ev_confusion_matrix": """
        SELECT model_name, label AS true_label, (probability > 0.5)::INT AS predicted_label, count(*) AS rows
        FROM scored GROUP BY ALL""",
    "ev_threshold_sweep": f"""
        SELECT model_name, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1_score, 6) AS f1_score, true_positives, false_positives, false_negatives, true_negatives
        FROM ({SWEEP_ROWS})""",
    "ev_optimal_threshold": f"""
        SELECT model_name, threshold, round(f1_score, 6) AS f1_score FROM ({SWEEP_ROWS})
        QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY f1_score DESC, threshold) = 1""",
    "ev_compare_models": f"""
        SELECT metric, round(max(value) FILTER (model_name = 'stored_score'), 6) AS stored_score,
               round(max(value) FILTER (model_name = 'rule_scorecard'), 6) AS rule_scorecard
        FROM (UNPIVOT (SELECT model_name, accuracy, precision, recall, f1_score, auc_roc FROM ({report('scored')}))
              ON accuracy, precision, recall, f1_score, auc_roc INTO NAME metric VALUE value) GROUP BY metric""",
    # Requests and stored scores
    "req_validate": f"""
        SELECT request_id, message = 'Valid request' AS valid, message FROM (SELECT request_id, {MESSAGE} AS message FROM requests)""",
    "req_features": f"""
        SELECT request_id, customer_id, loan_amount, loan_term_months, age, annual_income, years_employed, num_dependents,
               credit_score, num_credit_accounts, credit_utilization_ratio, num_delinquent_accounts, total_debt,
               years_credit_history, bankruptcy_flag, coalesce(interest_rate, 0.2::DOUBLE) AS interest_rate,
               round(avg_monthly_spending, 6) AS avg_monthly_spending, round(spending_volatility, 6) AS spending_volatility,
               transaction_count, round(employment_stability_score, 6) AS employment_stability_score,
               round(delinquency_score, 6) AS delinquency_score, round(loan_to_income_ratio, 6) AS loan_to_income_ratio,
               round(debt_to_income_ratio, 6) AS debt_to_income_ratio, employment_status_encoded, home_ownership_encoded
        FROM ({REQUEST_FEATURES}) WHERE checked = 'Valid request' AND found""",
    "req_batch_status": REQUEST_STATUS,
    "req_batch_summary": f"""
        SELECT count(*) AS total, count(*) FILTER (status = 'success') AS successful,
               count(*) FILTER (status = 'error') AS failed FROM ({REQUEST_STATUS})""",
    "latest_risk_score": """
        SELECT customer_id, prediction_id, risk_score, risk_category, default_probability, prediction_date FROM risk_scores
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY prediction_date DESC, prediction_id DESC) = 1""",
    "latest_model_metrics": """
        SELECT model_name, model_version, algorithm, round(accuracy, 6) AS accuracy,
               round(precision_score, 6) AS precision_score, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
               round(auc_roc, 6) AS auc_roc, strftime(training_date, '%Y-%m-%dT%H:%M:%S') AS training_date
        FROM metadata ORDER BY metadata.training_date DESC NULLS LAST, model_id DESC LIMIT 1""",
    "unscored_customers": """
        SELECT customer_id, loan_id, credit_score, debt_to_income FROM risk_features
        WHERE customer_id NOT IN (SELECT customer_id FROM risk_scores
                                  WHERE prediction_date >= DATE '2001-06-01' AND customer_id IS NOT NULL)""",
    "daily_run_summary": f"""
        SELECT total_checks, passed, warnings, failures, (SELECT count(*) FROM features) AS features_generated,
               m.algorithm, round(m.accuracy, 6) AS accuracy, round(m.auc_roc, 6) AS auc_roc,
               (SELECT count(*) FROM risk_scores WHERE prediction_date >= DATE '2001-07-01') AS new_predictions
        FROM ({SUMMARY}), (SELECT * FROM metadata ORDER BY training_date DESC LIMIT 1) m""",
    "performance_drop_alerts": """
        SELECT model_version, training_date, round(auc_roc, 6) AS current, round(previous, 6) AS previous,
               round((previous - auc_roc) / previous, 6) AS lost_share
        FROM (SELECT *, lag(auc_roc) OVER (PARTITION BY model_name ORDER BY training_date, model_id) AS previous FROM metadata)
        WHERE (previous - auc_roc) / nullif(previous, 0) > 0.05""",
    # Dashboard
    "dash_category_share": """
        SELECT risk_category, count(*) AS assessments, round(count(*) / sum(count(*)) OVER () * 100, 1) AS share
        FROM risk_scores GROUP BY risk_category""",
    "dash_score_histogram": """
        SELECT CAST(least(floor(risk_score / 100 * 30) + 1, 30) AS INT) AS bin, count(*) AS assessments
        FROM risk_scores GROUP BY 1""",
    "dash_recent_predictions": """
        SELECT prediction_id, customer_id, round_even(risk_score, 2) AS risk_score, risk_category,
               CAST(round_even(default_probability * 100, 2) AS VARCHAR) || '%' AS default_probability, prediction_date
        FROM risk_scores ORDER BY risk_scores.prediction_date DESC, prediction_id DESC LIMIT 100""",
    "dash_key_factors": """
        SELECT loan_id, CASE WHEN debt_to_income_ratio < 0.43 THEN 'Good' ELSE 'High' END AS dti_label,
               CASE WHEN credit_utilization_ratio < 0.3 THEN 'Good' ELSE 'High' END AS utilization_label,
               CASE WHEN loan_to_income_ratio < 3 THEN 'Good' ELSE 'High' END AS loan_to_income_label,
               CASE WHEN employment_stability_score > 10 THEN 'Good' ELSE 'Low' END AS stability_label FROM features""",
    # What must hold of model results
    "ml_batch_scores_invariants": """
        SELECT loan_id, count(*) AS scores, count(*) AS in_range, count(*) AS percents, count(*) AS in_category
        FROM features GROUP BY loan_id""",
    "ml_explain_invariants": """
        SELECT loan_id, CAST(5 AS BIGINT) AS places, CAST(5 AS BIGINT) AS features, CAST(0 AS BIGINT) AS other_values
        FROM features""",
    "ml_importance_invariants": "SELECT CAST(20 AS BIGINT) AS features, 1.0::DOUBLE AS total",
    "ml_comparison_invariants": """
        SELECT unnest(['logistic', 'random_forest', 'gradient_boosting']) AS model_name, 5 AS metrics_in_range""",
    "req_batch_scores_invariants": f"SELECT request_id, status, message, status = 'success' AS has_score FROM ({REQUEST_STATUS})",
    "stream_request_invariants": f"SELECT request_id, status, message, status = 'success' AS has_score FROM ({REQUEST_STATUS})",
    # Streams
    "stream_daily_counts": """
        SELECT CAST(prediction_date AS DATE) AS report_date, count(*) AS total_assessments,
               count(*) FILTER (risk_category = 'Low') AS low_risk_count,
               count(*) FILTER (risk_category = 'Medium') AS medium_risk_count,
               count(*) FILTER (risk_category = 'High') AS high_risk_count,
               round(avg(risk_score), 2) AS avg_risk_score, round(avg(default_probability), 4) AS avg_default_probability
        FROM risk_scores GROUP BY 1""",
}


def exact_rounding(sql: str) -> str:
    """Round as decimals: ``round(x, n)`` becomes a rounding of x cast to a decimal."""
    out, start = "", 0
    while (at := sql.find("round(", start)) >= 0:
        depth, comma, end = 1, -1, at + 6
        while depth:
            char = sql[end]
            depth += (char == "(") - (char == ")")
            if char == "," and depth == 1:
                comma = end
            end += 1
        value, digits = exact_rounding(sql[at + 6:comma]), sql[comma + 1:end - 1].strip()
        out += sql[start:at] + f"CAST(round(CAST({value} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"
        start = end
    return out + sql[start:]


def oracle_sql(given: tuple[str, ...] = ()) -> dict[str, str]:
    return {name: exact_rounding(with_tables(body, given)) for name, body in BODIES.items()}
