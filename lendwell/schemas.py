"""Table schemas, feature lists and value domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Table layouts as DDL (money and ratios are doubles in the engine).
CUSTOMERS = (
    "customer_id bigint, age int, gender string, marital_status string, "
    "education_level string, employment_status string, annual_income double, "
    "years_employed int, home_ownership string, num_dependents int, "
    "created_at timestamp_ntz"
)
CREDIT_HISTORY = (
    "credit_id bigint, customer_id bigint, credit_score int, num_credit_accounts int, "
    "credit_utilization_ratio double, num_delinquent_accounts int, total_debt double, "
    "bankruptcy_flag boolean, years_credit_history int, created_at timestamp_ntz"
)
TRANSACTIONS = (
    "transaction_id bigint, customer_id bigint, transaction_date date, "
    "transaction_amount double, transaction_type string, category string, "
    "created_at timestamp_ntz"
)
LOAN_APPLICATIONS = (
    "loan_id bigint, customer_id bigint, application_date date, loan_amount double, "
    "loan_purpose string, loan_term_months int, interest_rate double, "
    "monthly_payment double, debt_to_income_ratio double, default_flag boolean, "
    "days_past_due int, created_at timestamp_ntz"
)
RISK_FEATURES = (
    "feature_id bigint, customer_id bigint, loan_id bigint, age int, "
    "income_category string, employment_stability_score double, credit_score int, "
    "credit_utilization double, delinquency_score double, avg_monthly_spending double, "
    "transaction_volatility double, payment_consistency_score double, "
    "debt_to_income double, loan_to_income_ratio double, created_at timestamp_ntz"
)
RISK_SCORES = (
    "prediction_id bigint, customer_id bigint, loan_id bigint, risk_score double, "
    "risk_category string, default_probability double, model_version string, "
    "prediction_date timestamp_ntz"
)
MODEL_METADATA = (
    "model_id int, model_name string, model_version string, algorithm string, "
    "accuracy double, precision_score double, recall double, f1_score double, "
    "auc_roc double, training_date timestamp_ntz, features_used string"
)
REQUESTS = (
    "request_id bigint, customer_id string, loan_amount string, loan_term_months string"
)
FEATURE_IMPORTANCE = "feature string, importance double"
MODEL_METRICS = (
    "accuracy double, precision double, recall double, f1_score double, auc_roc double"
)

STAGING = {
    "customers": CUSTOMERS,
    "credit_history": CREDIT_HISTORY,
    "transactions": TRANSACTIONS,
    "loan_applications": LOAN_APPLICATIONS,
}

# Model inputs, in the order the model expects them.
NUMERIC_FEATURES = [
    "age", "annual_income", "years_employed", "num_dependents", "credit_score",
    "num_credit_accounts", "credit_utilization_ratio", "num_delinquent_accounts",
    "total_debt", "years_credit_history", "loan_amount", "loan_term_months",
    "interest_rate", "debt_to_income_ratio", "employment_stability_score",
    "delinquency_score", "loan_to_income_ratio",
]
CATEGORICAL_FEATURES = ["employment_status", "home_ownership", "loan_purpose"]

# Known categories.
DOMAINS = {
    "gender": ["Male", "Female", "Other"],
    "marital_status": ["Single", "Married", "Divorced", "Widowed"],
    "education_level": ["High School", "Bachelor", "Master", "PhD"],
    "employment_status": ["Employed", "Self-Employed", "Unemployed"],
    "home_ownership": ["Own", "Rent", "Mortgage"],
    "loan_purpose": ["Home", "Auto", "Personal", "Education", "Business"],
    "transaction_type": ["Debit", "Credit"],
}
LOAN_TERMS = [12, 24, 36, 48, 60, 72]


def fields(schema: str) -> dict[str, str]:
    """Column names and type names of a layout."""
    return dict(part.split() for part in schema.split(","))


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` in order and type; NaN becomes null, absent columns are null."""
    present = dict(df.dtypes)

    def shaped(name: str, kind: str) -> Column:
        if name not in present:
            return F.lit(None).cast(kind).alias(name)
        column = F.col(name)
        if present[name] in ("double", "float"):
            column = F.nanvl(column, F.lit(None))
        return column.cast(kind).alias(name)

    return df.select(*[shaped(name, kind) for name, kind in fields(schema).items()])
