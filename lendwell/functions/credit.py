"""Lending features and scorecards as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendwell.functions.columns import at_least, below_bands, clamp, cut, flag, lookup, ratio

# Band edges and labels.
INCOME_EDGES = [30000, 60000, 100000]
INCOME_LABELS = ["Low", "Medium", "High", "Very High"]
AGE_EDGES = [0, 30, 40, 50, 60, 100]
AGE_LABELS = ["18-30", "31-40", "41-50", "51-60", "60+"]
SCORE_EDGES = [0, 600, 650, 700, 750, 850]
SCORE_LABELS = ["Poor", "Fair", "Good", "Very Good", "Excellent"]
AMOUNT_EDGES = [0, 25000, 50000, 100000, None]
AMOUNT_LABELS = ["Small", "Medium", "Large", "Very Large"]
RISK_EDGES = [30, 60]
RISK_LABELS = ["Low", "Medium", "High"]
RECOMMENDATIONS = {
    "Low": "Approve - Low risk of default",
    "Medium": "Review - Manual underwriting recommended",
    "High": "Reject - High risk of default",
}
EMPLOYMENT_CODES = {"Employed": 0, "Self-Employed": 1, "Unemployed": 2}
HOME_CODES = {"Own": 0, "Rent": 1, "Mortgage": 2}
# Lowest score of a tier, then its lowest and highest annual rate.
RATE_TIERS = [(750, 0.03, 0.06), (700, 0.06, 0.10), (650, 0.10, 0.15)]
RATE_FALLBACK = (0.15, 0.25)
HIGH_DTI = 0.43
# What the rule scorecard adds to a default probability, and its cap.
SCORECARD = {
    "base": 0.05,
    "score below 600": 0.3,
    "score below 700": 0.15,
    "dti above 0.43": 0.2,
    "dti above 0.35": 0.1,
    "unemployed": 0.25,
    "per delinquency": 0.1,
    "cap": 0.9,
}


def income_category(income: Column, include_lowest: bool = False) -> Column:
    return cut(income, [0, *INCOME_EDGES, None], INCOME_LABELS, include_lowest)


def employment_stability(age: Column, years_employed: Column, guarded: bool = True) -> Column:
    """Share of life spent employed, in percent; unguarded form is null for age 0."""
    return ratio(years_employed, at_least(age, 1) if guarded else age) * 100


def delinquency_penalised(delinquent: Column, utilization: Column) -> Column:
    return (1 - utilization) * 30 - delinquent * 20


def delinquency_score(delinquent: Column, utilization: Column) -> Column:
    return delinquent * 20 + (1 - utilization) * 30


def loan_to_income(amount: Column, income: Column, guarded: bool = True) -> Column:
    return ratio(amount, at_least(income, 1) if guarded else income)


def monthly_payment(principal: Column, annual_rate: Column, months: Column) -> Column:
    """Annuity payment; a zero rate spreads the principal evenly."""
    rate = annual_rate / 12
    growth = F.pow(1 + rate, months)
    return F.when(rate == 0, ratio(principal, months)).otherwise(
        principal * ratio(rate * growth, growth - 1)
    )


def debt_to_income(principal: Column, annual_rate: Column, months: Column, income: Column) -> Column:
    return ratio(monthly_payment(principal, annual_rate, months) * 12, at_least(income, 1))


def request_debt_to_income(
    principal: Column, annual_rate: Column, months: Column, income: Column
) -> Column:
    """Form used when scoring a request: no positive income gives 0."""
    yearly = monthly_payment(principal, annual_rate, months) * 12
    return F.when(income > 0, ratio(yearly, income)).otherwise(0.0)


def credit_age_score(years_history: Column, age: Column) -> Column:
    return ratio(years_history, at_least(age - 18, 1)) * 100


def debt_burden(total_debt: Column, income: Column) -> Column:
    return ratio(total_debt, at_least(income, 1))


def utilization_category(utilization: Column) -> Column:
    return (
        F.when(utilization < 0.3, "Excellent")
        .when(utilization < 0.5, "Good")
        .when(utilization < 0.7, "Fair")
        .when(utilization >= 0.7, "Poor")
        .otherwise("Unknown")
    )


def payment_consistency(count: Column, mean: Column, spread: Column) -> Column:
    """100 less half the coefficient of variation in percent, within 0 to 100.

    No history or a zero mean is neutral (50); a single payment is fully consistent.
    """
    return (
        F.when(F.coalesce(count, F.lit(0)) == 0, 50.0)
        .when(mean == 0, 50.0)
        .when(spread.isNull(), 100.0)
        .otherwise(clamp(100 - ratio(spread, mean) * 50, 0.0, 100.0))
    )


def interactions() -> dict[str, Column]:
    c = F.col
    return {
        "income_credit_interaction": c("annual_income") / 100000 * c("credit_score") / 850,
        "dti_utilization_risk": c("debt_to_income_ratio") * c("credit_utilization_ratio"),
        "mature_stable_employment": c("age") / 100 * c("employment_stability_score") / 100,
        "loan_affordability": c("loan_to_income_ratio") * (1 - c("debt_to_income_ratio")),
    }


def risk_flags() -> dict[str, Column]:
    """Five flags; the combined count leaves unemployment out."""
    c = F.col
    flags = {
        "high_dti_flag": flag(c("debt_to_income_ratio") > HIGH_DTI),
        "low_credit_flag": flag(c("credit_score") < 650),
        "high_utilization_flag": flag(c("credit_utilization_ratio") > 0.7),
        "has_delinquency_flag": flag(c("num_delinquent_accounts") > 0),
    }
    total = sum(flags.values(), F.lit(0))
    return {
        **flags,
        "unemployed_flag": flag(c("employment_status") == "Unemployed"),
        "multiple_risk_factors": total,
    }


def binned() -> dict[str, Column]:
    return {
        "age_group": cut(F.col("age"), AGE_EDGES, AGE_LABELS),
        "credit_tier": cut(F.col("credit_score"), SCORE_EDGES, SCORE_LABELS),
        "loan_size": cut(F.col("loan_amount"), AMOUNT_EDGES, AMOUNT_LABELS),
    }


def rate_tier(score: Column) -> dict[str, Column]:
    """Lowest, highest and middle annual rate of the score's tier."""

    def pick(values) -> Column:
        chain = F
        for floor, value in zip([t[0] for t in RATE_TIERS], values):
            chain = chain.when(score >= floor, value)
        return chain.otherwise(values[-1])

    tiers = [t[1:] for t in RATE_TIERS] + [RATE_FALLBACK]
    return {
        "rate_low": pick([low for low, _ in tiers]),
        "rate_high": pick([high for _, high in tiers]),
        "rate_mid": pick([round((low + high) / 2, 4) for low, high in tiers]),
    }


def rule_scorecard(score: Column, dti: Column, employment: Column, delinquent: Column) -> Column:
    """Rule-based default probability, at most 0.9; unknown inputs add nothing."""
    add = SCORECARD
    by_score = F.when(score < 600, add["score below 600"]).when(score < 700, add["score below 700"])
    by_dti = F.when(dti > HIGH_DTI, add["dti above 0.43"]).when(dti > 0.35, add["dti above 0.35"])
    by_work = F.when(employment == "Unemployed", add["unemployed"])
    by_delinquency = F.coalesce(delinquent, F.lit(0)) * add["per delinquency"]
    total = (
        F.lit(add["base"]) + by_score.otherwise(0.0) + by_dti.otherwise(0.0) + by_work.otherwise(0.0) + by_delinquency
    )
    return F.least(total, F.lit(add["cap"]))


def base_credit_score(income: Column, years_employed: Column) -> Column:
    return clamp(600 + income / 1000 + years_employed * 2, 300.0, 850.0)


def risk_category(score: Column) -> Column:
    """Left-closed categories on the 0-100 score; null stays null."""
    return F.when(score.isNotNull(), below_bands(score, RISK_EDGES, RISK_LABELS))


def risk_category_right_closed(score: Column) -> Column:
    """Batch-job variant: (0,30], (30,60], (60,100]; exactly 0 has no category."""
    return cut(score, [0, *RISK_EDGES, 100], RISK_LABELS)


def recommendation(score: Column) -> Column:
    category = risk_category(score)
    chain = F
    for label, text in RECOMMENDATIONS.items():
        chain = chain.when(category == label, text)
    return chain


def request_encodings() -> dict[str, Column]:
    return {
        "employment_status_encoded": lookup(F.col("employment_status"), EMPLOYMENT_CODES),
        "home_ownership_encoded": lookup(F.col("home_ownership"), HOME_CODES),
    }


def key_factors() -> dict[str, Column]:
    """Labels beside the four headline ratios of an assessment."""

    def verdict(good: Column, otherwise: str) -> Column:
        return F.when(good, "Good").otherwise(otherwise)

    return {
        "dti_label": verdict(F.col("debt_to_income_ratio") < HIGH_DTI, "High"),
        "utilization_label": verdict(F.col("credit_utilization_ratio") < 0.3, "High"),
        "loan_to_income_label": verdict(F.col("loan_to_income_ratio") < 3, "High"),
        "stability_label": verdict(F.col("employment_stability_score") > 10, "Low"),
    }
