"""Data-quality checks.

Row-level rules of one table, whatever check they belong to, are counted together in
one aggregate pass and then turned into rows. A check frame has the columns ``check``,
``subject``, ``status`` (pass, warning or fail), ``bad`` (rows, keys or messages found)
and ``messages``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from lendwell.functions.columns import ratio, rounded
from lendwell.operators.skew import spread_join
from lendwell.schemas import DOMAINS, LOAN_TERMS
from lendwell.session import day

# Limits and wording of the standard rules.
RANGES = {
    "customers": {"age": {"min": 18, "max": 100}, "annual_income": {"min": 0}},
    "credit_history": {
        "credit_score": {"min": 300, "max": 850},
        "credit_utilization_ratio": {"min": 0, "max": 1},
    },
}
RELATIONS = ["customers -> credit_history", "customers -> transactions", "customers -> loans"]
OUTLIER_SIGMAS = 3
OUTLIER_SHARE = 5


@dataclass(frozen=True)
class Rule:
    """A named condition that marks a row as bad; ``text`` follows the bad-row count."""

    name: str
    bad: Column
    text: str
    needs: tuple[str, ...]
    check: str = "business_rules"


def business_rules(table: str) -> list[Rule]:
    c = F.col
    # Limits and wording.
    rules = {
        "customers": [
            Rule("age", (c("age") < 18) | (c("age") > 100), "customers with invalid age", ("age",)),
            Rule("annual_income", c("annual_income") <= 0,
                 "customers with non-positive income", ("annual_income",)),
        ],
        "credit_history": [
            Rule("credit_score", (c("credit_score") < 300) | (c("credit_score") > 850),
                 "records with invalid credit score", ("credit_score",)),
            Rule("credit_utilization_ratio",
                 (c("credit_utilization_ratio") < 0) | (c("credit_utilization_ratio") > 1),
                 "records with invalid credit utilization", ("credit_utilization_ratio",)),
        ],
        "loan_applications": [
            Rule("loan_amount", c("loan_amount") <= 0, "loans with non-positive amount", ("loan_amount",)),
            Rule("interest_rate", (c("interest_rate") <= 0) | (c("interest_rate") > 0.5),
                 "loans with invalid interest rate", ("interest_rate",)),
        ],
    }
    return rules.get(table, [])


def documented_rules(table: str, as_of: dt.date | None = None) -> list[Rule]:
    """Rules the data dictionary states beyond the standard ones."""
    c = F.col

    def unknown(column: str) -> Rule:
        return Rule(f"{column}_domain", ~c(column).isin(DOMAINS[column]), "unknown values", (column,))

    def missing(column: str) -> Rule:
        return Rule(f"{column}_missing", c(column).isNull(), "missing values", (column,))

    rules = {
        "customers": [
            missing("customer_id"),
            Rule("years_employed", c("years_employed") > c("age") - 18,
                 "employed before 18", ("years_employed", "age")),
            *[unknown(k) for k in ("gender", "marital_status", "education_level",
                                   "employment_status", "home_ownership")],
        ],
        "credit_history": [
            missing("customer_id"),
            missing("credit_score"),
            Rule("total_debt", c("total_debt") < 0, "negative debts", ("total_debt",)),
            Rule("years_credit_history", c("years_credit_history") > c("age") - 18,
                 "histories begun before 18", ("years_credit_history", "age")),
        ],
        "transactions": [
            missing("customer_id"),
            Rule("transaction_amount", c("transaction_amount") <= 0,
                 "non-positive amounts", ("transaction_amount",)),
            Rule("transaction_date", c("transaction_date") > day(as_of),
                 "dates in the future", ("transaction_date",)),
            unknown("transaction_type"),
        ],
        "loan_applications": [
            missing("customer_id"),
            missing("loan_amount"),
            Rule("loan_term_months", ~c("loan_term_months").isin(LOAN_TERMS),
                 "unknown terms", ("loan_term_months",)),
            Rule("days_past_due", c("days_past_due") < 0, "negative days past due", ("days_past_due",)),
            Rule("debt_to_income_ratio",
                 (c("debt_to_income_ratio") < 0) | (c("debt_to_income_ratio") > 1),
                 "ratios outside 0 to 1", ("debt_to_income_ratio",)),
            unknown("loan_purpose"),
        ],
    }
    return rules[table]


def with_owner_age(credit: DataFrame, customers: DataFrame, **spread) -> DataFrame:
    """Credit records beside the age of their customer, for rules that compare the two."""
    ages = customers.select("customer_id", "age")
    return spread_join(credit, [ages], "customer_id", "credit_id", **spread)


def missing_rules(df: DataFrame) -> list[Rule]:
    return [Rule(c, F.col(c).isNull(), "missing", (c,), "missing_values") for c in df.columns]


def range_rules(specs: dict[str, dict[str, float]]) -> list[Rule]:
    """Rules for the ``min`` and ``max`` of each column; nulls do not violate."""
    rules = []
    for column, limits in specs.items():
        if "min" in limits:
            text = f"{column} values below minimum {limits['min']}"
            rules.append(Rule(f"{column}_min", F.col(column) < limits["min"], text, (column,), "value_ranges"))
        if "max" in limits:
            text = f"{column} values above maximum {limits['max']}"
            rules.append(Rule(f"{column}_max", F.col(column) > limits["max"], text, (column,), "value_ranges"))
    return rules


def applicable(df: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    return [r for r in rules if set(r.needs) <= set(df.columns)]


def count_rules(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule whose columns exist: table_name, rule, bad_rows, total_rows, text."""
    rows = [
        F.struct(F.lit(r.name).alias("rule"), F.count_if(r.bad).alias("bad_rows"), F.lit(r.text).alias("text"))
        for r in applicable(df, rules)
    ]
    counted = df.agg(F.count(F.lit(1)).alias("total_rows"), F.array(*rows).alias("rules"))
    return counted.select(F.lit(table).alias("table_name"), "total_rows", F.inline("rules"))


def as_check(name: str, subject: Column, status: Column, bad: Column, messages: Column) -> list[Column]:
    return [
        F.lit(name).alias("check"),
        subject.alias("subject"),
        status.alias("status"),
        bad.cast("bigint").alias("bad"),
        messages.alias("messages"),
    ]


def row_checks(
    df: DataFrame, table: str, checks: Sequence[str], rules: Sequence[Rule],
    threshold: float = 0.3, strict: bool = False,
) -> DataFrame:
    """One check row per name in ``checks`` from a single pass over the table.

    A check with a broken rule is a warning. With ``strict``, a share of missing
    values above the threshold is a failure.
    """
    rules = applicable(df, rules)
    counted = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(r.bad).alias(f"rule_{i}") for i, r in enumerate(rules)]
    )
    return checks_of_counts(counted, table, checks, rules, threshold, strict)


def checks_of_counts(
    counted: DataFrame, table: str, checks: Sequence[str], rules: Sequence[Rule],
    threshold: float = 0.3, strict: bool = False,
) -> DataFrame:
    """Check rows from one row of counts: ``total`` rows, and the bad rows ``rule_<i>`` of every rule."""

    def message(i: int, rule: Rule) -> Column:
        bad = F.col(f"rule_{i}")
        if rule.check == "missing_values":
            share = ratio(bad, F.col("total"))
            text = F.format_string(f"{rule.name} has %.2f%% missing values", share * 100)
            limit = F.when(share > threshold, f" (threshold: {threshold:.2%})").otherwise("")
            return F.when(bad > 0, F.concat(text, limit))
        return F.when(bad > 0, F.concat_ws(" ", bad.cast("string"), F.lit(rule.text)))

    def check_row(name: str) -> Column:
        own = [(i, r) for i, r in enumerate(rules) if r.check == name]
        texts = F.array(*[message(i, r) for i, r in own]).cast("array<string>")
        hits = F.array_sort(F.filter(texts, lambda text: text.isNotNull()))
        status = F.when(F.size(hits) > 0, "warning").otherwise("pass")
        if strict and name == "missing_values":
            for i, _ in own:
                status = F.when(ratio(F.col(f"rule_{i}"), F.col("total")) > threshold, "fail").otherwise(status)
        return F.struct(*as_check(name, F.lit(table), status, F.size(hits), F.array_join(hits, "; ")))

    return counted.select(F.inline(F.array(*[check_row(name) for name in checks])))


def missing_values(df: DataFrame, table: str, threshold: float = 0.3) -> DataFrame:
    """Columns with missing values: share of rows, and error above the threshold."""
    share = ratio(F.col("bad_rows"), F.col("total_rows"))
    return (
        count_rules(df, table, missing_rules(df))
        .filter(F.col("bad_rows") > 0)
        .select(
            "table_name",
            F.col("rule").alias("column_name"),
            F.col("bad_rows").alias("missing_rows"),
            "total_rows",
            share.alias("missing_share"),
            F.when(share > threshold, "error").otherwise("warning").alias("level"),
        )
    )


def check_missing_values(
    df: DataFrame, table: str, threshold: float = 0.3, strict: bool = False
) -> DataFrame:
    return row_checks(df, table, ["missing_values"], missing_rules(df), threshold, strict)


def check_value_ranges(df: DataFrame, table: str, specs: dict[str, dict[str, float]]) -> DataFrame:
    return row_checks(df, table, ["value_ranges"], range_rules(specs))


def check_business_rules(df: DataFrame, table: str) -> DataFrame:
    return row_checks(df, table, ["business_rules"], business_rules(table))


def duplicates(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows that share their key with another row; null keys count as equal."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(F.lit(0)))
    bad = F.coalesce(total, F.lit(0))
    text = F.concat(F.lit(f"{table} has "), F.col("bad"), F.lit(" duplicate records"))
    return groups.agg(bad.alias("bad")).select(
        *as_check("duplicates", F.lit(table), F.when(F.col("bad") > 0, "fail").otherwise("pass"),
                  F.col("bad"), F.when(F.col("bad") > 0, text).otherwise(""))
    )


def data_types(df: DataFrame, table: str, expected: dict[str, str]) -> DataFrame:
    """Compare declared column types by simple name; reads the schema, not the rows."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [
        f"{table}.{name}: expected {kind}, got {actual[name]}"
        for name, kind in expected.items()
        if name in actual and actual[name] != kind
    ]
    row = ("data_types", table, "warning" if wrong else "pass", len(wrong), "; ".join(wrong))
    return df.sparkSession.createDataFrame(
        [row], "check string, subject string, status string, bad bigint, messages string"
    )


def unreadable_values(df: DataFrame, table: str, expected: dict[str, str]) -> DataFrame:
    """Per column: declared and expected type, and values that cannot be read as expected.

    Serves tables that arrive as text, where the declared type says little.
    """
    declared = dict(df.dtypes)
    present = {name: kind for name, kind in expected.items() if name in declared}
    rules = [
        Rule(name, F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull(), kind, (name,), "data_types")
        for name, kind in present.items()
    ]
    actual = F.create_map(*[F.lit(v) for name in present for v in (name, declared[name])])
    return count_rules(df, table, rules).select(
        "table_name",
        F.col("rule").alias("column_name"),
        F.element_at(actual, F.col("rule")).alias("actual_type"),
        F.col("text").alias("expected_type"),
        F.col("bad_rows").alias("unreadable_rows"),
        "total_rows",
    )


def orphan_keys(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Distinct child keys without a parent; a null key is an orphan unless a parent has one."""
    keys = child.select(F.col(child_key).alias("orphan_key")).distinct()
    known = parent.select(F.col(parent_key).alias("known_key")).distinct()
    return keys.join(known, F.col("orphan_key").eqNullSafe(F.col("known_key")), "left_anti")


def referential_integrity(
    parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, relation: str
) -> DataFrame:
    bad = orphan_keys(parent, child, parent_key, child_key).agg(F.count(F.lit(1)).alias("bad"))
    text = F.concat(F.lit(f"{relation}: "), F.col("bad"), F.lit(" orphaned records found"))
    return bad.select(
        *as_check("referential_integrity", F.lit(relation),
                  F.when(F.col("bad") > 0, "fail").otherwise("pass"), F.col("bad"),
                  F.when(F.col("bad") > 0, text).otherwise(""))
    )


def key_checks(
    parent: DataFrame, children: dict[str, tuple[str, DataFrame]], key: str, parent_name: str,
    unique: Sequence[str],
) -> DataFrame:
    """Duplicate and integrity checks of a parent and its children, from one grouping by key.

    ``children`` maps a relation's name to its table's name and frame; ``unique`` names the tables in
    which the key must not repeat. Each table is read once.
    """
    tables = [(parent_name, parent), *children.values()]
    keys = reduce(
        DataFrame.unionByName,
        [df.select(F.col(key).alias("key"), F.lit(i).alias("source")) for i, (_, df) in enumerate(tables)],
    )
    names = [name for name, _ in tables]
    per_key = keys.groupBy("key").agg(*[F.count_if(F.col("source") == i).alias(f"n{i}") for i in range(len(tables))])
    return checks_of_keys(per_key, names, list(children), unique)


def checks_of_keys(per_key: DataFrame, names: Sequence[str], relations: Sequence[str], unique: Sequence[str]) -> DataFrame:
    """Check rows from one row per key with the number ``n<i>`` of its rows in every table, the parent first."""
    repeated = {
        name: F.coalesce(F.sum(F.when(F.col(f"n{i}") > 1, F.col(f"n{i}"))), F.lit(0)).alias(f"repeated_{i}")
        for i, name in enumerate(names)
        if name in unique
    }
    orphans = [F.count_if((F.col(f"n{i}") > 0) & (F.col("n0") == 0)).alias(f"orphans_{i}") for i in range(1, len(names))]
    found = per_key.agg(*repeated.values(), *orphans)

    def row(check: str, subject: str, column: str, text: Column) -> Column:
        bad = F.col(column)
        status = F.when(bad > 0, "fail").otherwise("pass")
        return F.struct(*as_check(check, F.lit(subject), status, bad, F.when(bad > 0, text).otherwise("")))

    rows = [
        row("duplicates", name, f"repeated_{names.index(name)}",
            F.concat(F.lit(f"{name} has "), F.col(f"repeated_{names.index(name)}"), F.lit(" duplicate records")))
        for name in repeated
    ] + [
        row("referential_integrity", relation, f"orphans_{i}",
            F.concat(F.lit(f"{relation}: "), F.col(f"orphans_{i}"), F.lit(" orphaned records found")))
        for i, relation in enumerate(relations, 1)
    ]
    return found.select(F.inline(F.array(*rows)))


def outlier_counts(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Rows more than three sample deviations from the mean, per numeric column.

    The one-row statistics enter the second pass as scalar subqueries.
    """
    numeric = {"int", "bigint", "double", "float"}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = [c for c in columns if types.get(c) in numeric]
    stats = df.agg(
        F.struct(
            *[
                F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("spread")).alias(c)
                for c in columns
            ]
        ).alias("stats")
    )
    together = stats.scalar()
    marked = df.select(*columns, together.alias("stats"))
    rules = [
        Rule(c, F.abs(ratio(F.col(c) - F.col(f"stats.{c}.mean"), F.col(f"stats.{c}.spread"))) > OUTLIER_SIGMAS,
             "outliers", (c,))
        for c in columns
    ]
    return count_rules(marked, table, rules)


def check_anomalies(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Warn about columns where outliers exceed five percent of the rows."""
    return anomaly_check(outlier_counts(df, table, columns))


def anomaly_check(counts: DataFrame) -> DataFrame:
    """The check row of a table's outlier counts."""
    percent = ratio(F.col("bad_rows"), F.col("total_rows")) * 100
    text = F.format_string("%s: %d outliers (%.2f%%)", "rule", "bad_rows", percent)
    # One row per column of the table.
    found = counts.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.when(percent > OUTLIER_SHARE, text))).alias("hits")
    )
    return found.select(
        *as_check("statistical_anomalies", F.col("table_name"),
                  F.when(F.size("hits") > 0, "warning").otherwise("pass"), F.size("hits"),
                  F.array_join("hits", "; "))
    )


def with_anomaly_check(counts: DataFrame) -> DataFrame:
    """Outlier counts beside the status and messages of their table's check, from one grouping."""
    percent = ratio(F.col("bad_rows"), F.col("total_rows")) * 100
    text = F.format_string("%s: %d outliers (%.2f%%)", "rule", "bad_rows", percent)
    rest = [c for c in counts.columns if c != "table_name"]
    # One row per column of the table.
    return (
        counts.groupBy("table_name")
        .agg(
            F.array_sort(F.collect_list(F.when(percent > OUTLIER_SHARE, text))).alias("hits"),
            F.collect_list(F.struct(*rest)).alias("columns"),
        )
        .select(
            "table_name",
            F.inline("columns"),
            F.when(F.size("hits") > 0, "warning").otherwise("pass").alias("status"),
            F.array_join("hits", "; ").alias("messages"),
        )
    )


def freshness(
    df: DataFrame, table: str, date_column: str, as_of: dt.date | None = None, max_age_days: int = 7
) -> DataFrame:
    """Whole days between the newest row and the reporting date; older than allowed warns."""
    if date_column not in df.columns:
        row = (table, None, None, max_age_days, "pass")
        return df.sparkSession.createDataFrame(
            [row], "table_name string, newest timestamp_ntz, age_days int, max_age_days int, status string"
        )
    raw = F.col(date_column)
    if isinstance(df.schema[date_column].dataType, DateType):
        stamp = raw.cast("timestamp_ntz")
    else:
        stamp = F.expr(f"try_cast({date_column} AS timestamp_ntz)")
    newest = df.agg(F.max(stamp).alias("newest"))
    # Difference of clock times, so that the session's zone plays no part.
    micros = F.timestamp_diff("MICROSECOND", F.col("newest"), day(as_of).cast("timestamp_ntz"))
    age = F.floor(micros / 86_400_000_000).cast("int")
    return newest.select(
        F.lit(table).alias("table_name"),
        "newest",
        age.alias("age_days"),
        F.lit(max_age_days).alias("max_age_days"),
        F.when(age > max_age_days, "warning").otherwise("pass").alias("status"),
    )


def check_freshness(
    df: DataFrame, table: str, date_column: str, as_of: dt.date | None = None, max_age_days: int = 7
) -> DataFrame:
    found = freshness(df, table, date_column, as_of, max_age_days)
    text = F.format_string(
        "%s: Data is %d days old (threshold: %d)", "table_name", "age_days", "max_age_days"
    )
    late = F.col("status") == "warning"
    return found.select(
        *as_check("data_freshness", F.col("table_name"), F.col("status"), F.col("age_days"),
                  F.when(late, text).otherwise(""))
    )


def latest_timestamps(
    customers: DataFrame, credit: DataFrame, transactions: DataFrame, loans: DataFrame
) -> DataFrame:
    """One row with the newest created_at of each staging table."""
    names = ["latest_customer", "latest_credit", "latest_transaction", "latest_loan"]
    parts = [
        df.agg(F.max("created_at").alias("newest")).withColumn("source", F.lit(name))
        for name, df in zip(names, (customers, credit, transactions, loans))
    ]
    newest = reduce(DataFrame.unionByName, parts)
    return newest.agg(
        *[F.max(F.when(F.col("source") == name, F.col("newest"))).alias(name) for name in names]
    )


def standard_rules(table: str, columns: DataFrame) -> tuple[list[str], list[Rule]]:
    """Names of a table's row checks in the suite, and their rules; ``columns`` is any frame with its columns."""
    rules = missing_rules(columns) + range_rules(RANGES.get(table, {})) + business_rules(table)
    names = ["missing_values", *(["value_ranges"] if table in RANGES else []), "business_rules"]
    return names, applicable(columns, rules)


def suite(
    customers: DataFrame, credit: DataFrame, transactions: DataFrame, loans: DataFrame,
    threshold: float = 0.1, strict: bool = False,
) -> DataFrame:
    """The thirteen standard checks over the four staging tables."""
    key = "customer_id"

    def rows_of(df: DataFrame, table: str) -> DataFrame:
        return row_checks(df, table, *standard_rules(table, df), threshold, strict)

    checks = [
        rows_of(customers, "customers"),
        rows_of(credit, "credit_history"),
        rows_of(loans, "loan_applications"),
        key_checks(
            customers,
            dict(zip(RELATIONS, (
                ("credit_history", credit), ("transactions", transactions), ("loan_applications", loans),
            ))),
            key, "customers", ("customers", "credit_history"),
        ),
    ]
    return reduce(DataFrame.unionByName, checks)


def summary(checks: DataFrame) -> DataFrame:
    """Totals by status and the share of passes as text."""
    counted = checks.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
        F.count_if(F.col("status") == "fail").alias("failures"),
    )
    percent = F.format_string("%.2f%%", ratio(F.col("passed"), F.col("total_checks")) * 100)
    return counted.withColumn(
        "success_rate", F.when(F.col("total_checks") > 0, percent).otherwise("0%")
    )


class DataQualityError(ValueError):
    """Raised by the gate when a check failed."""


def gate(checks: DataFrame) -> dict:
    """Return the summary row, or raise when any check has failed."""
    row = summary(checks).first().asDict()
    if row["failures"] > 0:
        raise DataQualityError(f"Data quality checks failed: {row['failures']} failures")
    return row


def impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Fill gaps with the mean (to cents) or the most frequent value, smallest on a tie.

    Value counts are aggregated per column first; only one row of fill values is read.
    """
    means = df.agg(F.struct(*[rounded(F.avg(c), 2).alias(c) for c in numeric]).alias("m")).scalar()
    values = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in categorical]))
    ).filter(F.col("value").isNotNull())
    counts = values.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy("name").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")
    )
    picked = modes.agg(
        F.struct(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in categorical]).alias("m")
    ).scalar()
    return (
        df.withColumns({"_means": means, "_modes": picked})
        .withColumns(
            {c: F.coalesce(F.col(c), F.col(f"_means.{c}")) for c in numeric}
            | {c: F.coalesce(F.col(c), F.col(f"_modes.{c}")) for c in categorical}
        )
        .drop("_means", "_modes")
    )
