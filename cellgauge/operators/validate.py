"""Validation rules compiled to one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions import texts
from cellgauge.functions.columns import is_missing
from cellgauge.sources import schema as S

ERROR, WARNING = "error", "warning"

# Least rows of each stage.
MIN_PROCESSED_ROWS = 10
MIN_TRAIN_ROWS = 5
MIN_TEST_ROWS = 2
MIN_SEGMENT_ROWS = 3
MIN_MODEL_ROWS = 5


@dataclass(frozen=True)
class Rule:
    """`broken` is true for a bad row; NULL counts as not broken."""

    name: str
    column: str
    severity: str
    broken: Column
    message: str


def null_rules(display: dict[str, str] = S.DISPLAY_NAMES) -> list[Rule]:
    return [
        Rule(
            f"{c}_missing", c, WARNING, F.col(c).isNull(), texts.MSG_NULLS.format(name=display[c])
        )
        for c in display
    ]


def range_rules(allowed_locations: Sequence[str] = texts.KNOWN_LOCATIONS) -> list[Rule]:
    signal, traffic = F.col(S.SIGNAL), F.col(S.TRAFFIC)
    return [
        Rule("signal_range", S.SIGNAL, ERROR, (signal > 0) | (signal < -150), texts.MSG_SIGNAL),
        Rule("traffic_range", S.TRAFFIC, ERROR, traffic < 0, texts.MSG_TRAFFIC),
        Rule("latency_range", S.LATENCY, ERROR, F.col(S.LATENCY) <= 0, texts.MSG_LATENCY),
        Rule("users_range", S.USERS, ERROR, F.col(S.USERS) < 0, texts.MSG_USERS),
        Rule(
            "device_domain",
            S.DEVICE,
            WARNING,
            ~F.col(S.DEVICE).isin(texts.KNOWN_DEVICES),
            texts.MSG_DEVICE,
        ),
        Rule(
            "location_domain",
            S.LOCATION,
            ERROR,
            ~F.col(S.LOCATION).isin(list(allowed_locations)),
            texts.MSG_LOCATION,
        ),
    ]


def _report_row(rule: str, column: str, severity: str, n: Column, message: str) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(column).alias("column_name"),
        F.lit(severity).alias("severity"),
        n.cast("bigint").alias("n_bad"),
        F.when(n > 0, F.format_string(message, n)).alias("message"),
    )


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule; all rules are counted in a single pass."""
    rows = [
        _report_row(r.name, r.column, r.severity, F.count_if(r.broken), r.message) for r in rules
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column."""
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_null"))
        for c in columns or df.columns
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def duplicate_keys(df: DataFrame, key: str = S.KEY) -> DataFrame:
    """Rows beyond the first of each key; NULL is one key."""
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"),
            F.count_if(F.col("n") > 1).alias("n_repeated_keys"),
        )
    )


def invalid_categories(
    df: DataFrame, column: str = S.DEVICE, allowed: Sequence[str] = texts.KNOWN_DEVICES
) -> DataFrame:
    """Values outside the domain with their row counts."""
    return (
        df.filter(~F.col(column).isin(list(allowed)))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .select(F.lit(column).alias("column_name"), "value", "n")
    )


def validation_report(
    df: DataFrame,
    key: str = S.KEY,
    allowed_locations: Sequence[str] = texts.KNOWN_LOCATIONS,
) -> DataFrame:
    """All rules and the duplicate check, one row each."""
    counted = rule_counts(df, [*null_rules(), *range_rules(allowed_locations)])
    repeated = duplicate_keys(df, key).select(
        F.inline(
            F.array(
                _report_row(
                    "duplicate_key", key, ERROR, F.col("n_duplicates"), texts.MSG_DUPLICATES
                )
            )
        )
    )
    return counted.unionByName(repeated)


def validation_verdict(report: DataFrame) -> DataFrame:
    """Errors make a table invalid, warnings do not."""
    bad = F.col("n_bad") > 0
    return report.agg(
        F.bool_and(~(bad & (F.col("severity") == ERROR))).alias("is_valid"),
        F.count_if(bad & (F.col("severity") == ERROR)).alias("n_errors"),
        F.count_if(bad & (F.col("severity") == WARNING)).alias("n_warnings"),
    )


def violating_rows(df: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Rows that break at least one rule, with the names of the broken rules."""
    rules = rules or [r for r in range_rules() if r.severity == ERROR]
    broken = reduce(lambda a, b: a | b, [F.coalesce(r.broken, F.lit(False)) for r in rules])
    names = F.array_compact(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules]))
    return df.filter(broken).withColumn("violations", names)


def check_model_input(
    df: DataFrame, numeric: Sequence[str], target: str | None = None, min_rows: int = 1
) -> int:
    """Raise ValueError on an empty table or a missing number; returns the row count."""
    columns = [*numeric, *([target] if target else [])]
    row = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(is_missing(F.col(c).cast("double"))).alias(c) for c in columns],
    ).first()
    check_counts(row["n"], {c: row[c] for c in columns}, min_rows)
    return row["n"]


def check_counts(rows: int, missing: Mapping[str, int], min_rows: int = 1) -> None:
    """The errors of `check_model_input` where rows and missing numbers are counted already."""
    if rows == 0:
        raise ValueError("Input is empty")
    if rows < min_rows:
        raise ValueError(f"too few rows: {rows} of at least {min_rows}")
    columns = [c for c, n in missing.items() if n > 0]
    if columns:
        raise ValueError(f"Missing values in: {columns}")


def sample_sufficiency(
    df: DataFrame, group: str = "segment", split: str = "split", least: int = MIN_SEGMENT_ROWS
) -> DataFrame:
    """Rows per segment and split against the least number of rows."""
    return (
        df.groupBy(group, split)
        .agg(F.count("*").alias("n"))
        .withColumn(
            "status", F.when(F.col("n") >= least, "sufficient").otherwise("limited")
        )
    )
