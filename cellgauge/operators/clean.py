"""Imputation, outlier capping and casting.

Table statistics are fitted first and kept as a few numbers. Applying them is one
narrow projection.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgauge.functions import texts
from cellgauge.operators.quantiles import (
    GROUP_LIMIT,
    approximate_quantiles,
    interpolated,
    quantile_name,
    quantiles,
    rank_pair,
    rank_probability,
)
from cellgauge.sources import schema as S


@dataclass(frozen=True)
class Fence:
    q1: float
    q3: float

    @property
    def iqr(self) -> float:
        return self.q3 - self.q1

    @property
    def lower(self) -> float:
        return self.q1 - 1.5 * self.iqr

    @property
    def upper(self) -> float:
        return self.q3 + 1.5 * self.iqr


_QUARTILES = (0.25, 0.75)


@dataclass(frozen=True)
class CleaningStats:
    """What cleaning learns from a table."""

    medians: Mapping[str, float | None] = field(default_factory=dict)
    modes: Mapping[str, str] = field(default_factory=dict)
    fences: Mapping[str, Fence] = field(default_factory=dict)


def fit_medians(
    df: DataFrame,
    columns: Sequence[str] = S.NUMERIC_FEATURES,
    exact: bool = True,
    rows: int | None = None,
) -> dict[str, float | None]:
    """Median of each column; None when the column is all null."""
    find = quantiles if exact else approximate_quantiles
    row = find(df, {c: [0.5] for c in columns}, rows=rows).first()
    found = {c: row[quantile_name(c)] for c in columns}
    return {c: None if v is None else v[0] for c, v in found.items()}


def fit_group_medians(
    df: DataFrame, by: str, columns: Sequence[str], most: int
) -> dict[str, dict[str, float | None]]:
    """`fit_medians` of each group of a few; `most` is the number of rows of the largest."""
    limit = GROUP_LIMIT if most <= GROUP_LIMIT else 0
    found = quantiles(df, {c: [0.5] for c in columns}, [by], limit, most).collect()
    names = {c: quantile_name(c) for c in columns}
    return {r[by]: {c: None if r[q] is None else r[q][0] for c, q in names.items()} for r in found}


def fit_mode(df: DataFrame, column: str = S.DEVICE) -> str:
    """Most frequent value, the smallest one on a tie, 'Unknown' when all are null."""
    top = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
        .first()
    )
    return top[column] if top else texts.UNKNOWN


def fit_fences(
    df: DataFrame,
    columns: Sequence[str] = S.NUMERIC_COLUMNS,
    exact: bool = True,
    rows: int | None = None,
) -> dict[str, Fence]:
    """Quartile fences of each column that has values."""
    find = quantiles if exact else approximate_quantiles
    row = find(df, {c: [0.25, 0.75] for c in columns}, rows=rows).first()
    found = {c: row[quantile_name(c)] for c in columns}
    return {c: Fence(*map(float, q)) for c, q in found.items() if q}


def impute(
    df: DataFrame,
    medians: Mapping[str, float | None] | None = None,
    fills: Mapping[str, str] | None = None,
) -> DataFrame:
    """Fill nulls of numbers with their median and of categories with the given text."""
    columns = {}
    for c, median in (medians or {}).items():
        if median is not None:
            columns[c] = F.coalesce(F.col(c).cast("double"), F.lit(float(median)))
    for c, value in (fills or {}).items():
        columns[c] = F.coalesce(F.col(c), F.lit(value))
    return df.withColumns(columns) if columns else df


def cap_outliers(df: DataFrame, fences: Mapping[str, Fence]) -> DataFrame:
    """Pull values outside the fences onto them; nulls stay, no row leaves."""
    capped = {}
    for c, fence in fences.items():
        x = F.col(c).cast("double")
        capped[c] = (
            F.when(x < fence.lower, F.lit(fence.lower))
            .when(x > fence.upper, F.lit(fence.upper))
            .otherwise(x)
        )
    return df.withColumns(capped) if capped else df


def outlier_counts(df: DataFrame, fences: Mapping[str, Fence]) -> DataFrame:
    """Values strictly outside the fences, one row per column."""
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count_if((F.col(c) < f.lower) | (F.col(c) > f.upper)).alias("n_outliers"),
        )
        for c, f in fences.items()
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def convert_types(df: DataFrame, schema: T.StructType = S.CONTRACT) -> DataFrame:
    """Cast to the contract types; integers are rounded half to even first."""
    casts = {}
    for f in schema:
        if f.name not in df.columns or df.schema[f.name].dataType == f.dataType:
            continue
        if isinstance(f.dataType, T.IntegerType):
            casts[f.name] = F.bround(F.col(f.name).try_cast("double")).try_cast("int")
        else:
            casts[f.name] = F.col(f.name).try_cast(f.dataType)
    return df.withColumns(casts) if casts else df


def drop_null_target(df: DataFrame, target: str = S.LATENCY) -> DataFrame:
    return df.dropna(subset=[target])


def imputed(df: DataFrame, stats: CleaningStats) -> DataFrame:
    """Medians, mode of the device and 'Unknown' for the location."""
    return impute(df, stats.medians, {**stats.modes, S.LOCATION: texts.UNKNOWN})


def fit_cleaning(df: DataFrame, exact: bool = True) -> CleaningStats:
    """Learn medians and mode, and the fences of the imputed table, from one narrowing.

    Filling k nulls puts k copies of the median m among the ordered values. The value at
    rank r of the result is then the middle one of m and the raw values at ranks r - k
    and r, so the fences of the imputed table need order statistics of the raw one only.
    The target is not imputed: its fences come from the values it has.
    """
    rows, present, mode = _counts(df)
    nulls = {c: rows - n if c in S.NUMERIC_FEATURES else 0 for c, n in present.items()}
    filled = {c: n for c, n in present.items() if n}
    ranks = {c: _raw_ranks(n, nulls[c]) for c, n in filled.items()}
    probs = {c: [rank_probability(r, filled[c]) for r in wanted] for c, wanted in ranks.items()}
    find = quantiles if exact else approximate_quantiles
    row = find(df, probs, rows=rows).first() if probs else {}

    medians: dict[str, float | None] = dict.fromkeys(S.NUMERIC_FEATURES)
    fences = {}
    for c, n in filled.items():
        raw = dict(zip(ranks[c], map(float, row[quantile_name(c)]), strict=True))
        middle = interpolated(raw, n, 0.5)
        if c in medians:
            medians[c] = middle
        k = nulls[c]
        merged = {
            r: sorted((raw.get(r - k, -math.inf), middle, raw.get(r, math.inf)))[1]
            for p in _QUARTILES
            for r in rank_pair(n + k, p)
        }
        fences[c] = Fence(*(interpolated(merged, n + k, p) for p in _QUARTILES))
    return CleaningStats(medians, {S.DEVICE: mode}, fences)


def _counts(df: DataFrame) -> tuple[int, dict[str, int], str]:
    """Rows, values of each number, and the most frequent device, in one pass."""
    per_device = df.groupBy(S.DEVICE).agg(
        F.count("*").alias("_rows"), *[F.count(c).alias(f"_n_{c}") for c in S.NUMERIC_COLUMNS]
    )
    ordered = F.struct((-F.col("_rows")).alias("n"), F.col(S.DEVICE).alias("value"))
    row = per_device.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per_device.columns if c != S.DEVICE],
        F.min(F.when(F.col(S.DEVICE).isNotNull(), ordered)).alias("_top"),
    ).first()
    mode = row["_top"]["value"] if row["_top"] else texts.UNKNOWN
    return row["_rows"], {c: row[f"_n_{c}"] for c in S.NUMERIC_COLUMNS}, mode


def _raw_ranks(n: int, k: int) -> list[int]:
    """Ranks among n raw values that settle the median, and the quartiles after k fills."""
    wanted = set(rank_pair(n, 0.5))
    for p in _QUARTILES:
        for r in rank_pair(n + k, p):
            wanted |= {x for x in (r, r - k) if 0 <= x < n}
    return sorted(wanted)


def apply_cleaning(df: DataFrame, stats: CleaningStats) -> DataFrame:
    """Impute, cap, cast and drop rows without a target: one narrow projection."""
    return drop_null_target(convert_types(cap_outliers(imputed(df, stats), stats.fences)))


def preprocess(df: DataFrame, exact: bool = True) -> DataFrame:
    """The full cleaning of a table with its own statistics."""
    return apply_cleaning(df, fit_cleaning(df, exact))


def batch_fill(
    df: DataFrame,
    numeric: Sequence[str] = S.NUMERIC_FEATURES,
    categories: Sequence[str] = (S.DEVICE,),
) -> DataFrame:
    """Fill a batch from itself: numbers with its medians, categories with 'Unknown'."""
    return impute(df, fit_medians(df, numeric), {c: texts.UNKNOWN for c in categories})


def row_loss(df: DataFrame, target: str = S.LATENCY) -> DataFrame:
    """Rows before and after dropping those without a target."""
    counts = df.agg(F.count("*").alias("rows_before"), F.count(target).alias("rows_after"))
    return counts.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
