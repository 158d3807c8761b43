"""Scaling, one-hot encoding and feature assembly as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgauge.functions import texts
from cellgauge.operators.clean import fit_medians
from cellgauge.sources import schema as S

MAX_CATEGORIES = 10_000


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, one pass."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def scaled(column: str, mean: float, deviation: float) -> Column:
    """Standard score; a constant column gives 0."""
    return (F.col(column) - F.lit(mean)) / F.lit(deviation or 1.0)


def standard_scale(
    df: DataFrame, scaler: Mapping[str, tuple[float, float]], suffix: str = "_scaled"
) -> DataFrame:
    return df.withColumns({f"{c}{suffix}": scaled(c, *ms) for c, ms in scaler.items()})


def categories_seen(df: DataFrame, column: str = S.DEVICE) -> DataFrame:
    """Distinct values of a category."""
    return df.filter(F.col(column).isNotNull()).select(column).distinct()


def fit_categories(df: DataFrame, column: str = S.DEVICE, most: int = MAX_CATEGORIES) -> list[str]:
    """Sorted categories of a column. They become features, so more than `most` are an error."""
    rows = categories_seen(df, column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return sorted(row[column] for row in rows)


def one_hot_columns(column: str, categories: Sequence[str]) -> dict[str, Column]:
    """Indicators of all but the first category; an unseen value is all zeros."""
    return {
        f"{column}_{c}": F.when(F.col(column) == c, 1.0).otherwise(0.0) for c in categories[1:]
    }


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    return df.withColumns(one_hot_columns(column, categories))


def prepare_features(
    df: DataFrame, target: str = S.LATENCY, key: str = S.KEY
) -> DataFrame:
    """Drop the key, encode every text column, keep the numbers and the target."""
    S.require_columns(df, [target])
    numbers, indicators = [], {}
    for f in df.drop(key, target).schema:
        if isinstance(f.dataType, T.StringType):
            indicators |= one_hot_columns(f.name, fit_categories(df, f.name))
        else:
            numbers.append(f.name)
    return df.select(*numbers, *[c.alias(n) for n, c in indicators.items()], target)


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns a model reads."""

    numeric: Sequence[str]
    categorical: Sequence[str] = ()


INFRASTRUCTURE = FeatureSpec((S.SIGNAL, S.TRAFFIC))
USER_BEHAVIOR = FeatureSpec((S.USERS,), (S.DEVICE,))
SEGMENT_MODEL = FeatureSpec((S.SIGNAL, S.TRAFFIC, S.USERS), (S.DEVICE,))
MONOLITHIC = FeatureSpec((S.SIGNAL, S.TRAFFIC, S.USERS), (S.DEVICE, S.LOCATION))


@dataclass(frozen=True)
class FittedFeatures:
    """Feature builder fitted on training rows."""

    spec: FeatureSpec
    medians: Mapping[str, float | None]
    categories: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        indicators = [f"{c}_{v}" for c, vs in self.categories.items() for v in vs[1:]]
        return [*self.spec.numeric, *indicators]

    def vector(self, medians: Mapping[str, float | None] | None = None) -> Column:
        """Numbers with missing ones (null or NaN) filled, then the indicators, as one vector."""
        fill = medians or self.medians
        parts = [
            F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(fill[c] or 0.0)))
            for c in self.spec.numeric
        ]
        for c, values in self.categories.items():
            known = F.coalesce(F.col(c), F.lit(texts.UNKNOWN))
            parts += [F.when(known == v, 1.0).otherwise(0.0) for v in values[1:]]
        return array_to_vector(F.array(*parts))


def fit_features(
    df: DataFrame, spec: FeatureSpec, rows: int | None = None
) -> FittedFeatures:
    S.require_columns(df, [*spec.numeric, *spec.categorical])
    categories = {}
    for c in spec.categorical:
        known = df.select(F.coalesce(F.col(c), F.lit(texts.UNKNOWN)).alias(c))
        categories[c] = fit_categories(known, c)
    medians = fit_medians(df, spec.numeric, rows=rows) if spec.numeric else {}
    return FittedFeatures(spec, medians, categories)


def feature_names(df: DataFrame, specs: Mapping[str, FeatureSpec]) -> DataFrame:
    """Feature names of each model in order."""
    rows = [
        (model, i, name)
        for model, spec in specs.items()
        for i, name in enumerate(fit_features(df, spec).names)
    ]
    return df.sparkSession.createDataFrame(rows, "model string, position int, feature string")


def user_features(train: DataFrame, rows: DataFrame) -> DataFrame:
    """User count filled and scaled, device one-hot: fitted on `train`, applied to `rows`."""
    medians = fit_medians(train, [S.USERS])

    def filled(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                S.USERS: F.coalesce(F.col(S.USERS).cast("double"), F.lit(medians[S.USERS])),
                S.DEVICE: F.coalesce(F.col(S.DEVICE), F.lit(texts.UNKNOWN)),
            }
        )

    base = filled(train)
    scaler, categories = fit_scaler(base, [S.USERS]), fit_categories(base, S.DEVICE)
    return one_hot(standard_scale(filled(rows), scaler), S.DEVICE, categories)
