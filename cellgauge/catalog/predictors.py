"""Closed-form predictors for the evaluation queries.

They stand for the trained models where a query must have a SQL twin: a regression
on one feature for a column group, group means for the model on all columns, a
regression per segment for the location models. All are fitted on training rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.catalog.sqltext import FOLDS
from cellgauge.functions import texts
from cellgauge.functions.joins import attach
from cellgauge.operators.clean import preprocess
from cellgauge.operators.evaluate import fold_mse
from cellgauge.operators.fusion import (
    fusion_weights,
    meta_coefficients,
    meta_moments,
    weighted,
)
from cellgauge.operators.models import with_folds
from cellgauge.operators.partition import SEGMENT, SPLIT, TRAIN, location_heuristic, train_test_split
from cellgauge.sources import schema as S
from cellgauge.sources.network import observations
from cellgauge.sources.tables import cached

A, B, M = "infrastructure_model", "user_behavior_model", "monolithic_model"
FEATURE = {A: S.TRAFFIC, B: S.USERS}


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned rows with segment, split and fold: all rows that have a target."""
    df = preprocess(observations(spark, sf_dir))
    located = location_heuristic(df.withColumn("_given", F.col(S.LOCATION)))
    df = located.withColumnsRenamed({S.LOCATION: SEGMENT, "_given": S.LOCATION})
    rows = with_folds(train_test_split(df), FOLDS).withColumnRenamed(S.LATENCY, "y")
    return cached(rows.drop(S.SIGNAL))


@dataclass(frozen=True)
class Moments:
    """Sums a straight-line fit needs. Those of two groups merge exactly."""

    n: int
    mx: float
    my: float
    vx: float
    cxy: float

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        dx, dy, w = other.mx - self.mx, other.my - self.my, self.n * other.n / n
        return Moments(
            n,
            self.mx + dx * other.n / n,
            self.my + dy * other.n / n,
            self.vx + other.vx + dx * dx * w,
            self.cxy + other.cxy + dx * dy * w,
        )

    def line(self) -> tuple[float, float]:
        slope = self.cxy / self.vx
        return slope, self.my - slope * self.mx


def _moments(train: DataFrame) -> list[tuple[int, str, str, Moments]]:
    """Moments per fold, segment and feature: one pass, one row per fold and segment."""
    columns = [F.count("*").alias("n"), F.avg("y").alias("my")]
    for m, x in FEATURE.items():
        feature = F.col(x).cast("double")
        columns += [
            F.avg(feature).alias(f"{m}_mx"),
            F.var_pop(feature).alias(f"{m}_vx"),
            F.covar_pop(feature, "y").alias(f"{m}_cxy"),
        ]
    return [
        (
            r["fold"],
            r[SEGMENT],
            m,
            Moments(
                r["n"], r[f"{m}_mx"], r["my"], r["n"] * r[f"{m}_vx"], r["n"] * r[f"{m}_cxy"]
            ),
        )
        for r in train.groupBy("fold", SEGMENT).agg(*columns).orderBy("fold", SEGMENT).collect()
        for m in FEATURE
    ]


def _predict(x: str, line: tuple[float, float]) -> Column:
    return F.lit(line[0]) * F.col(x).cast("double") + F.lit(line[1])


def single_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the prediction of every unfused model.

    All regressions, per fold and per segment too, come from one pass over the rows.
    """
    base = base_rows(spark, sf_dir)
    train = base.filter(F.col(SPLIT) == TRAIN)
    moments = _moments(train)

    def line(model: str, without: int | None = None, segment: str | None = None):
        parts = [
            part
            for fold, place, m, part in moments
            if m == model and fold != without and segment in (None, place)
        ]
        return reduce(add, parts).line()

    means = train.groupBy(S.DEVICE, S.LOCATION).agg(F.avg("y").alias(M))

    def out_of_fold(m: str) -> Column:
        arms = [
            F.when(F.col("fold") == f, _predict(FEATURE[m], line(m, without=f)))
            for f in range(FOLDS)
        ]
        return F.coalesce(*arms)

    columns = {m: _predict(FEATURE[m], line(m)) for m in (A, B)}
    columns |= {"oof_a": out_of_fold(A), "oof_b": out_of_fold(B)}
    for s in texts.KNOWN_LOCATIONS:
        mine = F.when(F.col(SEGMENT) == s, _predict(S.TRAFFIC, line(A, segment=s)))
        columns[f"{s.lower()}_model"] = mine
    return attach(base.withColumns(columns), means, [S.DEVICE, S.LOCATION])


def fold_scores(single: DataFrame) -> DataFrame:
    train = single.filter(F.col(SPLIT) == TRAIN)
    return fold_mse(train, {A: "oof_a", B: "oof_b"}, "fold")


def weights(single: DataFrame) -> DataFrame:
    return fusion_weights(fold_scores(single), A, B)


def meta(single: DataFrame) -> DataFrame:
    train = single.filter(F.col(SPLIT) == TRAIN)
    return meta_coefficients(meta_moments(train, "y", A, B))


def all_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the predictions of single and fused models."""
    single = single_models(spark, sf_dir)
    w, m = weights(single).first(), meta(single).first()
    return single.withColumns(
        {
            "fusion_weighted": weighted(F.col(A), F.col(B), w["weight_a"], w["weight_b"]),
            "fusion_meta": weighted(F.col(A), F.col(B), m["weight_a"], m["weight_b"])
            + F.lit(m["intercept"]),
            "specialised": F.coalesce("urban_model", "rural_model"),
        }
    )
