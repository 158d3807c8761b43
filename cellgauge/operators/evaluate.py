"""Regression metrics over prediction columns that lie in the row of the observation.

A prediction table has one row per observation: key, segment, split, the target `y`
and one column per model. Rows are never expanded per model, metrics of all models
come from one aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.functions.columns import is_missing
from cellgauge.functions.joins import attach
from cellgauge.operators.profile import points
from cellgauge.operators.quantiles import quantile_name, quantiles

METRICS = ["mae", "rmse", "r2", "mape", "mean_residual", "std_residual", "sample_size"]


def metric_struct(y: Column, p: Column) -> Column:
    """All metrics of one model; rows without target or prediction are ignored.

    A constant target has R2 1 when every prediction is right, else 0. MAPE is over
    non-zero targets and infinite when there are none.
    """
    usable = ~is_missing(y) & ~is_missing(p)
    t = F.when(usable, y)
    e = F.when(usable, y - p)
    n = F.count_if(usable)
    sse, sst = F.sum(e * e), F.var_pop(t) * n
    r2 = F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - sse / sst)
    ape = F.avg(F.when(y != 0, F.abs(e / y))) * 100
    mape = F.when(n > 0, F.coalesce(ape, F.lit(float("inf"))))
    return F.struct(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        r2.alias("r2"),
        mape.alias("mape"),
        F.avg(e).alias("mean_residual"),
        F.stddev_pop(e).alias("std_residual"),
        n.alias("sample_size"),
    )


def model_metrics(
    df: DataFrame,
    models: Mapping[str, str],
    y: str = "y",
    by: Sequence[str] = (),
    totals: bool = False,
) -> DataFrame:
    """One row per group and model; `models` maps a model name to its column.

    With `totals` the groups are rolled up, a NULL group is the subtotal.
    """
    grouped = df.rollup(*by) if totals else df.groupBy(*by)
    aggregated = grouped.agg(
        *[
            metric_struct(F.col(y).cast("double"), F.col(column).cast("double")).alias(f"_m{i}")
            for i, column in enumerate(models.values())
        ]
    )
    rows = [
        F.struct(F.lit(name).alias("model_name"), *[F.col(f"_m{i}")[m].alias(m) for m in METRICS])
        for i, name in enumerate(models)
    ]
    return aggregated.select(*by, F.inline(F.array(*rows)))


def long_metrics(
    df: DataFrame,
    by: Sequence[str] = ("model_name",),
    y: str = "y",
    prediction: str = "prediction",
) -> DataFrame:
    """Metrics of a long table (one row per observation and model)."""
    stats = metric_struct(F.col(y).cast("double"), F.col(prediction).cast("double"))
    return df.groupBy(*by).agg(stats.alias("_m")).select(*by, "_m.*")


def regression_metrics(
    df: DataFrame, models: Mapping[str, str], y: str = "y"
) -> DataFrame:
    return model_metrics(df, models, y).select("model_name", "mae", "rmse", "r2")


def unpivot_predictions(
    df: DataFrame, models: Mapping[str, str], keep: Sequence[str]
) -> DataFrame:
    """Long form of the prediction columns."""
    renamed = df.select(*keep, *[F.col(c).cast("double").alias(n) for n, c in models.items()])
    return renamed.unpivot(list(keep), list(models), "model_name", "prediction")


def require_samples(metrics: DataFrame) -> DataFrame:
    """Raise ValueError when a model has no usable row. Reads the small metrics table."""
    empty = [r["model_name"] for r in metrics.filter("sample_size = 0").collect()]
    if empty:
        raise ValueError(f"Cannot calculate metrics for empty input: {empty}")
    return metrics


def comparison_table(
    metrics: DataFrame, types: Mapping[str, str] | None = None
) -> DataFrame:
    """Models that could be evaluated, best R2 first, names settle ties."""
    table = metrics.filter(F.col("sample_size") > 0)
    if types:
        kind = F.coalesce(*[F.when(F.col("model_name") == n, t) for n, t in types.items()])
        table = table.withColumn("model_type", kind)
    return table.orderBy(F.desc("r2"), "model_name")


def performance_table(comparison: DataFrame, cv: DataFrame | None = None) -> DataFrame:
    """Comparison with rank and, where given, the cross-validation scores."""
    table = comparison
    extra = []
    if cv is not None:
        scores = cv.select(
            "model_name",
            F.col("cv_mean").alias("cv_score_mean"),
            F.col("cv_std").alias("cv_score_std"),
        )
        table = attach(table, scores, ["model_name"])
        extra = ["cv_score_mean", "cv_score_std"]
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("r2"), "model_name")
    table = table.withColumn("rank", F.row_number().over(order))
    kind = ["model_type"] if "model_type" in comparison.columns else []
    return table.select(
        "rank",
        "model_name",
        *kind,
        "r2",
        "mae",
        "rmse",
        "mape",
        *extra,
        "mean_residual",
        "std_residual",
        "sample_size",
    )


def best_worst(metrics: DataFrame) -> DataFrame:
    """First and last model by R2."""
    order = F.struct(-F.col("r2"), F.col("model_name"))
    return metrics.agg(
        F.min_by("model_name", order).alias("best_model"),
        F.max("r2").alias("best_r2"),
        F.max_by("model_name", order).alias("worst_model"),
        F.min("r2").alias("worst_r2"),
    )


def normalized_metrics(metrics: DataFrame) -> DataFrame:
    """Errors as 1 - x / max(x) over the models; R2 as it is."""
    every = Window.partitionBy(F.lit(0))
    return metrics.select(
        "model_name",
        "r2",
        (1 - F.col("mae") / F.max("mae").over(every)).alias("mae_score"),
        (1 - F.col("rmse") / F.max("rmse").over(every)).alias("rmse_score"),
    )


def with_residuals(df: DataFrame, prediction: str, y: str = "y") -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(prediction))


def residual_stats(df: DataFrame, models: Mapping[str, str], y: str = "y") -> DataFrame:
    """Mean, population deviation and range of the residuals per model, one pass."""
    rows = []
    for name, column in models.items():
        e = F.col(y) - F.col(column)
        rows.append(
            F.struct(
                F.lit(name).alias("model_name"),
                F.avg(e).alias("mean"),
                F.stddev_pop(e).alias("std"),
                F.min(e).alias("min"),
                F.max(e).alias("max"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def residual_qq(
    df: DataFrame, prediction: str, probs: Sequence[float], y: str = "y"
) -> DataFrame:
    """Residual quantiles against those of the normal distribution on a fixed grid."""
    normal = NormalDist()
    residuals = with_residuals(df, prediction, y).select("residual")
    ordered = quantiles(residuals, {"residual": probs})
    grid = [
        F.struct(F.lit(p).alias("prob"), F.lit(normal.inv_cdf(p)).alias("theoretical"))
        for p in probs
    ]
    zipped = F.arrays_zip(F.array(*grid).alias("g"), F.col(quantile_name("residual")).alias("q"))
    return ordered.select(F.inline(zipped)).select(
        F.col("g.prob").alias("prob"),
        F.col("g.theoretical").alias("theoretical"),
        F.col("q").alias("sample"),
    )


def prediction_points(df: DataFrame, prediction: str, y: str = "y") -> DataFrame:
    """Actual, predicted and residual of every scored row."""
    plotted = points(df, y, prediction)
    return plotted.select(
        F.col("x").alias("actual"),
        F.col("y").alias("predicted"),
        (F.col("x") - F.col("y")).alias("residual"),
    )


def cv_summary(fold_scores: DataFrame) -> DataFrame:
    """Mean, population deviation and range of the negative fold errors, best first."""
    score = -F.col("mse")
    return (
        fold_scores.groupBy("model_name")
        .agg(
            F.avg(score).alias("cv_mean"),
            F.stddev_pop(score).alias("cv_std"),
            F.min(score).alias("cv_min"),
            F.max(score).alias("cv_max"),
        )
        .orderBy(F.desc("cv_mean"), "model_name")
    )


def fold_mse(df: DataFrame, models: Mapping[str, str], fold: str, y: str = "y") -> DataFrame:
    """Mean squared error per fold and model."""
    grouped = df.groupBy(fold).agg(
        *[
            F.avg(F.pow(F.col(y) - F.col(c), 2.0)).alias(f"_m{i}")
            for i, c in enumerate(models.values())
        ]
    )
    rows = [
        F.struct(F.lit(n).alias("model_name"), F.col(f"_m{i}").alias("mse"))
        for i, n in enumerate(models)
    ]
    return grouped.select(fold, F.inline(F.array(*rows)))
