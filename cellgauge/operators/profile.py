"""Profiling aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.functions.columns import hash32
from cellgauge.functions.joins import attach
from cellgauge.operators.quantiles import quantile_name, quantiles
from cellgauge.sources import schema as S


def table_shape(df: DataFrame) -> DataFrame:
    """Row count, column count and column types."""
    types = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("type")) for c, t in df.dtypes]
    return df.agg(
        F.count("*").alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.array(*types).alias("data_types"),
    )


def describe_numeric(df: DataFrame, columns: Sequence[str] = S.NUMERIC_COLUMNS) -> DataFrame:
    """Count, mean, sample deviation and five-number summary, one row per column."""
    quartiles = quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    moments = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
            ).alias(f"m_{c}")
            for c in columns
        ]
    )
    middle = quartiles.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(quantile_name(c))[0].alias("q25"),
            F.col(quantile_name(c))[1].alias("q50"),
            F.col(quantile_name(c))[2].alias("q75"),
        )
        for c in columns
    ])))
    long = moments.select(F.inline(F.array(*[F.col(f"m_{c}") for c in columns])))
    return attach(long, middle, ["column_name"]).select(
        "column_name", "n", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each categorical column, nulls left out; all columns in one scan."""
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
        .orderBy("column_name", F.desc("n"), "value")
    )


def distribution(df: DataFrame, by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rows per group and their share in percent, rounded to 2.

    The share is of the whole table, or of the `within` group. Percentages are taken
    on the aggregated rows.
    """
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    if within:
        total = F.sum("n").over(Window.partitionBy(*within))
    else:
        total = df.select(F.count("*")).scalar()
    return counts.withColumn("percentage", F.round(F.col("n") / total * 100, 2))


def correlation_matrix(df: DataFrame, columns: Sequence[str] = S.NUMERIC_COLUMNS) -> DataFrame:
    """Pearson correlation of all pairs of columns on their common rows, one pass."""
    rows, seen = [], {}
    for a in columns:
        for b in columns:
            pair = tuple(sorted((a, b)))
            if pair not in seen:
                seen[pair] = F.corr(F.col(pair[0]).cast("double"), F.col(pair[1]).cast("double"))
            rows.append(
                F.struct(
                    F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), seen[pair].alias("corr")
                )
            )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def target_correlation(
    df: DataFrame,
    target: str = S.LATENCY,
    features: Mapping[str, str] | None = None,
) -> DataFrame:
    """Correlation of each feature with the target by size; `features` maps to a group label."""
    features = features or {
        S.SIGNAL: "infrastructure",
        S.TRAFFIC: "infrastructure",
        S.USERS: "user_behavior",
    }
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(label).alias("feature_group"),
            F.corr(F.col(c).cast("double"), F.col(target)).alias("corr"),
        )
        for c, label in features.items()
    ]
    return (
        df.agg(F.array(*rows).alias("rows"))
        .select(F.inline("rows"))
        .orderBy(F.abs("corr").desc(), "feature")
    )


def grouped_target_stats(
    df: DataFrame, by: str = S.LOCATION, target: str = S.LATENCY, digits: int = 3
) -> DataFrame:
    """Count, mean, sample deviation, min, max and median per group, rounded."""
    stats = df.groupBy(by).agg(
        F.count(target).alias("n"),
        F.round(F.avg(target), digits).alias("mean"),
        F.round(F.stddev_samp(target), digits).alias("std"),
        F.round(F.min(target), digits).alias("min"),
        F.round(F.max(target), digits).alias("max"),
    )
    middle = quantiles(df, {target: [0.5]}, [by]).select(
        by, F.round(F.col(quantile_name(target))[0], digits).alias("median")
    )
    return attach(stats, middle, [by])


def grouped_feature_stats(
    df: DataFrame,
    by: str = S.LOCATION,
    features: Sequence[str] = S.NUMERIC_FEATURES,
    target: str = S.LATENCY,
) -> DataFrame:
    """Mean and sample deviation of every feature and the mean target, per group."""
    stats: list[Column] = []
    for c in features:
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(by).agg(*stats, F.avg(target).alias(f"{target}_mean"))


def target_mean_difference(
    df: DataFrame, first: str, second: str, by: str = S.LOCATION, target: str = S.LATENCY
) -> DataFrame:
    """Mean target of two groups and their difference."""
    means = df.agg(
        F.avg(F.when(F.col(by) == first, F.col(target))).alias("first_mean"),
        F.avg(F.when(F.col(by) == second, F.col(target))).alias("second_mean"),
    )
    return means.withColumn("difference", F.col("first_mean") - F.col("second_mean"))


def correlation_by_group(
    df: DataFrame,
    groups: Sequence[str],
    by: str = S.LOCATION,
    features: Sequence[str] = S.NUMERIC_FEATURES,
    target: str = S.LATENCY,
) -> DataFrame:
    """Correlation with the target per feature, one column per group.

    NULL when a group has fewer than two rows.
    """
    rows = []
    for c in features:
        cells = [F.lit(c).alias("feature")]
        for g in groups:
            mine = F.col(by) == g
            value = F.corr(F.when(mine, F.col(c).cast("double")), F.col(target))
            cells.append(F.when(F.count_if(mine) > 1, value).alias(g))
        rows.append(F.struct(*cells))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def histogram(
    df: DataFrame, column: str = S.LATENCY, bins: int = 30, by: str | None = None
) -> DataFrame:
    """Equal-width bins between min and max, the last one closed; empty bins are kept.

    Groups share the edges.
    """
    span = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    low, high = span[0], span[1]
    if low is None:
        low = high = 0.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    x = F.col(column)
    width = (F.lit(high) - F.lit(low)) / bins
    index = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    counts = (
        df.filter(x.isNotNull()).groupBy(*keys, index.alias("bin")).agg(F.count("*").alias("n"))
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    if by:
        frame = counts.groupBy(by).agg(F.lit(0).alias("_z")).select(by, every)
    else:
        frame = df.sparkSession.range(1).select(every)
    filled = attach(frame, counts, [*keys, "bin"])
    return filled.select(
        *keys,
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def box_stats(df: DataFrame, by: str, column: str = S.LATENCY) -> DataFrame:
    """Quartiles, whiskers at the furthest value within 1.5 IQR, and outliers per group."""
    q = F.col(quantile_name(column))
    boxes = quantiles(df, {column: [0.25, 0.5, 0.75]}, [by]).select(
        by, q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")
    )
    rows = attach(df.select(by, column).filter(F.col(column).isNotNull()), boxes, [by], "inner")
    x, q1, q3 = F.col(column), F.col("q1"), F.col("q3")
    inside = (x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))
    return rows.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, x)).cast("double").alias("whisker_low"),
        F.max(F.when(inside, x)).cast("double").alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count("*").alias("n"),
    )


def points(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Plot points: every row with both coordinates."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).alias("x"), F.col(y).alias("y"), *([group] if group else [])
    )


def point_cells(
    df: DataFrame, x: str, y: str, by: str | None = None, depth: int = 7, parts: int = 256
) -> DataFrame:
    """All plot points as counts of a quadtree: small cells where points are dense.

    The square between the smallest and largest coordinates is halved in both directions as
    long as a cell holds more than one of `parts` of its group's points, `depth` times at
    most. Cells without points are left out, counts add up to the points; null and
    non-finite coordinates are no points. Groups share the square and have cells of their
    own. Rows are counted once, in at most `4 ** depth` cells a group; the tree is made of these.
    """
    keys = [by] if by else []
    rows = points(df, x, y, by).withColumns({c: F.col(c).cast("double") for c in "xy"})
    rows = rows.filter(F.abs("x") < float("inf")).filter(F.abs("y") < float("inf"))
    span = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    side, edges = 1 << depth, {}
    for c, low, high in (("x", *span[:2]), ("y", *span[2:])):
        if low is None or low == high:
            low, high = (low or 0.0) - 0.5, (low or 0.0) + 0.5
        edges[c] = low, high - low
    place = {
        c: F.least(F.floor((F.col(c) - low) / (width / side)), F.lit(side - 1)).alias(f"_{c}")
        for c, (low, width) in edges.items()
    }
    fine = rows.groupBy(*keys, *place.values()).agg(F.count("*").alias("_n"))
    # The count of every cell around a finest one, from the whole square down to itself.
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_level")
    inner = fine.select("*", level)
    around = [F.expr(f"shiftright(_{c}, {depth} - _level)") for c in "xy"]
    held = F.sum("_n").over(Window.partitionBy(*keys, "_level", *around))
    counts = inner.withColumn("_held", held).groupBy(*keys, "_x", "_y", "_n")
    counts = counts.agg(F.sort_array(F.collect_list("_held"), asc=False).alias("_held"))
    dense = F.size(F.filter("_held", lambda c: c * parts > F.col("_held")[0]))
    cells = counts.withColumn("level", F.least(dense, F.lit(depth)))
    names = {c: F.expr(f"shiftright(_{c}, {depth} - level)").alias(f"{c}_cell") for c in "xy"}
    cells = cells.groupBy(*keys, "level", *names.values()).agg(F.sum("_n").alias("n"))
    bounds = []
    for c, (low, width) in edges.items():
        size = F.lit(width) / F.expr("shiftleft(1, level)")
        bounds += [
            (F.lit(low) + F.col(f"{c}_cell") * size).alias(f"{c}_low"),
            (F.lit(low) + (F.col(f"{c}_cell") + 1) * size).alias(f"{c}_high"),
        ]
    return cells.select(*keys, "level", "x_cell", "y_cell", *bounds, "n")


def sample_points(
    df: DataFrame,
    x: str,
    y: str,
    key: str = S.KEY,
    size: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """Repeatable sample of the plot points: the `size` rows of smallest key hash."""
    return (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .select(key, F.col(x).alias("x"), F.col(y).alias("y"), hash32(key, seed).alias("_h"))
        .orderBy("_h", key, "x", "y")
        .limit(size)
        .drop("_h")
    )


def head_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows in column order."""
    return df.orderBy(*df.columns).limit(n)


def split_stats(
    df: DataFrame,
    by: Sequence[str] = ("segment", "split"),
    target: str = S.LATENCY,
) -> DataFrame:
    """Mean, sample deviation and range of the target per segment and split."""
    return df.groupBy(*by).agg(
        F.count(target).alias("n"),
        F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"),
        F.min(target).alias("min"),
        F.max(target).alias("max"),
    )
