"""Ranks over a whole table of integers without a one-task sort.

Values are cut into digits of 21 bits. A window never spans more than 2^21 distinct
values: one level ranks values that share their upper digits, the next levels give
the offset of each such block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.functions.joins import attach

DIGIT_BITS = 21


def _running(df: DataFrame, order: str, weight: str, by: list[str]) -> Column:
    """Sum of the weights strictly before the row within its block."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(window), F.lit(0).cast("bigint"))


def rows_before(
    counts: DataFrame, value: str, weight: str, by: Sequence[str] = (), out: str = "before"
) -> DataFrame:
    """Add the total weight of all smaller values in the same group.

    `counts` has one row per group and value (a non-negative bigint) and a bigint weight.
    """
    by = list(by)
    mid = counts.withColumns(
        {
            "_d1": F.shiftright(F.col(value), DIGIT_BITS),
            "_d2": F.shiftright(F.col(value), 2 * DIGIT_BITS),
        }
    )
    blocks = mid.groupBy(*by, "_d1", "_d2").agg(F.sum(weight).alias("_w"))
    tops = blocks.groupBy(*by, "_d2").agg(F.sum("_w").alias("_w2"))
    tops = tops.select(*by, "_d2", _running(tops, "_d2", "_w2", by).alias("_off2"))
    blocks = blocks.select(
        *by, "_d1", "_d2", _running(blocks, "_d1", "_w", [*by, "_d2"]).alias("_off1")
    )
    offsets = blocks.join(tops, [*by, "_d2"]).select(
        *by, "_d1", (F.col("_off1") + F.col("_off2")).alias("_off")
    )
    inner = mid.withColumn("_in", _running(mid, value, weight, [*by, "_d1"]))
    return (
        inner.join(offsets, [*by, "_d1"])
        .withColumn(out, F.col("_off") + F.col("_in"))
        .drop("_d1", "_d2", "_in", "_off")
    )


def kth_smallest(
    df: DataFrame, value: str, share: float, by: str, out: str = "cut"
) -> DataFrame:
    """Per group, the value at rank ceil(share * n) of a 32-bit integer column.

    Two counting passes over 16-bit halves: at most 65,536 counters per group,
    whatever the number of rows. The upper half that holds the rank is one row per
    group, so it joins by broadcast within the checked bound. A NULL group is a group.
    """
    halves = df.select(
        F.col(by).alias("_g"),
        F.shiftright(F.col(value), 16).alias("_hi"),
        F.col(value).bitwiseAND(0xFFFF).alias("_lo"),
    )
    high = halves.groupBy("_g", "_hi").agg(F.count("*").alias("_w"))
    in_group = Window.partitionBy("_g")
    high = high.select(
        "*",
        F.ceil(F.lit(share) * F.sum("_w").over(in_group)).alias("_k"),
        _running(high, "_hi", "_w", ["_g"]).alias("_before"),
    ).filter((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_w")))
    place = (F.col("_k") - F.col("_before")).alias("_k")
    chosen = high.select("_g", F.col("_hi").alias("_chi"), place)
    low = (
        attach(halves, chosen, ["_g"], "inner")
        .filter(F.col("_hi") == F.col("_chi"))
        .groupBy("_g", "_hi", "_lo", "_k")
        .agg(F.count("*").alias("_w"))
    )
    low = low.withColumn("_before", _running(low, "_lo", "_w", ["_g"]))
    return low.filter(
        (F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_w"))
    ).select(F.col("_g").alias(by), (F.shiftleft("_hi", 16) + F.col("_lo")).alias(out))
