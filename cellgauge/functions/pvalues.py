"""Two-sided p-values of a test statistic; a result table has one row per test."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def signed_rank_two_sided(statistic: float, n: int) -> float:
    """Twice the share of all signs of the ranks 1 to n whose smaller sum is at most the statistic.

    The ways to reach each rank sum are counted rank by rank, in whole numbers.
    """
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2 * sum(ways[: math.floor(statistic) + 1]) / 2**n)


def student_two_sided(t: float, df: float) -> float:
    """Tail of Student's t through the incomplete beta function."""
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = a * math.log(x) + b * math.log1p(-x)
    front += math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    # Continued fraction, evaluated from the far end: no start value is needed.
    tail = 1.0
    for m in range(500 + int(4 * math.sqrt(a + b)), 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        tail = 1 + odd / (1 + even / tail)
    return math.exp(front) / (a * tail)


def with_p_values(tests: DataFrame, p_value: Callable[[Row], float | None]) -> DataFrame:
    """Add `p_value` to a table of test results, which has one row per tested pair."""
    rows = tests.collect()
    schema = T.StructType([*tests.schema.fields, T.StructField("p_value", T.DoubleType())])
    values = [(*row, p_value(row)) for row in rows]
    return tests.sparkSession.createDataFrame(values, schema)
