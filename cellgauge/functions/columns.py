"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_RANGE = 2**32


def hash32(key: str | Column, seed: int) -> Column:
    """Portable 32-bit hash of a key: the first 8 hex digits of md5('<seed>:<key>').

    It depends on the value only, so it survives repartitioning and reruns. A NULL
    key hashes like the empty text.
    """
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def is_missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def same_row(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality over pairs of columns."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition
