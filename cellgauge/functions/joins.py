"""Joining a small table to a large one with its size checked first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 20_000


def attach(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a per-group table to the rows on null-safe keys.

    The table is read up to `bound` + 1 rows. Within the bound it is broadcast as a
    local table; beyond it the join is left to the optimizer, whose skew join splits
    hot groups.
    """
    rows = table.limit(bound + 1).collect()
    renamed = {c: f"_right_{c}" for c in on}
    if len(rows) <= bound:
        small = df.sparkSession.createDataFrame(rows, table.schema)
        right = F.broadcast(small.withColumnsRenamed(renamed))
    else:
        right = table.withColumnsRenamed(renamed)
    condition = F.lit(True)
    for c in on:
        condition = condition & df[c].eqNullSafe(right[renamed[c]])
    return df.join(right, condition, how).drop(*renamed.values())
