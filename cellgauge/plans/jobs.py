"""Settings and steps that both jobs share."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.operators.clean import apply_cleaning, fit_cleaning
from cellgauge.operators.fusion import WEIGHTED
from cellgauge.operators.models import ForestSettings, Learned
from cellgauge.operators.partition import SPLIT, TEST, TRAIN
from cellgauge.operators.validate import (
    MIN_PROCESSED_ROWS,
    MIN_TEST_ROWS,
    MIN_TRAIN_ROWS,
    validation_report,
)
from cellgauge.sources.schema import CORRUPT, apply_contract, cast_failures, require_columns

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class JobConfig:
    test_size: float = 0.2
    seed: int = 42
    trees: int = 100
    depth: int = 10
    strategy: str = WEIGHTED
    exact: bool = True
    strict: bool = False
    layout: int | None = None

    @property
    def forest(self) -> ForestSettings:
        return ForestSettings(self.trees, self.depth, self.seed, layout=self.layout)


@dataclass
class JobResult:
    """Named result tables, the rows that models were trained on and scored, what was learned of them.

    `close` frees the cached rows they read.
    """

    tables: Mapping[str, DataFrame]
    models: Mapping[str, object]
    cached: list[DataFrame] = field(default_factory=list)
    rows: DataFrame | None = None
    learned: Learned | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def close(self) -> None:
        for df in self.cached:
            df.unpersist()


def prepare(df: DataFrame, config: JobConfig) -> tuple[dict[str, DataFrame], DataFrame]:
    """Validation and cast reports, and cleaned rows under the column contract.

    Only missing columns stop the job; values that do not parse are counted and warned of.
    """
    failures = frozen(cast_failures(require_columns(df)))
    for column, n in failures.filter("n_failed > 0").collect():
        if column == CORRUPT:
            log.warning("%d lines are broken and left out", n)
        else:
            log.warning("%s: %d values do not parse and count as missing", column, n)
    rows = apply_contract(df)
    reports = {"validation": validation_report(rows), "cast_report": failures}
    return reports, apply_cleaning(rows, fit_cleaning(rows, config.exact))


def keep(df: DataFrame) -> DataFrame:
    """Cache rows that every model reads again; they spill to disk when memory is short."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def frozen(table: DataFrame) -> DataFrame:
    """Compute a table of a few rows once."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def require_rows(df: DataFrame) -> None:
    """Least rows in total and per side of the split."""
    row = df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(SPLIT) == TRAIN).alias("train"),
        F.count_if(F.col(SPLIT) == TEST).alias("test"),
    ).first()
    if row["n"] < MIN_PROCESSED_ROWS:
        raise ValueError(f"too few cleaned rows: {row['n']}")
    if row["train"] < MIN_TRAIN_ROWS:
        raise ValueError(f"too few training rows: {row['train']}")
    if row["test"] < MIN_TEST_ROWS:
        raise ValueError(f"too few test rows: {row['test']}")
