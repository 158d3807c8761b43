"""Writing result tables. They have one row per model, so one file each is right."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

CONFIG_VERSION = "1.0"


def write_csv(table: DataFrame, path: str) -> None:
    """Comparison table as CSV with header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines, one object per model that has an error value."""
    metrics.filter("mae IS NOT NULL").coalesce(1).write.mode("overwrite").json(path)


def run_record(
    spark: SparkSession, approach: str, data: str, test_size: float, seed: int, output: str
) -> DataFrame:
    """What was run, when and on which input."""
    row = (
        datetime.now(UTC).isoformat(),
        CONFIG_VERSION,
        approach,
        data,
        float(test_size),
        int(seed),
        output,
    )
    return spark.createDataFrame(
        [row],
        "timestamp string, script_version string, approach string, data_file string, "
        "test_size double, random_state bigint, output_directory string",
    )


def write_json(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").json(path)


def write_text(lines: DataFrame, path: str) -> None:
    """Numbered lines as one text file in order."""
    ordered = lines.repartition(1).sortWithinPartitions("line_number")
    ordered.select("line").write.mode("overwrite").text(path)
