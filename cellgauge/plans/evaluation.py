"""Evaluation and report of predictions that are already scored."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.operators import report
from cellgauge.operators.evaluate import (
    best_worst,
    comparison_table,
    cv_summary,
    model_metrics,
    performance_table,
    require_samples,
)
from cellgauge.operators.significance import paired_t_tests, verdicts
from cellgauge.sources import sinks


def evaluation_bundle(
    predictions: DataFrame,
    models: Mapping[str, str],
    types: Mapping[str, str],
    fold_scores: DataFrame | None = None,
    y: str = "y",
) -> dict[str, DataFrame]:
    """Comparison, cross-validation, all-pairs tests, best model and dataset size."""
    metrics = require_samples(model_metrics(predictions, models, y))
    comparison = comparison_table(metrics, types)
    cv = cv_summary(fold_scores) if fold_scores is not None else None
    tables = {
        "comparison": comparison,
        "performance": performance_table(comparison, cv),
        "significance": verdicts(paired_t_tests(predictions, models, y)),
        "best": best_worst(comparison),
        "size": predictions.agg(
            F.count("*").alias("dataset_size"), F.lit(len(models)).alias("total_models")
        ),
    }
    if cv is not None:
        tables["cross_validation"] = cv
    return tables


def report_bundle(
    predictions: DataFrame,
    models: Mapping[str, str],
    types: Mapping[str, str],
    output: str,
    fold_scores: DataFrame | None = None,
    y: str = "y",
) -> dict[str, DataFrame]:
    """The evaluation with findings, written as CSV, JSON and text under `output`."""
    tables = evaluation_bundle(predictions, models, types, fold_scores, y)
    comparison = tables["comparison"]
    tables["findings"] = report.summary_findings(comparison)
    tables["interpretations"] = report.interpretations(comparison, tables["significance"])
    tables["recommendations"] = report.recommendations(comparison)
    tables["report"] = report.report_lines(
        "MODEL PERFORMANCE REPORT",
        comparison,
        {
            "KEY FINDINGS": tables["interpretations"],
            "RECOMMENDATIONS": tables["recommendations"],
        },
    )
    sinks.write_csv(tables["performance"], f"{output}/performance_table")
    sinks.write_metrics_json(comparison, f"{output}/metrics")
    sinks.write_text(tables["report"], f"{output}/performance_report")
    return tables
