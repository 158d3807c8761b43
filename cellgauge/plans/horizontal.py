"""Horizontal job: one model per location against one model on all rows."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.functions import texts
from cellgauge.operators import report
from cellgauge.operators.evaluate import model_metrics
from cellgauge.operators.models import monolithic_model, score_horizontal, segment_models, train_all
from cellgauge.operators.partition import (
    SEGMENT,
    SPLIT,
    TEST,
    TRAIN,
    heuristic_summary,
    horizontal_check,
    horizontal_split,
    location_heuristic,
    stratified_split,
)
from cellgauge.operators.validate import sample_sufficiency
from cellgauge.plans.jobs import JobConfig, JobResult, frozen, keep, prepare, require_rows
from cellgauge.sources import schema as S

log = logging.getLogger(__name__)


def run_horizontal(df: DataFrame, config: JobConfig = JobConfig()) -> JobResult:
    """Clean, settle locations, split per location, train, evaluate on every segment.

    The rows of both segments are held against those before the split, once over all rows
    and once for each side of the split. A key that lies in both segments, or rows that are
    lost, stop the job only when `config.strict` is set.
    """
    reports, cleaned = prepare(df, config)
    heuristic = heuristic_summary(cleaned)
    located = location_heuristic(cleaned)
    split = stratified_split(located, S.LOCATION, config.test_size, config.seed)
    rows = keep(horizontal_split(split))
    require_rows(rows)
    checks = frozen(horizontal_check(rows, located))
    sides = frozen(horizontal_check(rows, split, by=[SPLIT]).orderBy(SPLIT))
    if not all(row["is_valid"] for row in [*checks.collect(), *sides.collect()]):
        if config.strict:
            raise ValueError("segments and split do not add up")
        log.warning("segments and split do not add up: see table split_check")

    train = rows.filter(F.col(SPLIT) == TRAIN)
    segments, overall = segment_models(train, config.forest), monolithic_model(config.forest)
    train_all(train, [*segments.values(), overall])

    special = [m.name for m in segments.values()]
    predictions = keep(
        score_horizontal(rows.filter(F.col(SPLIT) == TEST), overall, segments, SEGMENT).select(
            S.KEY, SEGMENT, F.col(S.LATENCY).alias("y"), "global_model", *special
        )
    )
    routed = predictions.withColumn("specialised", F.coalesce(*special))
    subsets = model_metrics(
        routed, {"global": "global_model", "specialised": "specialised"}, "y", [SEGMENT], True
    )
    comparison = frozen(
        report.horizontal_comparison(subsets).filter(F.col("sample_size") > 0)
    )
    insights = report.segment_insights(comparison, texts.KNOWN_LOCATIONS)
    tables = {
        **reports,
        "heuristic": heuristic,
        "split_check": checks,
        "side_checks": sides,
        "sufficiency": sample_sufficiency(rows),
        "predictions": predictions,
        "metrics": comparison,
        "comparison": comparison,
        "improvement": report.segment_improvement(comparison),
        "effect": report.horizontal_effect(comparison),
        "tiers": report.r2_tiers(comparison),
        "insights": insights,
    }
    tables["report"] = report.report_lines(
        "HORIZONTAL PARTITIONING RESULTS", comparison, {"INSIGHTS": insights}
    )
    trained = {m.name: m for m in segments.values()} | {"global_model": overall}
    return JobResult(tables, trained, [predictions, rows], rows)
