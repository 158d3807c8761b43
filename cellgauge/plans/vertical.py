"""Vertical job: one model per column group, fused, against one model on all columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.operators import report
from cellgauge.operators.evaluate import comparison_table, model_metrics, require_samples
from cellgauge.operators.fusion import FusionModel
from cellgauge.operators.models import monolithic_model, score_vertical
from cellgauge.operators.partition import (
    SPLIT,
    TEST,
    TRAIN,
    train_test_split,
    vertical_check,
    vertical_split,
)
from cellgauge.plans.jobs import JobConfig, JobResult, frozen, keep, prepare, require_rows
from cellgauge.sources import schema as S

INFRA, USER, FUSION, MONO = (
    "infrastructure_model",
    "user_behavior_model",
    "fusion_model",
    "monolithic_model",
)
MODEL_TYPES = {
    INFRA: "InfrastructureModel",
    USER: "UserBehaviorModel",
    FUSION: "FusionModel",
    MONO: "MonolithicModel",
}


def run_vertical(df: DataFrame, config: JobConfig = JobConfig()) -> JobResult:
    """Clean, split, train both column groups, fuse, train the baseline, evaluate."""
    reports, cleaned = prepare(df, config)
    rows = keep(train_test_split(cleaned, config.test_size, config.seed))
    require_rows(rows)
    infra, user = vertical_split(rows)
    split_check = frozen(vertical_check(infra, user))
    if not split_check.first()["is_valid"]:
        raise ValueError("the column groups do not hold the same keys")

    train = rows.filter(F.col(SPLIT) == TRAIN)
    baseline = monolithic_model(config.forest)
    fusion = FusionModel(config.strategy, config.forest).train(train, beside=[baseline])

    predictions = keep(score_all(rows, fusion, baseline))
    models = {name: name for name in MODEL_TYPES}
    by_split = frozen(model_metrics(predictions, models, "y", [SPLIT]))
    test = require_samples(by_split.filter(F.col(SPLIT) == TEST).drop(SPLIT))
    comparison = comparison_table(test, MODEL_TYPES)
    tables = {
        **reports,
        "split_check": split_check,
        "predictions": predictions,
        "metrics": test,
        "comparison": comparison,
        "overfit": report.overfit_check(by_split),
        "bias": report.bias_check(test),
        "weights": fusion.parameters(df),
        "fusion_effectiveness": report.fusion_effectiveness(test, [FUSION], [INFRA, USER]),
        "vertical_vs_monolithic": report.vertical_vs_monolithic(test, [FUSION], MONO),
        "interpretations": report.interpretations(comparison),
        "recommendations": report.recommendations(comparison),
    }
    tables["report"] = report.report_lines(
        "VERTICAL PARTITIONING RESULTS",
        comparison,
        {
            "INTERPRETATION": tables["interpretations"],
            "RECOMMENDATIONS": tables["recommendations"],
        },
    )
    trained = {INFRA: fusion.infrastructure, USER: fusion.user, FUSION: fusion, MONO: baseline}
    return JobResult(tables, trained, [predictions, rows], rows, baseline.learned)


def score_all(rows: DataFrame, fusion: FusionModel, baseline) -> DataFrame:
    """Target and all predictions in the row of the observation."""
    scored = score_vertical(
        rows, {INFRA: fusion.infrastructure, USER: fusion.user, MONO: baseline}
    )
    split = [SPLIT] if SPLIT in rows.columns else []
    return scored.withColumn(FUSION, fusion.fused(INFRA, USER)).select(
        S.KEY, *split, F.col(S.LATENCY).alias("y"), *MODEL_TYPES
    )
