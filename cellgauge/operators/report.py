"""Report rules over the metrics table: one row per model in, a few rows out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.functions import texts

# R2 bounds of the tiers and thresholds of the rules.
EXCELLENT, GOOD, MODERATE = 0.8, 0.6, 0.4
VARIATION_RANGE = 0.2
IMPROVE_BELOW = 0.7
HIGH_MAPE = 20
MANY_MODELS = 3
OVERFIT_GAP = 0.1
UNBIASED_BELOW = 1.0
EFFECTIVE_ABOVE = 5


def tier(r2: Column) -> Column:
    return (
        F.when(r2 > EXCELLENT, "excellent")
        .when(r2 > GOOD, "good")
        .when(r2 > MODERATE, "moderate")
        .otherwise("below")
    )


def tier_text(r2: Column) -> Column:
    chosen = tier(r2)
    return F.coalesce(*[F.when(chosen == t, text) for t, text in texts.TIER_TEXTS.items()])


def r2_tiers(metrics: DataFrame) -> DataFrame:
    return metrics.select("model_name", "r2", tier(F.col("r2")).alias("tier"))


def r2_of(name: str) -> Column:
    """R2 of one model inside an aggregate over the metrics table."""
    return F.max(F.when(F.col("model_name") == name, F.col("r2")))


def best_of(names: Sequence[str]) -> Column:
    return F.max(F.when(F.col("model_name").isin(list(names)), F.col("r2")))


def summary_findings(metrics: DataFrame) -> DataFrame:
    """Best and worst model, mean, sample deviation and range of R2 and MAE."""
    order = F.struct(-F.col("r2"), F.col("model_name"))
    columns = []
    for label, pick in (("best", F.min_by), ("worst", F.max_by)):
        columns += [
            pick(c, order).alias(f"{label}_{a}")
            for c, a in (
                ("model_name", "model"),
                ("model_type", "type"),
                ("r2", "r2"),
                ("mae", "mae"),
                ("rmse", "rmse"),
            )
        ]
    for c in ("r2", "mae"):
        columns += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_std"),
            (F.max(c) - F.min(c)).alias(f"{c}_range"),
        ]
    return metrics.agg(*columns, F.count("*").alias("total_models"))


def _numbered(sentences: DataFrame) -> DataFrame:
    """An array column `lines` with gaps becomes numbered rows."""
    lines = F.array_compact(F.col("lines"))
    return sentences.select(F.posexplode(lines).alias("position", "line")).select(
        (F.col("position") + 1).alias("position"), "line"
    )


def interpretations(metrics: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """Sentences on level, spread, best type and significance."""
    order = F.struct(-F.col("r2"), F.col("model_name"))
    best = F.max("r2")
    spread = F.max("r2") - F.min("r2")
    lines = [
        tier_text(best),
        F.when(spread > VARIATION_RANGE, texts.VARIATION_TEXT).otherwise(texts.SIMILAR_TEXT),
        F.when(
            F.count_distinct("model_type") > 1,
            F.format_string(texts.BEST_TYPE_TEXT, F.min_by("model_type", order)),
        ),
    ]
    summary = metrics.agg(F.array(*lines).alias("lines"))
    if tests is not None:
        counts = tests.agg(
            F.count_if("is_significant").alias("_hit"), F.count("*").alias("_all")
        )
        hit, total = counts.select("_hit").scalar(), counts.select("_all").scalar()
        sentence = F.when(
            hit > 0, F.format_string(texts.SIGNIFICANT_TEXT, hit, total)
        ).when(total > 0, texts.NOT_SIGNIFICANT_TEXT)
        summary = summary.select(F.concat("lines", F.array(sentence)).alias("lines"))
    return _numbered(summary)


def recommendations(metrics: DataFrame) -> DataFrame:
    """Sentences on the model to use and what to improve."""
    order = F.struct(-F.col("r2"), F.col("model_name"))
    lines = [
        F.format_string(
            texts.RECOMMENDED_TEXT, F.min_by("model_name", order), F.min_by("model_type", order)
        ),
        F.when(F.max("r2") < IMPROVE_BELOW, texts.IMPROVE_TEXT),
        F.when(F.max("mape") > HIGH_MAPE, texts.HIGH_MAPE_TEXT),
        F.when(F.count("*") > MANY_MODELS, texts.MANY_MODELS_TEXT),
    ]
    return _numbered(metrics.agg(F.array(*lines).alias("lines")))


def gain_percent(new: Column, old: Column) -> Column:
    """Change in percent of the size of the old value; 0 when that is 0."""
    return F.when(old == 0, 0.0).otherwise((new - old) / F.abs(old) * 100)


def fusion_effectiveness(
    metrics: DataFrame, fused: Sequence[str], single: Sequence[str]
) -> DataFrame:
    """Does the best fusion beat the best component?"""
    best = metrics.agg(best_of(fused).alias("fusion_r2"), best_of(single).alias("component_r2"))
    return best.withColumns(
        {
            "difference": F.col("fusion_r2") - F.col("component_r2"),
            "is_effective": F.col("fusion_r2") > F.col("component_r2"),
        }
    )


def vertical_vs_monolithic(
    metrics: DataFrame, fused: Sequence[str], monolithic: str
) -> DataFrame:
    """Which approach wins and by how much of the monolithic R2."""
    both = metrics.agg(best_of(fused).alias("vertical_r2"), r2_of(monolithic).alias("mono_r2"))
    v, m = F.col("vertical_r2"), F.col("mono_r2")
    return both.withColumns(
        {
            "winner": F.when(v > m, "vertical").otherwise("monolithic"),
            "gain_percent": gain_percent(v, m),
        }
    )


def horizontal_comparison(subsets: DataFrame, by: str = "segment") -> DataFrame:
    """Name the rolled-up metrics of the `global` and `specialised` predictions.

    Specialised models are scored on their segment, the global one on all rows and
    on each segment.
    """
    place = F.lower(F.col(by))
    special = F.col("model_name") == "specialised"
    name = (
        F.when(special, F.concat(place, F.lit("_model")))
        .when(F.col(by).isNull(), F.lit("global_model"))
        .otherwise(F.concat(F.lit("global_model_"), place))
    )
    kept = subsets.filter(~(special & F.col(by).isNull()))
    return (
        kept.withColumn("scope", F.col("model_name"))
        .withColumn("model_name", name)
        .orderBy(F.desc("r2"), "model_name")
    )


def segment_improvement(comparison: DataFrame, by: str = "segment") -> DataFrame:
    """Specialised against global R2 on the rows of each segment."""
    def r2(scope: str) -> Column:
        return F.max(F.when(F.col("scope") == scope, F.col("r2")))

    sides = (
        comparison.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(r2("specialised").alias("specialised_r2"), r2("global").alias("global_r2"))
    )
    s, g = F.col("specialised_r2"), F.col("global_r2")
    return sides.withColumns({"improvement": gain_percent(s, g), "is_better": s > g})


def horizontal_effect(comparison: DataFrame, by: str = "segment") -> DataFrame:
    """Mean specialised R2 against the global R2 on all rows."""
    overall = comparison.agg(
        F.avg(F.when(F.col("scope") == "specialised", F.col("r2"))).alias("specialised_r2"),
        r2_of("global_model").alias("global_r2"),
    )
    gain = gain_percent(F.col("specialised_r2"), F.col("global_r2"))
    grade = (
        F.when(gain > EFFECTIVE_ABOVE, "effective")
        .when(gain > 0, "moderate")
        .otherwise("limited")
    )
    return overall.withColumns({"improvement": gain, "effect": grade})


def overfit_check(split_metrics: DataFrame, split: str = "split") -> DataFrame:
    """R2 on training rows minus R2 on test rows; a large gap is flagged."""
    def r2(side: str) -> Column:
        return F.max(F.when(F.col(split) == side, F.col("r2")))

    sides = split_metrics.groupBy("model_name").agg(
        r2("train").alias("train_r2"), r2("test").alias("test_r2")
    )
    gap = F.col("train_r2") - F.col("test_r2")
    return sides.withColumns({"gap": gap, "is_overfit": gap > OVERFIT_GAP})


def bias_check(metrics: DataFrame) -> DataFrame:
    """Mean residual near zero, or the direction of the bias."""
    mean = F.col("mean_residual")
    verdict = (
        F.when(F.abs(mean) < UNBIASED_BELOW, "unbiased")
        .when(mean < 0, "over-prediction")
        .otherwise("under-prediction")
    )
    return metrics.select("model_name", "mean_residual", verdict.alias("bias"))


def feature_group_strength(
    metrics: DataFrame, infra: str, user: str, weighted: str, meta: str
) -> DataFrame:
    """Stronger feature group and stronger fusion with their leads in R2."""
    r2s = metrics.agg(
        r2_of(infra).alias("infra_r2"),
        r2_of(user).alias("user_r2"),
        r2_of(weighted).alias("weighted_r2"),
        r2_of(meta).alias("meta_r2"),
    )
    i, u, w, m = (F.col(c) for c in ("infra_r2", "user_r2", "weighted_r2", "meta_r2"))
    return r2s.withColumns(
        {
            "stronger_group": F.when(i > u, "Infrastructure").otherwise("User Behavior"),
            "group_gap": F.abs(i - u),
            "better_fusion": F.when(m > w, "meta-learner").otherwise("weighted average"),
            "fusion_gap": F.abs(m - w),
        }
    )


def strategy(
    metrics: DataFrame,
    monolithic: str,
    infra: str,
    user: str,
    weighted: str,
    meta: str,
) -> DataFrame:
    """Advice on deployment, architecture, feature work and enhancement."""
    r2s = metrics.agg(
        F.max("r2").alias("best"),
        best_of([weighted, meta]).alias("fused"),
        r2_of(monolithic).alias("mono"),
        r2_of(infra).alias("infra"),
        r2_of(user).alias("user"),
        r2_of(weighted).alias("weighted"),
        r2_of(meta).alias("meta"),
    )
    best = F.col("best")
    return r2s.select(
        F.when(best > EXCELLENT, texts.DEPLOY_READY)
        .when(best > GOOD, texts.DEPLOY_GOOD)
        .otherwise(texts.DEPLOY_NOT_READY)
        .alias("deployment"),
        F.when(F.col("fused") > F.col("mono"), texts.ADOPT_VERTICAL)
        .otherwise(texts.ADOPT_MONOLITHIC)
        .alias("architecture"),
        F.when(F.col("meta") > F.col("weighted"), "meta-learner")
        .otherwise("weighted average")
        .alias("fusion_strategy"),
        F.when(F.col("infra") > F.col("user"), "infrastructure")
        .otherwise("user behavior")
        .alias("priority_features"),
        F.when(F.col("meta") > F.col("weighted"), texts.ENHANCE_META)
        .otherwise(texts.ENHANCE_SIMPLE)
        .alias("enhancement"),
    )


def segment_insights(comparison: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Sentences on the best model and on where specialising helps."""
    order = F.struct(-F.col("r2"), F.col("model_name"))
    best = F.min_by("model_name", order)
    winner = F.when(best == "global_model", texts.BEST_GLOBAL_TEXT)
    lines = []
    for s in segments:
        model, rival = f"{s.lower()}_model", f"global_model_{s.lower()}"
        winner = winner.when(best == model, texts.BEST_SEGMENT_TEXT % s)
        mine, other = r2_of(model), r2_of(rival)
        gained = F.format_string(texts.SEGMENT_GAIN_TEXT, F.lit(s), gain_percent(mine, other))
        known = mine.isNotNull() & other.isNotNull()
        lines.append(
            F.when(known & (mine > other), gained).when(known, texts.SEGMENT_LIMITED_TEXT % s)
        )
    return _numbered(comparison.agg(F.array(winner, *lines).alias("lines")))


def report_lines(
    title: str, comparison: DataFrame, sections: Mapping[str, DataFrame]
) -> DataFrame:
    """Text report as numbered lines: title, best model, table, one block per section."""
    spark = comparison.sparkSession
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("r2"), "model_name")
    cells = F.format_string(
        "%s  R2=%.4f  MAE=%.4f  RMSE=%.4f", "model_name", F.col("r2"), F.col("mae"), F.col("rmse")
    )
    table = comparison.select(F.row_number().over(order).alias("n"), cells.alias("line"))
    best = table.filter("n = 1").select(
        F.lit(0).alias("n"), F.concat(F.lit("Best model: "), "line").alias("line")
    )

    def block(number: int, heading: str, body: DataFrame) -> DataFrame:
        head = spark.createDataFrame(
            [(-2, heading), (-1, "-" * len(heading))], "n int, line string"
        )
        return head.unionByName(body.select("n", "line")).select(
            F.lit(number).alias("block"), "n", "line"
        )

    head = [(0, -2, title), (0, -1, "=" * len(title))]
    report = spark.createDataFrame(head, "block int, n int, line string")
    report = report.unionByName(block(1, "SUMMARY", best)).unionByName(
        block(2, "COMPARISON", table)
    )
    for i, (heading, body) in enumerate(sections.items()):
        numbered = body.select(
            F.col("position").alias("n"), F.format_string("%d. %s", "position", "line").alias("line")
        )
        report = report.unionByName(block(3 + i, heading, numbered))
    position = Window.partitionBy(F.lit(0)).orderBy("block", "n")
    return report.select(F.row_number().over(position).alias("line_number"), "line")
