"""Queries on scored rows: fusion, metrics, tests and report rules."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.catalog import predictors as P
from cellgauge.catalog import sqltext as Q
from cellgauge.catalog.registry import query, rounded, sql_rounded
from cellgauge.functions import texts
from cellgauge.operators import evaluate, fusion, report, significance
from cellgauge.operators.partition import SEGMENT, SPLIT, TEST

MODELS = {m: m for m in Q.MODELS}
SINGLES = {m: m for m in Q.MODELS[:3]}
FUSED = ["fusion_weighted", "fusion_meta"]
QQ_PROBS = [i / 20 for i in range(1, 20)]


def sql(*ctes: str, select: str) -> str:
    return Q.with_ctes(*ctes, select=select)


def test_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(SPLIT) == TEST)


def metrics(spark, sf_dir) -> DataFrame:
    scored = test_rows(P.all_models(spark, sf_dir))
    return evaluate.comparison_table(evaluate.model_metrics(scored, MODELS), Q.TYPES)


def horizontal(spark, sf_dir) -> DataFrame:
    single = P.single_models(spark, sf_dir)
    rows = test_rows(single).withColumn(
        "specialised", F.coalesce("urban_model", "rural_model")
    )
    models = {"global": P.A, "specialised": "specialised"}
    subsets = evaluate.model_metrics(rows, models, "y", [SEGMENT], totals=True)
    return report.horizontal_comparison(subsets)


# --- cross-validation and fusion ----------------------------------------------------


@query(
    "cv_fold_mse",
    sql(*Q.FOLD_SCORES, select=sql_rounded("SELECT * FROM fold_mse", ["mse"])),
)
def cv_fold_mse(spark, sf_dir):
    return rounded(P.fold_scores(P.single_models(spark, sf_dir)))


_CV = """cv AS (
  SELECT model_name, avg(-mse) AS cv_mean, stddev_pop(-mse) AS cv_std, min(-mse) AS cv_min,
         max(-mse) AS cv_max FROM fold_mse GROUP BY model_name
)"""


@query(
    "cv_summary",
    sql(
        *Q.FOLD_SCORES,
        _CV,
        select=sql_rounded("SELECT * FROM cv", ["cv_mean", "cv_std", "cv_min", "cv_max"]),
    ),
)
def cv_summary(spark, sf_dir):
    return rounded(evaluate.cv_summary(P.fold_scores(P.single_models(spark, sf_dir))))


@query(
    "fusion_weights",
    sql(
        *Q.FOLD_SCORES,
        Q.WEIGHTS,
        select=sql_rounded(
            "SELECT * FROM weights", ["mse_a", "mse_b", "weight_a", "weight_b"]
        ),
    ),
)
def fusion_weights(spark, sf_dir):
    return rounded(P.weights(P.single_models(spark, sf_dir)))


@query(
    "fusion_weight_share",
    sql(
        *Q.FOLD_SCORES,
        Q.WEIGHTS,
        select=sql_rounded(
            "SELECT weight_a / (weight_a + weight_b) * 100 AS share_a, "
            "weight_b / (weight_a + weight_b) * 100 AS share_b, "
            "CASE WHEN weight_a > weight_b THEN 'infrastructure_model' "
            "ELSE 'user_behavior_model' END AS dominant FROM weights",
            ["share_a", "share_b"],
        ),
    ),
)
def fusion_weight_share(spark, sf_dir):
    return rounded(fusion.weight_share(P.weights(P.single_models(spark, sf_dir)), P.A, P.B))


@query(
    "fusion_weighted",
    sql(
        *Q.FUSED,
        select=sql_rounded(
            "SELECT tower_id, y, fusion_weighted FROM scored", ["fusion_weighted"], 4
        ),
    ),
)
def fusion_weighted(spark, sf_dir):
    scored = P.all_models(spark, sf_dir).select("tower_id", "y", "fusion_weighted")
    return rounded(scored, 4, ["fusion_weighted"])


@query(
    "fusion_meta",
    sql(
        *Q.FUSED,
        select=sql_rounded(
            "SELECT meta_a AS weight_a, meta_b AS weight_b, meta_c AS intercept FROM meta",
            ["weight_a", "weight_b", "intercept"],
        ),
    ),
)
def fusion_meta(spark, sf_dir):
    return rounded(P.meta(P.single_models(spark, sf_dir)))


@query(
    "fusion_meta_predictions",
    sql(
        *Q.FUSED,
        select=sql_rounded("SELECT tower_id, y, fusion_meta FROM scored", ["fusion_meta"], 4),
    ),
)
def fusion_meta_predictions(spark, sf_dir):
    scored = P.all_models(spark, sf_dir).select("tower_id", "y", "fusion_meta")
    return rounded(scored, 4, ["fusion_meta"])


_COMPARED = [P.A, P.B, *FUSED]


@query(
    "fusion_comparison",
    sql(
        *Q.FUSED,
        select=sql_rounded(
            Q.metrics_select(_COMPARED, "scored", group="WHERE split = 'test'"), Q.METRIC_NAMES
        ),
    ),
)
def fusion_comparison(spark, sf_dir):
    scored = test_rows(P.all_models(spark, sf_dir))
    return rounded(fusion.fusion_comparison(scored, {m: m for m in _COMPARED}))


@query(
    "score_routing",
    sql(
        *Q.SINGLE,
        select=sql_rounded(
            "SELECT tower_id, segment, y, infrastructure_model AS global_model, urban_model, "
            "rural_model FROM single",
            ["global_model", "urban_model", "rural_model"],
            4,
        ),
    ),
)
def score_routing(spark, sf_dir):
    single = P.single_models(spark, sf_dir)
    routed = single.select(
        "tower_id", "segment", "y", F.col(P.A).alias("global_model"), "urban_model", "rural_model"
    )
    return rounded(routed, 4, ["global_model", "urban_model", "rural_model"])


# --- metrics ------------------------------------------------------------------------


@query(
    "regression_metrics",
    sql(
        *Q.SINGLE,
        select=sql_rounded(
            "SELECT model_name, mae, rmse, r2 FROM ("
            + Q.metrics_select(list(SINGLES), "single", group="WHERE split = 'test'")
            + ")",
            ["mae", "rmse", "r2"],
        ),
    ),
)
def regression_metrics(spark, sf_dir):
    rows = test_rows(P.single_models(spark, sf_dir))
    return rounded(evaluate.regression_metrics(rows, SINGLES))


_EXTENDED = sql(
    *Q.SINGLE,
    select=sql_rounded(
        Q.metrics_select(list(SINGLES), "single", group="WHERE split = 'test'"), Q.METRIC_NAMES
    ),
)


@query("extended_metrics", _EXTENDED)
def extended_metrics(spark, sf_dir):
    rows = test_rows(P.single_models(spark, sf_dir))
    return rounded(evaluate.model_metrics(rows, SINGLES))


@query("long_metrics", _EXTENDED)
def long_metrics(spark, sf_dir):
    rows = test_rows(P.single_models(spark, sf_dir))
    long = evaluate.unpivot_predictions(rows, SINGLES, ["tower_id", "y"])
    return rounded(evaluate.long_metrics(long))


@query(
    "mape",
    sql(
        *Q.SINGLE,
        select=sql_rounded(
            "SELECT model_name, mape FROM ("
            + Q.metrics_select(list(SINGLES), "single", group="WHERE split = 'test'")
            + ")",
            ["mape"],
        ),
    ),
)
def mape(spark, sf_dir):
    rows = test_rows(P.single_models(spark, sf_dir))
    return rounded(evaluate.model_metrics(rows, SINGLES).select("model_name", "mape"))


@query(
    "model_comparison",
    sql(*Q.TESTED, select=sql_rounded("SELECT * FROM metrics", Q.METRIC_NAMES)),
)
def model_comparison(spark, sf_dir):
    return rounded(metrics(spark, sf_dir))


@query(
    "subset_metrics",
    sql(
        *Q.HORIZONTAL,
        select=sql_rounded(
            f"SELECT segment, model_name, {', '.join(Q.METRIC_NAMES)}, sample_size "
            "FROM horizontal",
            Q.METRIC_NAMES,
        ),
    ),
)
def subset_metrics(spark, sf_dir):
    return rounded(horizontal(spark, sf_dir).drop("scope"))


@query(
    "performance_table",
    sql(
        *Q.TESTED,
        _CV,
        select=sql_rounded(
            "SELECT row_number() OVER (ORDER BY r2 DESC, model_name) AS rank, metrics.*, "
            "cv_mean AS cv_score_mean, cv_std AS cv_score_std "
            "FROM metrics LEFT JOIN cv USING (model_name)",
            [*Q.METRIC_NAMES, "cv_score_mean", "cv_score_std"],
        ),
    ),
)
def performance_table(spark, sf_dir):
    scored = P.all_models(spark, sf_dir)
    stats = evaluate.model_metrics(test_rows(scored), MODELS)
    comparison = evaluate.comparison_table(stats, Q.TYPES)
    cv = evaluate.cv_summary(P.fold_scores(scored))
    return rounded(evaluate.performance_table(comparison, cv))


@query(
    "best_worst_model",
    sql(
        *Q.TESTED,
        select="SELECT (SELECT model_name FROM metrics ORDER BY r2 DESC, model_name LIMIT 1) "
        "AS best_model, round(max(r2), 6) AS best_r2, "
        "(SELECT model_name FROM metrics ORDER BY r2, model_name DESC LIMIT 1) AS worst_model, "
        "round(min(r2), 6) AS worst_r2 FROM metrics",
    ),
)
def best_worst_model(spark, sf_dir):
    return rounded(evaluate.best_worst(metrics(spark, sf_dir)))


@query(
    "normalized_metrics",
    sql(
        *Q.TESTED,
        select=sql_rounded(
            "SELECT model_name, r2, 1 - mae / (SELECT max(mae) FROM metrics) AS mae_score, "
            "1 - rmse / (SELECT max(rmse) FROM metrics) AS rmse_score FROM metrics",
            ["r2", "mae_score", "rmse_score"],
        ),
    ),
)
def normalized_metrics(spark, sf_dir):
    return rounded(evaluate.normalized_metrics(metrics(spark, sf_dir)))


# --- significance -------------------------------------------------------------------


def _pair_sql(a: str, b: str, source: str) -> str:
    return f"""SELECT '{a}' AS model1, '{b}' AS model2, 'Paired t-test' AS test_name,
      avg(d) / (stddev_samp(d) / sqrt(count(d))) AS statistic,
      avg(d) / stddev_pop(d) AS effect_size, avg(r1) AS mae_model1, avg(r2) AS mae_model2,
      avg(r1) - avg(r2) AS mae_difference, count(d) AS sample_size
    FROM (SELECT abs(y - {a}) AS r1, abs(y - {b}) AS r2, abs(y - {a}) - abs(y - {b}) AS d
          FROM {source} WHERE split = 'test' AND {a} IS NOT NULL AND {b} IS NOT NULL)"""


_TEST_COLUMNS = ["statistic", "effect_size", "mae_model1", "mae_model2", "mae_difference"]


@query(
    "paired_t_test",
    sql(*Q.SINGLE, select=sql_rounded(_pair_sql(P.A, P.B, "single"), _TEST_COLUMNS)),
)
def paired_t_test(spark, sf_dir):
    rows = test_rows(P.single_models(spark, sf_dir))
    tests = significance.paired_t_tests(rows, {P.A: P.A, P.B: P.B})
    return rounded(tests.drop("p_value", "alpha", "is_significant"))


_PAIRS = [(a, b) for i, a in enumerate(Q.MODELS) for b in Q.MODELS[i + 1 :]]


@query(
    "significance_pairs",
    sql(
        *Q.FUSED,
        select=sql_rounded(
            " UNION ALL ".join(_pair_sql(a, b, "scored") for a, b in _PAIRS), _TEST_COLUMNS
        ),
    ),
)
def significance_pairs(spark, sf_dir):
    rows = test_rows(P.all_models(spark, sf_dir))
    tests = significance.paired_t_tests(rows, MODELS)
    return rounded(tests.drop("p_value", "alpha", "is_significant"))


@query(
    "significance_verdict",
    # Beyond 10 deviations the tail is below 1e-20, so p prints as 0.0000.
    sql(
        *Q.SINGLE,
        select="SELECT model1, model2, abs(statistic) > 10 AS is_significant, "
        "'The performance difference is statistically significant (p=0.0000 < 0.05). ' || "
        "CASE WHEN mae_model1 < mae_model2 "
        "THEN 'Model 1 performs significantly better than Model 2.' "
        "ELSE 'Model 2 performs significantly better than Model 1.' END AS interpretation "
        f"FROM ({_pair_sql(P.A, P.B, 'single')}) WHERE abs(statistic) > 10",
    ),
)
def significance_verdict(spark, sf_dir):
    rows = test_rows(P.single_models(spark, sf_dir))
    tests = significance.verdicts(significance.paired_t_tests(rows, {P.A: P.A, P.B: P.B}))
    return tests.select("model1", "model2", "is_significant", "interpretation")


# Models close to each other: the p-values are neither 0 nor 1.
CLOSE = {P.A: P.A, "shifted": "shifted", "oof_a": "oof_a"}
SHIFT = 0.01
_CLOSE = f"close AS (SELECT *, {P.A} + CAST({SHIFT} AS DOUBLE) AS shifted FROM single)"


def close_models(spark, sf_dir) -> DataFrame:
    """A model, the same moved by a constant, and its predictions out of fold."""
    return test_rows(P.single_models(spark, sf_dir)).withColumn("shifted", F.col(P.A) + SHIFT)


def _tail_sql(density: str, x: str, source: str) -> str:
    """`source` with the two-sided tail at |x|: one less twice Simpson's rule from 0 to it."""
    weight = "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    points = f"list_sum([{weight} * {density} FOR i IN range(2001)])"
    return (
        f"(SELECT *, greatest(0, 1 - 2 * h / 3 * {points}) AS p_value "
        f"FROM (SELECT *, least(abs({x}), 12) / 2000 AS h FROM ({source})) AS s)"
    )


_STUDENT = """exp(lgamma(sample_size / 2) - lgamma((sample_size - 1) / 2)
  - ln((sample_size - 1) * pi()) / 2 - sample_size / 2 * ln(1 + i * h * i * h / (sample_size - 1)))"""
_NORMAL = "exp(-i * h * i * h / 2) / sqrt(2 * pi())"


@query(
    "significance_p_values",
    sql(
        *Q.SINGLE,
        _CLOSE,
        select=f"""SELECT model1, model2, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value,
          CAST(0.05 AS DOUBLE) AS alpha, p_value < 0.05 AS is_significant,
          CASE WHEN p_value < 0.05 THEN
            'The performance difference is statistically significant (p=' || printf('%.4f', p_value)
            || ' < 0.05). ' || CASE WHEN mae_model1 < mae_model2
              THEN 'Model 1 performs significantly better than Model 2.'
              ELSE 'Model 2 performs significantly better than Model 1.' END
          ELSE 'The performance difference is not statistically significant (p='
            || printf('%.4f', p_value)
            || ' >= 0.05). There is no significant difference between the models.'
          END AS interpretation
        FROM {_tail_sql(_STUDENT, "statistic", " UNION ALL ".join(
            _pair_sql(a, b, "close")
            for a, b in ((P.A, "shifted"), (P.A, "oof_a"), ("shifted", "oof_a"))
        ))} AS tested""",
    ),
)
def significance_p_values(spark, sf_dir):
    tests = significance.verdicts(significance.paired_t_tests(close_models(spark, sf_dir), CLOSE))
    out = tests.select(
        "model1", "model2", "statistic", "p_value", "alpha", "is_significant", "interpretation"
    )
    return rounded(out, only=["statistic", "p_value"])


def _ranks_sql(a: str, b: str, source: str) -> str:
    return f"""diffs AS (
          SELECT CAST(round((abs(y - {a}) - abs(y - {b})) * 1000000) AS BIGINT) AS u
          FROM {source} WHERE split = 'test'
        ), ranked AS (
          SELECT u, rank() OVER (ORDER BY abs(u)) + (count(*) OVER (PARTITION BY abs(u)) - 1) / 2
                 AS r, count(*) OVER (PARTITION BY abs(u)) AS t FROM diffs
        ), sums AS (
          SELECT sum(CASE WHEN u > 0 THEN r WHEN u = 0 THEN r / 2 ELSE 0 END) AS rank_plus,
                 sum(CASE WHEN u < 0 THEN r WHEN u = 0 THEN r / 2 ELSE 0 END) AS rank_minus,
                 count(*) AS sample_size, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM ranked
        )"""


_SIGNED_RANK = """SELECT rank_plus, rank_minus, least(rank_plus, rank_minus) AS statistic,
              (least(rank_plus, rank_minus) - n * (n + 1) / 4)
                / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z, sample_size
            FROM (SELECT *, CAST(sample_size AS DOUBLE) AS n FROM sums) """


@query(
    "wilcoxon",
    sql(
        *Q.SINGLE,
        _ranks_sql(P.A, P.B, "single"),
        select=sql_rounded(_SIGNED_RANK, ["rank_plus", "rank_minus", "statistic", "z"], 3),
    ),
)
def wilcoxon(spark, sf_dir):
    rows = test_rows(P.single_models(spark, sf_dir))
    out = significance.wilcoxon(rows, P.A, P.B)
    return rounded(
        out.select("rank_plus", "rank_minus", "statistic", "z", "sample_size"), 3
    )


@query(
    "wilcoxon_p_value",
    sql(
        *Q.SINGLE,
        _CLOSE,
        _ranks_sql(P.A, "oof_a", "close"),
        select="SELECT round(z, 6) AS z, round(p_value, 6) AS p_value, sample_size, "
        "CAST(0.05 AS DOUBLE) AS alpha, p_value < 0.05 AS is_significant "
        f"FROM {_tail_sql(_NORMAL, 'z', _SIGNED_RANK)} AS tested",
    ),
)
def wilcoxon_p_value(spark, sf_dir):
    out = significance.wilcoxon(close_models(spark, sf_dir), P.A, "oof_a")
    out = out.select("z", "p_value", "sample_size", "alpha", "is_significant")
    return rounded(out, only=["z", "p_value"])


# --- residuals ----------------------------------------------------------------------


@query(
    "residual_stats",
    sql(
        *Q.SINGLE,
        select=sql_rounded(
            " UNION ALL ".join(
                f"SELECT '{m}' AS model_name, avg(y - {m}) AS mean, stddev_pop(y - {m}) AS std, "
                f"min(y - {m}) AS min, max(y - {m}) AS max FROM single WHERE split = 'test'"
                for m in SINGLES
            ),
            ["mean", "std", "min", "max"],
        ),
    ),
)
def residual_stats(spark, sf_dir):
    rows = test_rows(P.single_models(spark, sf_dir))
    return rounded(evaluate.residual_stats(rows, SINGLES))


@query(
    "residual_qq",
    sql(
        *Q.SINGLE,
        select=sql_rounded(
            " UNION ALL ".join(
                f"SELECT CAST({p} AS DOUBLE) AS prob, "
                f"CAST({NormalDist().inv_cdf(p)!r} AS DOUBLE) AS theoretical, "
                f"quantile_cont(y - {P.A}, {p}) AS sample FROM single WHERE split = 'test'"
                for p in QQ_PROBS
            ),
            ["prob", "theoretical", "sample"],
        ),
    ),
)
def residual_qq(spark, sf_dir):
    rows = test_rows(P.single_models(spark, sf_dir))
    return rounded(evaluate.residual_qq(rows, P.A, QQ_PROBS))


@query(
    "prediction_points",
    sql(
        *Q.SINGLE,
        select=sql_rounded(
            f"SELECT y AS actual, {P.A} AS predicted, y - {P.A} AS residual FROM single "
            "WHERE split = 'test'",
            ["predicted", "residual"],
            4,
        ),
    ),
)
def prediction_points(spark, sf_dir):
    rows = test_rows(P.single_models(spark, sf_dir))
    out = evaluate.prediction_points(rows, P.A)
    return rounded(out, 4, ["predicted", "residual"])


# --- report rules -------------------------------------------------------------------

_TIER = """CASE WHEN r2 > 0.8 THEN 'excellent' WHEN r2 > 0.6 THEN 'good'
  WHEN r2 > 0.4 THEN 'moderate' ELSE 'below' END"""
_BEST = "(SELECT {} FROM metrics ORDER BY r2 DESC, model_name LIMIT 1)"
_WORST = "(SELECT {} FROM metrics ORDER BY r2, model_name DESC LIMIT 1)"


def _r2(model: str) -> str:
    return f"(SELECT r2 FROM metrics WHERE model_name = '{model}')"


_FUSED_R2 = f"greatest({_r2('fusion_weighted')}, {_r2('fusion_meta')})"


@query(
    "r2_tier",
    sql(
        *Q.TESTED, select=f"SELECT model_name, round(r2, 6) AS r2, {_TIER} AS tier FROM metrics"
    ),
)
def r2_tier(spark, sf_dir):
    return rounded(report.r2_tiers(metrics(spark, sf_dir)))


_FINDINGS = [f"{c}_{s}" for c in ("r2", "mae") for s in ("mean", "std", "range")]


@query(
    "summary_findings",
    sql(
        *Q.TESTED,
        select=sql_rounded(
            "SELECT "
            + ", ".join(
                f"{side.format(c)} AS {label}_{a}"
                for label, side in (("best", _BEST), ("worst", _WORST))
                for c, a in (
                    ("model_name", "model"),
                    ("model_type", "type"),
                    ("r2", "r2"),
                    ("mae", "mae"),
                    ("rmse", "rmse"),
                )
            )
            + ", "
            + ", ".join(
                f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, max({c}) - min({c}) "
                f"AS {c}_range"
                for c in ("r2", "mae")
            )
            + ", count(*) AS total_models FROM metrics",
            [
                *_FINDINGS,
                *[f"{s}_{c}" for s in ("best", "worst") for c in ("r2", "mae", "rmse")],
            ],
        ),
    ),
)
def summary_findings(spark, sf_dir):
    return rounded(report.summary_findings(metrics(spark, sf_dir)))


@query(
    "interpretations",
    sql(
        *Q.TESTED,
        select="SELECT 1 AS position, CASE (SELECT "
        + _TIER.replace("r2", "max(r2)")
        + " FROM metrics) "
        + " ".join(f"WHEN '{t}' THEN '{text}'" for t, text in texts.TIER_TEXTS.items())
        + " END AS line UNION ALL SELECT 2, CASE WHEN (SELECT max(r2) - min(r2) FROM metrics) "
        f"> 0.2 THEN '{texts.VARIATION_TEXT}' ELSE '{texts.SIMILAR_TEXT}' END "
        "UNION ALL SELECT 3, 'Best performing model type: ' || " + _BEST.format("model_type"),
    ),
)
def interpretations(spark, sf_dir):
    return report.interpretations(metrics(spark, sf_dir))


@query(
    "recommendations",
    sql(
        *Q.TESTED,
        select=f"""SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS position, line
        FROM (
          SELECT 1 AS place, 'Recommended model: ' || {_BEST.format("model_name")} || ' (' ||
                 {_BEST.format("model_type")} || ')' AS line
          UNION ALL SELECT 2, '{texts.IMPROVE_TEXT}' WHERE (SELECT max(r2) FROM metrics) < 0.7
          UNION ALL SELECT 3, '{texts.HIGH_MAPE_TEXT}'
            WHERE (SELECT max(mape) FROM metrics) > 20
          UNION ALL SELECT 4, '{texts.MANY_MODELS_TEXT}'
            WHERE (SELECT count(*) FROM metrics) > 3
        )""",
    ),
)
def recommendations(spark, sf_dir):
    return report.recommendations(metrics(spark, sf_dir))


@query(
    "fusion_effectiveness",
    sql(
        *Q.TESTED,
        select=f"SELECT round(f, 6) AS fusion_r2, round(c, 6) AS component_r2, "
        f"round(f - c, 6) AS difference, f > c AS is_effective FROM (SELECT {_FUSED_R2} AS f, "
        f"greatest({_r2(P.A)}, {_r2(P.B)}) AS c)",
    ),
)
def fusion_effectiveness(spark, sf_dir):
    return rounded(report.fusion_effectiveness(metrics(spark, sf_dir), FUSED, [P.A, P.B]))


@query(
    "vertical_vs_monolithic",
    sql(
        *Q.TESTED,
        select=f"""SELECT round(v, 6) AS vertical_r2, round(m, 6) AS mono_r2,
          CASE WHEN v > m THEN 'vertical' ELSE 'monolithic' END AS winner,
          round(CASE WHEN m = 0 THEN 0 ELSE (v - m) / abs(m) * 100 END, 3) AS gain_percent
        FROM (SELECT {_FUSED_R2} AS v, {_r2(P.M)} AS m)""",
    ),
)
def vertical_vs_monolithic(spark, sf_dir):
    out = report.vertical_vs_monolithic(metrics(spark, sf_dir), FUSED, P.M)
    return rounded(rounded(out, 6, ["vertical_r2", "mono_r2"]), 3, ["gain_percent"])


_SIDE_BY_SIDE = """sides AS (
  SELECT segment, max(r2) FILTER (WHERE scope = 'specialised') AS s,
         max(r2) FILTER (WHERE scope = 'global') AS g
  FROM horizontal WHERE segment IS NOT NULL GROUP BY segment
)"""


@query(
    "segment_improvement",
    sql(
        *Q.HORIZONTAL,
        _SIDE_BY_SIDE,
        select="SELECT segment, round(s, 6) AS specialised_r2, round(g, 6) AS global_r2, "
        "round(CASE WHEN g = 0 THEN 0 ELSE (s - g) / abs(g) * 100 END, 6) AS improvement, "
        "s > g AS is_better FROM sides",
    ),
)
def segment_improvement(spark, sf_dir):
    return rounded(report.segment_improvement(horizontal(spark, sf_dir)))


@query(
    "horizontal_effect",
    sql(
        *Q.HORIZONTAL,
        select="""SELECT round(s, 6) AS specialised_r2, round(g, 6) AS global_r2,
          round((s - g) / abs(g) * 100, 6) AS improvement,
          CASE WHEN (s - g) / abs(g) * 100 > 5 THEN 'effective'
               WHEN (s - g) / abs(g) * 100 > 0 THEN 'moderate' ELSE 'limited' END AS effect
        FROM (SELECT avg(r2) FILTER (WHERE scope = 'specialised') AS s,
                     max(r2) FILTER (WHERE model_name = 'global_model') AS g FROM horizontal)""",
    ),
)
def horizontal_effect(spark, sf_dir):
    return rounded(report.horizontal_effect(horizontal(spark, sf_dir)))


@query(
    "overfit_check",
    sql(
        *Q.FUSED,
        "by_split AS ("
        + Q.metrics_select(Q.MODELS, "scored", by="split", group="GROUP BY split")
        + ")",
        select="SELECT model_name, round(t, 6) AS train_r2, round(e, 6) AS test_r2, "
        "round(t - e, 6) AS gap, t - e > 0.1 AS is_overfit FROM (SELECT model_name, "
        "max(r2) FILTER (WHERE split = 'train') AS t, max(r2) FILTER (WHERE split = 'test') AS e "
        "FROM by_split GROUP BY model_name)",
    ),
)
def overfit_check(spark, sf_dir):
    scored = P.all_models(spark, sf_dir)
    return rounded(report.overfit_check(evaluate.model_metrics(scored, MODELS, "y", [SPLIT])))


@query(
    "bias_check",
    sql(
        *Q.TESTED,
        select="SELECT model_name, round(mean_residual, 6) AS mean_residual, "
        "CASE WHEN abs(mean_residual) < 1.0 THEN 'unbiased' WHEN mean_residual < 0 "
        "THEN 'over-prediction' ELSE 'under-prediction' END AS bias FROM metrics",
    ),
)
def bias_check(spark, sf_dir):
    return rounded(report.bias_check(metrics(spark, sf_dir)))


@query(
    "feature_group_strength",
    sql(
        *Q.TESTED,
        select=sql_rounded(
            "SELECT i AS infra_r2, u AS user_r2, w AS weighted_r2, m AS meta_r2, "
            "CASE WHEN i > u THEN 'Infrastructure' ELSE 'User Behavior' END AS stronger_group, "
            "abs(i - u) AS group_gap, CASE WHEN m > w THEN 'meta-learner' "
            "ELSE 'weighted average' END AS better_fusion, abs(m - w) AS fusion_gap "
            f"FROM (SELECT {_r2(P.A)} AS i, {_r2(P.B)} AS u, {_r2('fusion_weighted')} AS w, "
            f"{_r2('fusion_meta')} AS m)",
            ["infra_r2", "user_r2", "weighted_r2", "meta_r2", "group_gap", "fusion_gap"],
        ),
    ),
)
def feature_group_strength(spark, sf_dir):
    out = report.feature_group_strength(metrics(spark, sf_dir), P.A, P.B, *FUSED)
    return rounded(out)


@query(
    "strategy",
    sql(
        *Q.TESTED,
        select=f"""SELECT
          CASE WHEN best > 0.8 THEN '{texts.DEPLOY_READY}' WHEN best > 0.6
               THEN '{texts.DEPLOY_GOOD}' ELSE '{texts.DEPLOY_NOT_READY}' END AS deployment,
          CASE WHEN {_FUSED_R2} > {_r2(P.M)} THEN '{texts.ADOPT_VERTICAL}'
               ELSE '{texts.ADOPT_MONOLITHIC}' END AS architecture,
          CASE WHEN meta > wavg THEN 'meta-learner' ELSE 'weighted average' END
            AS fusion_strategy,
          CASE WHEN {_r2(P.A)} > {_r2(P.B)} THEN 'infrastructure' ELSE 'user behavior' END
            AS priority_features,
          CASE WHEN meta > wavg THEN '{texts.ENHANCE_META}' ELSE '{texts.ENHANCE_SIMPLE}' END
            AS enhancement
        FROM (SELECT (SELECT max(r2) FROM metrics) AS best, {_r2('fusion_meta')} AS meta,
                     {_r2('fusion_weighted')} AS wavg)""",
    ),
)
def strategy(spark, sf_dir):
    return report.strategy(metrics(spark, sf_dir), P.M, P.A, P.B, *FUSED)


def _insight_sql(place: int, segment: str) -> str:
    low = segment.lower()
    return f"""SELECT {place} AS place, CASE WHEN s > g
        THEN printf('{texts.SEGMENT_GAIN_TEXT}', '{segment}',
                    CASE WHEN g = 0 THEN 0 ELSE (s - g) / abs(g) * 100 END)
        ELSE '{texts.SEGMENT_LIMITED_TEXT % segment}' END AS line
      FROM (SELECT (SELECT r2 FROM horizontal WHERE model_name = '{low}_model') AS s,
                   (SELECT r2 FROM horizontal WHERE model_name = 'global_model_{low}') AS g)"""


@query(
    "segment_insights",
    sql(
        *Q.HORIZONTAL,
        select=f"""SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS position, line
        FROM (
          SELECT 1 AS place, CASE (SELECT model_name FROM horizontal
                                   ORDER BY r2 DESC, model_name LIMIT 1)
            WHEN 'global_model' THEN '{texts.BEST_GLOBAL_TEXT}'
            WHEN 'urban_model' THEN '{texts.BEST_SEGMENT_TEXT % "Urban"}'
            WHEN 'rural_model' THEN '{texts.BEST_SEGMENT_TEXT % "Rural"}' END AS line
          UNION ALL {_insight_sql(2, "Urban")} UNION ALL {_insight_sql(3, "Rural")}
        ) WHERE line IS NOT NULL""",
    ),
)
def segment_insights(spark, sf_dir):
    return report.segment_insights(horizontal(spark, sf_dir), texts.KNOWN_LOCATIONS)
