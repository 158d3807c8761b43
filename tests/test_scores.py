"""Metrics, tests, fusion and report rules against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.functions.pvalues import normal_two_sided, student_two_sided
from cellgauge.operators import evaluate, fusion, report, significance


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = rng.uniform(10, 100, 300)
    a, b = y + rng.normal(0, 5, 300), y + rng.normal(1, 9, 300)
    rows = [
        (float(t), float(p), float(q), float(y.mean()), "Urban" if i % 2 else "Rural")
        for i, (t, p, q) in enumerate(zip(y, a, b))
    ]
    return spark.createDataFrame(rows, "y double, a double, b double, m double, segment string").cache()


def arrays(df, *names):
    pandas = df.toPandas()
    return [pandas[n].to_numpy() for n in names]


def test_metrics_match_numpy(scored):
    y, a = arrays(scored, "y", "a")
    r = evaluate.model_metrics(scored, {"a": "a"}).first()
    e = y - a
    assert r["mae"] == pytest.approx(np.abs(e).mean())
    assert r["rmse"] == pytest.approx(np.sqrt((e * e).mean()))
    assert r["r2"] == pytest.approx(1 - (e * e).sum() / ((y - y.mean()) ** 2).sum())
    assert r["mape"] == pytest.approx(np.abs(e / y).mean() * 100)
    assert r["std_residual"] == pytest.approx(e.std())


def test_mean_predictor_has_no_r2_and_layout_does_not_matter(scored):
    r = evaluate.model_metrics(scored, {"m": "m"}).first()
    assert r["r2"] == pytest.approx(0, abs=1e-12)
    other = evaluate.model_metrics(scored.repartition(5), {"m": "m"}).first()
    assert other["mae"] == pytest.approx(r["mae"])


def test_edge_metrics(spark):
    df = spark.createDataFrame(
        [(5.0, 5.0, 4.0, 0.0), (5.0, 5.0, 6.0, 0.0), (5.0, None, float("nan"), 0.0)],
        "y double, same double, off double, zero double",
    )
    rows = {r["model_name"]: r for r in evaluate.model_metrics(df, {"same": "same", "off": "off"}).collect()}
    assert rows["same"]["r2"] == 1.0 and rows["same"]["sample_size"] == 2
    assert rows["off"]["r2"] == 0.0 and rows["off"]["sample_size"] == 2
    zero = evaluate.model_metrics(df, {"p": "y"}, y="zero").first()
    assert zero["mape"] == math.inf
    with pytest.raises(ValueError, match="empty"):
        evaluate.require_samples(evaluate.model_metrics(df.filter("y > 9"), {"p": "y"}))


def test_long_and_wide_metrics_agree(scored):
    models = {"a": "a", "b": "b"}
    wide = evaluate.model_metrics(scored, models, "y", ["segment"], totals=True)
    long = evaluate.unpivot_predictions(scored, models, ["segment", "y"])
    long = evaluate.long_metrics(long, ["segment", "model_name"])
    got = {(r["segment"], r["model_name"]): r["mae"] for r in wide.collect()}
    for r in long.collect():
        assert got[r["segment"], r["model_name"]] == pytest.approx(r["mae"])
    assert len(got) == 6 and (None, "a") in got


def test_comparison_skips_failed_models_and_breaks_ties_by_name(scored):
    df = scored.withColumns({"c": F.col("a"), "none": F.lit(None).cast("double")})
    stats = evaluate.model_metrics(df, {"c": "c", "a": "a", "none": "none"})
    table = evaluate.performance_table(evaluate.comparison_table(stats)).collect()
    assert [(r["rank"], r["model_name"]) for r in table] == [(1, "a"), (2, "c")]


def test_t_test_matches_the_formula(scored):
    y, a, b = arrays(scored, "y", "a", "b")
    d = np.abs(y - a) - np.abs(y - b)
    r = significance.paired_t_tests(scored, {"a": "a", "b": "b"}).first()
    assert r["statistic"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(len(d))))
    assert r["effect_size"] == pytest.approx(d.mean() / d.std())
    assert r["is_significant"] and r["p_value"] < 0.05


def test_equal_models_are_not_significant(scored):
    same = scored.withColumn("c", F.col("a"))
    tests = significance.paired_t_tests(same, {"a": "a", "c": "c"})
    r = significance.verdicts(tests.fillna({"p_value": 1.0})).first()
    assert r["statistic"] is None and r["effect_size"] == 0 and not r["is_significant"]
    assert "not statistically significant (p=1.0000 >= 0.05)" in r["interpretation"]


@pytest.mark.parametrize(
    "t, df, p",
    [(2.228139, 10, 0.05), (12.706205, 1, 0.05), (1.959988, 500_000, 0.05), (0.0, 7, 1.0),
     (2.0, 5, 0.101939), (1.0, 1, 0.5), (1.959964, 10**9, 0.05)],
)
def test_student_tail(t, df, p):
    assert student_two_sided(t, df) == pytest.approx(p, rel=2e-4)
    assert student_two_sided(-t, df) == student_two_sided(t, df)


def brute_wilcoxon(d):
    order = np.argsort(np.abs(d), kind="stable")
    size = np.abs(d)[order]
    ranks = np.empty(len(d))
    ties = 0.0
    i = 0
    while i < len(d):
        j = i
        while j < len(d) and size[j] == size[i]:
            j += 1
        ranks[order[i:j]] = (i + 1 + j) / 2
        ties += (j - i) ** 3 - (j - i)
        i = j
    half = ranks[d == 0].sum() / 2
    plus, minus = ranks[d > 0].sum() + half, ranks[d < 0].sum() + half
    n = len(d)
    z = (min(plus, minus) - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return plus, minus, z


def test_wilcoxon_with_ties_and_zeros(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 6, 400), rng.integers(0, 7, 400)
    df = spark.createDataFrame([(0.0, float(p), float(q)) for p, q in zip(a, b)], "y double, a double, b double")
    plus, minus, z = brute_wilcoxon((a - b).astype(float))
    r = significance.wilcoxon(df, "a", "b").first()
    assert (r["rank_plus"], r["rank_minus"]) == (plus, minus)
    assert r["z"] == pytest.approx(z) and r["p_value"] == pytest.approx(normal_two_sided(z))


def test_unknown_test_is_an_error(scored):
    with pytest.raises(ValueError, match="mcnemar"):
        significance.significance_test(scored, "a", "b", test_type="mcnemar")
    assert significance.significance_test(scored, "a", "b", test_type="wilcoxon").count() == 1


def test_weights_sum_to_one_and_average_lies_between(spark, scored):
    folds = evaluate.fold_mse(scored.withColumn("f", F.lit(0)), {"a": "a", "b": "b"}, "f")
    w = fusion.fusion_weights(folds, "a", "b").first()
    assert w["weight_a"] + w["weight_b"] == pytest.approx(1)
    assert w["weight_a"] == pytest.approx((1 / w["mse_a"]) / (1 / w["mse_a"] + 1 / w["mse_b"]))
    fused = scored.withColumn("f", fusion.weighted(F.col("a"), F.col("b"), w["weight_a"], w["weight_b"]))
    outside = (F.col("f") < F.least("a", "b") - 1e-9) | (F.col("f") > F.greatest("a", "b") + 1e-9)
    assert fused.filter(outside).count() == 0
    perfect = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "model_name string, mse double")
    assert fusion.fusion_weights(perfect, "a", "b").first()["weight_a"] == 0.5


def test_meta_learner_is_least_squares(scored):
    y, a, b = arrays(scored, "y", "a", "b")
    want = np.linalg.lstsq(np.column_stack([a, b, np.ones(len(y))]), y, rcond=None)[0]
    r = fusion.meta_coefficients(fusion.meta_moments(scored, "y", "a", "b")).first()
    assert list(r) == pytest.approx(list(want))


def test_meta_learner_on_one_line_takes_the_least_norm(scored):
    line = scored.withColumn("b", 2 * F.col("a") + 1)
    y, a, b = arrays(line, "y", "a", "b")
    x = np.column_stack([a - a.mean(), b - b.mean()])
    want = np.linalg.pinv(x) @ (y - y.mean())
    r = fusion.meta_coefficients(fusion.meta_moments(line, "y", "a", "b")).first()
    assert [r["weight_a"], r["weight_b"]] == pytest.approx(list(want))


def test_cv_summary_uses_negative_errors_and_population_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "model_name string, mse double")
    assert tuple(evaluate.cv_summary(df).first()) == ("a", -2.0, 1.0, -3.0, -1.0)


def table(spark, *rows):
    return spark.createDataFrame(
        [(n, t, r, 1.0, 2.0, m) for n, t, r, m in rows],
        "model_name string, model_type string, r2 double, mae double, rmse double, mape double",
    )


def test_tiers_and_sentences(spark):
    t = table(spark, ("a", "X", 0.81, 5.0), ("b", "Y", 0.61, 30.0), ("c", "Y", 0.6, 5.0), ("d", "Y", 0.4, 5.0))
    tiers = {r["model_name"]: r["tier"] for r in report.r2_tiers(t).collect()}
    assert tiers == {"a": "excellent", "b": "good", "c": "moderate", "d": "below"}
    tests = spark.createDataFrame([(True,), (False,)], "is_significant boolean")
    lines = [r["line"] for r in report.interpretations(t, tests).orderBy("position").collect()]
    assert lines[0].startswith("Excellent") and lines[2].endswith("X") and lines[3].startswith("1/2")
    advice = [r["line"] for r in report.recommendations(t).orderBy("position").collect()]
    assert advice[0] == "Recommended model: a (X)" and len(advice) == 3


def test_gain_keeps_its_sign_for_negative_scores(spark):
    t = table(spark, ("f", "X", -0.2, 1.0), ("m", "Y", -0.4, 1.0))
    r = report.vertical_vs_monolithic(t, ["f"], "m").first()
    assert r["winner"] == "vertical" and r["gain_percent"] == pytest.approx(50.0)
    zero = report.vertical_vs_monolithic(table(spark, ("f", "X", 0.5, 1.0), ("m", "Y", 0.0, 1.0)), ["f"], "m")
    assert zero.first()["gain_percent"] == 0.0


def test_bias_directions(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", -1.0), ("c", 2.0)], "model_name string, mean_residual double")
    assert [r["bias"] for r in report.bias_check(df).collect()] == ["unbiased", "over-prediction", "under-prediction"]
