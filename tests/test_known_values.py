"""Values measured once on sf0.01, independent of the SQL twins."""

from pathlib import Path

import pytest

from cellgauge.catalog import QUERIES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def rows(spark, name, key):
    return {r[key]: r for r in QUERIES[name](spark, SF).collect()}


def test_rule_violations(spark):
    found = {n: r["n_bad"] for n, r in rows(spark, "validation_report", "rule").items()}
    assert found["signal_range"] == 301 and found["traffic_range"] == 273
    assert found["latency_range"] == 0 and found["users_range"] == 116
    assert found["location_domain"] == 10_002 and found["duplicate_key"] == 14_168


def test_latency_summary(spark):
    r = rows(spark, "describe_numeric", "column_name")["latency"]
    assert (r["q25"], r["q50"], r["q75"]) == (47.51825, 61.226405, 75.079895)
    assert (r["min"], r["max"]) == (8.87377, 297.530985)
    assert rows(spark, "outlier_counts", "column_name")["latency"]["n_outliers"] == 527


def test_location_scores(spark):
    found = {s: r["n"] for s, r in rows(spark, "location_scores", "score").items()}
    assert found == {0: 705, 1: 2063, 2: 4477, 3: 5685, 4: 4734, 5: 2262}


def test_minimum_slice(spark):
    found = rows(spark, "latency_by_location", "location_type")
    assert tuple(found["Rural"])[1:] == (26471, 60.306, 19.298, 8.874, 116.422, 59.879)
    assert tuple(found["Urban"])[1:] == (32922, 62.487, 18.783, 9.770, 116.422, 62.182)


def test_split_size(spark):
    split = QUERIES["train_test_split"](spark, SF)
    assert split.filter("split = 'test'").count() == 11_732


def test_metrics(spark):
    found = rows(spark, "extended_metrics", "model_name")
    a, b, m = (
        found[n] for n in ("infrastructure_model", "user_behavior_model", "monolithic_model")
    )
    assert (a["mae"], b["mae"], m["mae"]) == (9.338070, 14.554369, 15.536396)
    assert (a["rmse"], b["rmse"], m["rmse"]) == (12.216262, 17.677183, 19.085982)
    assert (a["r2"], b["r2"], m["r2"]) == (0.590359, 0.142266, 0.000102)
    assert (a["mape"], a["mean_residual"], a["std_residual"]) == (17.390290, 0.179826, 12.214938)
    assert a["sample_size"] == 11_595


def test_paired_tests(spark):
    r = QUERIES["paired_t_test"](spark, SF).first()
    assert (r["statistic"], r["effect_size"]) == (-51.947321, -0.482444)
    r = QUERIES["wilcoxon"](spark, SF).first()
    assert (r["rank_plus"], r["rank_minus"]) == (16_878_925.0, 50_348_885.0)


def test_meta_learner(spark):
    r = QUERIES["fusion_meta"](spark, SF).first()
    assert (r["weight_a"], r["weight_b"]) == (0.998855, 0.995090)
