"""Validation, profile, cleaning, partitioning and features on small tables."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.functions.joins import attach
from cellgauge.operators import clean, features, partition, profile, validate
from cellgauge.operators.quantiles import approximate_quantiles, quantiles
from cellgauge.operators.ranks import kth_smallest, rows_before
from cellgauge.sources import schema as S


def row(key="T", signal=-70.0, traffic=10.0, latency=20.0, users=30, device="Mobile", place="Urban"):
    return (key, signal, traffic, latency, users, device, place)


# --- validation ---


def test_rule_bounds(towers):
    df = towers(
        row("a", signal=0.0),
        row("b", signal=-150.0),
        row("c", signal=0.1),
        row("d", latency=0.0),
        row("e", traffic=0.0, users=0),
        row("f", traffic=-0.1, users=-1),
        row("g", signal=None, latency=None, place=None),
        row("h", device="Fax", place="Unknown"),
    )
    found = {r["rule"]: r["n_bad"] for r in validate.validation_report(df).collect()}
    assert found["signal_range"] == 1
    assert found["latency_range"] == 1
    assert found["traffic_range"] == found["users_range"] == 1
    assert found["device_domain"] == found["location_domain"] == 1
    assert found["latency_missing"] == 1 and found["duplicate_key"] == 0
    relaxed = validate.validation_report(df, allowed_locations=["Urban", "Rural", "Unknown"])
    assert {r["rule"]: r["n_bad"] for r in relaxed.collect()}["location_domain"] == 0
    names = {r[S.KEY]: r["violations"] for r in validate.violating_rows(df).collect()}
    assert names["f"] == ["traffic_range", "users_range"] and "g" not in names


def test_warnings_keep_a_table_valid(towers):
    df = towers(row("a", device="Fax"), row("b", signal=None))
    verdict = validate.validation_verdict(validate.validation_report(df)).first()
    assert verdict["is_valid"] and verdict["n_warnings"] == 2
    twice = towers(row("a"), row("a"), row(None), row(None))
    assert validate.duplicate_keys(twice).first()["n_duplicates"] == 2
    report = validate.validation_report(twice)
    assert not validate.validation_verdict(report).first()["is_valid"]
    text = report.filter("rule = 'duplicate_key'").first()["message"]
    assert text == "Found 2 duplicate Tower IDs"


def test_model_input_check(towers):
    with pytest.raises(ValueError, match="empty"):
        validate.check_model_input(towers(), [S.SIGNAL])
    with pytest.raises(ValueError, match="too few"):
        validate.check_model_input(towers(row()), [S.SIGNAL], min_rows=5)
    with pytest.raises(ValueError, match="signal"):
        validate.check_model_input(towers(row(signal=None)), [S.SIGNAL])
    assert validate.check_model_input(towers(row()), [S.SIGNAL], S.LATENCY) == 1


# --- quantiles and ranks ---


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, a third of the rows share one group."""
    rng = np.random.default_rng(5)
    values = np.where(rng.random(6000) < 1 / 3, 7.25, np.exp(rng.normal(2, 1, 6000)))
    groups = np.where(rng.random(6000) < 1 / 3, None, rng.choice(list("abc"), 6000))
    rows = [
        (g, float(v) if i % 50 else None, int(v)) for i, (g, v) in enumerate(zip(groups, values))
    ]
    return spark.createDataFrame(rows, "g string, x double, n int").cache()


PROBS = [0.0, 0.01, 0.25, 0.37, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_narrowing_is_exact(skewed, by):
    probs = {"x": PROBS, "n": [0.5]}
    narrow = quantiles(skewed, probs, by, group_limit=1500, bins=8).collect()
    pandas = skewed.toPandas()
    assert len(narrow) == (4 if by else 1)
    for r in narrow:
        part = pandas if not by else pandas[pandas.g.isna() if r["g"] is None else pandas.g == r["g"]]
        np.testing.assert_allclose(r["q_x"], np.nanquantile(part.x, PROBS), rtol=1e-12)
        assert r["q_n"][0] == np.quantile(part.n, 0.5)


def test_passes_do_not_follow_the_number_of_large_groups(spark, monkeypatch):
    """Groups beyond the broadcast bound, and values that no rule of scale fits."""
    from cellgauge.operators import quantiles as module

    groups = 300
    x = F.when(F.col("id") % 7 == 0, F.lit(2.0)).otherwise(F.exp((F.col("id") * 7919 % 601) / 20.0 - 15))
    g = F.when(F.col("id") % groups > 0, F.col("id") % groups)
    df = spark.range(groups * 40).select(g.alias("g"), x.alias("x")).cache()
    jobs = []
    monkeypatch.setattr(module, "checkpointed", lambda t: jobs.append(1) or t.cache())
    monkeypatch.setattr(module, "attach", lambda *a: attach(*a, bound=20))
    found = {r["g"]: r["q_x"] for r in quantiles(df, {"x": PROBS}, ["g"], group_limit=0).collect()}
    few = len(jobs)
    own = df.toPandas()
    assert len(found) == groups
    for key, part in own.groupby("g", dropna=False):
        np.testing.assert_allclose(found[None if np.isnan(key) else key], np.quantile(part.x, PROBS), rtol=1e-12)
    quantiles(df.filter("g < 3"), {"x": PROBS}, ["g"], group_limit=0).collect()
    assert len(jobs) == 2 * few


def test_a_row_is_held_once_a_column_however_many_targets(spark, monkeypatch):
    """No list with an entry per target is built for a row; rows beyond all bounds leave first."""
    from cellgauge.operators import quantiles as module

    plans = []

    def recorded(table):
        plans.append(table._jdf.queryExecution().optimizedPlan().toString())
        return table.cache()

    monkeypatch.setattr(module, "checkpointed", recorded)
    df = spark.range(5000).select((F.col("id") % 1009).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    row = quantiles(df, {"x": PROBS, "y": PROBS}, group_limit=0).first()
    np.testing.assert_allclose(row["q_x"], np.quantile(np.arange(5000) % 1009, PROBS), rtol=1e-12)
    np.testing.assert_allclose(row["q_y"], np.quantile(np.arange(5000), PROBS), rtol=1e-12)
    # Below the first aggregate: what happens to every row.
    per_row = next(p for p in plans if "explode(" in p).rsplit("Aggregate", 1)[1]
    generate = next(line for line in per_row.splitlines() if "Generate" in line)
    assert "Filter" in per_row[per_row.index("Generate") :] and generate.count("named_struct(") + per_row.count("CASE WHEN") <= 4


def test_empty_column_has_no_quantile(spark):
    df = spark.createDataFrame([(None, 1.0)] * 30, "x double, y double")
    r = quantiles(df, {"x": [0.5], "y": [0.5]}, group_limit=5).first()
    assert r["q_x"] is None and r["q_y"] == [1.0]
    assert quantiles(df, {"x": [0.5]}).first()["q_x"] is None


def test_approximate_quantiles(skewed):
    r = approximate_quantiles(skewed, {"x": [0.5]}).first()
    exact = quantiles(skewed, {"x": [0.5]}).first()
    assert r["q_x"][0] == pytest.approx(exact["q_x"][0], rel=0.01)


def test_rows_before_matches_sorting(spark):
    rng = np.random.default_rng(1)
    values = np.unique(
        np.concatenate([rng.integers(0, 50, 40), rng.integers(0, 2**45, 200), [2**62]])
    )
    rows = [(int(v), int(rng.integers(1, 9))) for v in values]
    counts = spark.createDataFrame(rows, "v bigint, w bigint")
    got = {r["v"]: r["before"] for r in rows_before(counts, "v", "w").collect()}
    total = 0
    for v, w in sorted(rows):
        assert got[v] == total
        total += w


def test_kth_smallest(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else None, int(h)) for i, h in enumerate(rng.integers(0, 2**32, 900))]
    df = spark.createDataFrame(rows, "g string, h bigint")
    for r in kth_smallest(df, "h", 0.2, "g").collect():
        mine = sorted(h for g, h in rows if g == r["g"])
        assert r["cut"] == mine[-(-len(mine) // 5) - 1]


def test_attach_without_broadcast(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    table = df.groupBy("k").agg(F.sum("v").alias("s")).filter("k IS NULL OR k = 'a'")
    for bound in (0, 100):
        got = {r["v"]: r["s"] for r in attach(df, table, ["k"], bound=bound).collect()}
        assert got == {1: 1, 2: 2, 3: None}


# --- profile ---


def test_histogram_keeps_empty_bins_and_closes_the_last(towers):
    df = towers(*[row(str(i), latency=v) for i, v in enumerate([0.0, 1.0, 1.0, 10.0, None])])
    counts = [r["n"] for r in profile.histogram(df, bins=5).orderBy("bin").collect()]
    assert counts == [3, 0, 0, 0, 1]
    same = towers(row("a", latency=3.0), row("b", latency=3.0))
    assert sum(r["n"] for r in profile.histogram(same, bins=4).collect()) == 2


def test_point_cells_refine_where_points_are_dense(towers):
    crowd = [row(f"c{i}", signal=-100.0 + i / 1000, latency=1.0 + i / 1000) for i in range(60)]
    far = [row("f", signal=-50.0, latency=65.0), row("g", signal=-50.0, latency=None)]
    df = towers(*crowd, *far)
    got = profile.point_cells(df, S.SIGNAL, S.LATENCY, depth=4, parts=4).collect()
    assert {(r["level"], r["x_cell"], r["y_cell"]): r["n"] for r in got} == {(4, 0, 0): 60, (1, 1, 1): 1}
    assert (got[0]["x_low"], got[0]["y_low"]) in {(-100.0, 1.0), (-75.0, 33.0)}
    whole = profile.point_cells(df, S.SIGNAL, S.LATENCY, depth=4, parts=1).collect()
    assert [(r["level"], r["n"], r["x_high"], r["y_high"]) for r in whole] == [(0, 61, -50.0, 65.0)]
    same = towers(row("a", latency=3.0), row("b", latency=3.0))
    assert sum(r["n"] for r in profile.point_cells(same, S.SIGNAL, S.LATENCY, S.LOCATION).collect()) == 2
    assert profile.point_cells(df.limit(0), S.SIGNAL, S.LATENCY).count() == 0


def test_box_stats_find_outliers(towers):
    df = towers(*[row(str(i), latency=float(v)) for i, v in enumerate([1, 2, 3, 4, 100])])
    r = profile.box_stats(df, S.LOCATION).first()
    assert (r["q1"], r["median"], r["q3"]) == (2.0, 3.0, 4.0)
    assert (r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (1.0, 4.0, 1)


def test_correlation_needs_two_rows(towers):
    df = towers(row("a", place="Rural"), row("b"), row("c", signal=-60.0, latency=9.0))
    got = profile.correlation_by_group(df, ["Urban", "Rural"], features=[S.SIGNAL]).first()
    assert got["Rural"] is None and got["Urban"] == pytest.approx(-1.0)


def test_distribution_percentages(towers):
    df = towers(row("a"), row("b"), row("c", place="Rural"))
    got = {r[S.LOCATION]: r["percentage"] for r in profile.distribution(df, [S.LOCATION]).collect()}
    assert got == {"Urban": 66.67, "Rural": 33.33}


# --- cleaning ---


def test_fences_come_from_the_imputed_table(towers):
    traffic = [10.0, 20.0, None, None, None, None, 30.0]
    df = towers(*[row(str(i), traffic=t) for i, t in enumerate(traffic)])
    stats = clean.fit_cleaning(df)
    assert stats.medians[S.TRAFFIC] == 20.0
    assert stats.fences[S.TRAFFIC].q1 == stats.fences[S.TRAFFIC].q3 == 20.0
    assert {r[S.TRAFFIC] for r in clean.apply_cleaning(df, stats).collect()} == {20.0}


@pytest.mark.parametrize("limit", [None, 0])
def test_fences_of_one_narrowing_are_those_of_the_imputed_rows(spark, monkeypatch, limit):
    rng = np.random.default_rng(5)
    calls = []

    def counted(df, probs, **more):
        calls.append(1)
        return quantiles(df, probs, **(more if limit is None else {"group_limit": limit}))

    monkeypatch.setattr(clean, "quantiles", counted)
    for share in (0.0, 0.1, 0.4, 0.6, 0.9):
        rows = [
            (None if rng.random() < share else float(rng.integers(0, 9)) / 7, int(x), float(y))
            for x, y in zip(rng.integers(-9, 9, 57), rng.normal(size=57))
        ]
        data = [row(str(i), signal=a, users=b, latency=y) for i, (a, b, y) in enumerate(rows)]
        df = spark.createDataFrame(data, S.CONTRACT)
        stats = clean.fit_cleaning(df)
        raw = np.array([r[0] for r in rows], dtype=float)
        median = np.nanmedian(raw)
        filled = np.where(np.isnan(raw), median, raw)
        assert stats.medians[S.SIGNAL] == pytest.approx(median, abs=1e-12)
        fence = stats.fences[S.SIGNAL]
        assert [fence.q1, fence.q3] == pytest.approx(list(np.quantile(filled, [0.25, 0.75])), abs=1e-12)
    assert len(calls) == 5


def test_target_is_never_filled_and_its_rows_leave_last(towers):
    df = towers(row("a", signal=-90.0, latency=None), row("b"), row("c", place=None))
    out = {r[S.KEY]: r for r in clean.preprocess(df).collect()}
    assert set(out) == {"b", "c"} and out["c"][S.LOCATION] == "Unknown"
    assert clean.row_loss(df).first()["rows_removed"] == 1


def test_mode_ties_and_all_null(towers):
    assert clean.fit_mode(towers(row(device="Tablet"), row(device="Laptop"), row(device=None))) == "Laptop"
    assert clean.fit_mode(towers(row(device=None))) == "Unknown"


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "user_count double")
    assert [r[0] for r in clean.convert_types(df).collect()] == [0, 2, 2, 0]


def test_capping_is_idempotent_and_keeps_nulls(towers):
    df = towers(*[row(str(i), latency=v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 99.0, None])])
    fences = {S.LATENCY: clean.fit_fences(df)[S.LATENCY]}
    once = clean.cap_outliers(df, fences)
    assert clean.outlier_counts(df, fences).first()["n_outliers"] == 1
    assert clean.outlier_counts(once, fences).first()["n_outliers"] == 0
    assert sorted(once.collect()) == sorted(clean.cap_outliers(once, fences).collect())
    assert once.filter(F.col(S.LATENCY).isNull()).count() == 1


def test_all_null_column_stays(towers):
    df = towers(row("a", signal=None), row("b", signal=None))
    assert clean.preprocess(df).filter(F.col(S.SIGNAL).isNull()).count() == 2


# --- partitioning ---


def test_vertical_check_finds_lost_keys(towers):
    infra, user = partition.vertical_split(towers(row("a"), row("b"), row("b")))
    assert partition.vertical_check(infra, user).first()["is_valid"]
    bad = partition.vertical_check(infra, user.dropDuplicates([S.KEY])).first()
    assert not bad["is_valid"] and bad["keys_differing"] == 1
    shared = partition.vertical_check(infra, user.withColumn(S.SIGNAL, F.lit(1.0))).first()
    assert not shared["is_valid"] and shared["shared_features"] == 1


def test_range_fingerprints_find_what_keys_find(spark, towers, monkeypatch):
    rng = np.random.default_rng(3)
    keys = [None, *[f"k{i}" for i in range(60)]]
    for ranges in (1, 7, 4096):
        a = rng.choice(keys, 80).tolist()
        b = [k for k in a if rng.random() < 0.9] + rng.choice(keys, 5).tolist()
        infra, user = (partition.vertical_split(towers(*map(row, side)))[i] for i, side in enumerate((a, b)))
        got = partition.vertical_check(infra, user, ranges=ranges).first()
        assert (got["rows_infra"], got["rows_user"]) == (len(a), len(b))
        assert got["keys_differing"] == sum(a.count(k) != b.count(k) for k in keys)
        same = partition.vertical_split(towers(*map(row, rng.permutation(np.array(a, dtype=object)).tolist())))[1]
        equal = partition.vertical_check(infra, same, ranges=ranges)
        assert equal.first()["is_valid"]
        assert S.KEY not in equal._jdf.queryExecution().executedPlan().toString()
    none = partition.vertical_check(*partition.vertical_split(towers())).first()
    assert none["is_valid"] and none["rows_infra"] == 0


def test_both_location_rules(towers):
    df = towers(
        row("and", place=None, users=51, signal=-84.0),
        row("edge", place=None, users=50, signal=-84.0),
        row("null", place="Suburban", users=None, signal=None, traffic=None),
        row("score", place="Unknown", users=26, signal=-79.0),
        row("kept", place="Rural", users=99, signal=-1.0),
    )
    segment = {r[S.KEY]: r["segment"] for r in partition.horizontal_split(df).collect()}
    assert segment == {
        "and": "Urban", "edge": "Rural", "null": "Rural", "score": "Rural", "kept": "Rural",
    }
    place = {r[S.KEY]: r[S.LOCATION] for r in partition.location_heuristic(df).collect()}
    assert place == {
        "and": "Urban", "edge": "Urban", "null": "Rural", "score": "Urban", "kept": "Rural",
    }


def test_horizontal_check_reports_keys_in_both(towers):
    df = towers(row("a"), row("a", place="Rural"), row("b"))
    split = partition.horizontal_split(df)
    bad = partition.horizontal_check(split, df).first()
    assert not bad["is_valid"] and bad["keys_in_both"] == 1 and bad["small_segment"]
    lost = partition.horizontal_check(split.filter(F.col(S.KEY) != "b"), df).first()
    assert lost["keys_lost"] == 1


def test_splits_partition_the_rows_and_survive_repartitioning(towers):
    df = towers(*[row(f"T{i}", place="Urban" if i % 3 else None) for i in range(400)])
    for split in (partition.train_test_split, partition.stratified_split):
        first = split(df).select(S.KEY, "split").collect()
        assert len(first) == 400 and {r["split"] for r in first} == {"train", "test"}
        assert sorted(first) == sorted(split(df.repartition(7)).select(S.KEY, "split").collect())
    sizes = partition.stratified_split(df).filter("split = 'test'").groupBy(S.LOCATION).count()
    assert {r[S.LOCATION]: r["count"] for r in sizes.collect()} == {None: 27, "Urban": 54}
    assert partition.exact_split(df, 0.33).filter("split = 'test'").count() == 132


# --- features ---


def test_scaling_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "x double, c double")
    out = features.standard_scale(df, features.fit_scaler(df, ["x", "c"])).collect()
    want = [(v - 3) / statistics.pstdev([1, 2, 6]) for v in (1, 2, 6)]
    assert [r["x_scaled"] for r in out] == pytest.approx(want)
    assert [r["c_scaled"] for r in out] == [0.0, 0.0, 0.0]


def test_unseen_category_is_the_baseline(towers):
    train = towers(row(device="Laptop"), row(device="Mobile"), row(device="Tablet"))
    categories = features.fit_categories(train)
    out = features.one_hot(towers(row(device="Fax"), row(device="Laptop")), S.DEVICE, categories)
    assert out.select("device_type_Mobile", "device_type_Tablet").distinct().collect() == [(0.0, 0.0)]
    with pytest.raises(ValueError):
        features.prepare_features(train.drop(S.LATENCY))


def test_feature_names_skip_the_first_category(towers):
    train = towers(row(device="Laptop"), row(device=None))
    fitted = features.fit_features(train, features.USER_BEHAVIOR)
    assert fitted.names == ["user_count", "device_type_Unknown"]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_buckets_narrow_without_a_sketch(spark, monkeypatch, by):
    """Values of all sizes and signs, infinite ones, missing ones and NaN, in two passes over the rows."""
    from cellgauge.operators import quantiles as module

    rng = np.random.default_rng(3)
    inf, nan = float("inf"), float("nan")
    x = [*(rng.choice([-1.0, 1.0], 600) * 10.0 ** rng.uniform(-300, 300, 600)), *[0.0] * 30, *[inf, -inf, 5e-324, -5e-324] * 5]
    y = [*rng.uniform(50, 60, 300), *[nan] * 150, *[None] * 200]
    rows = [("ab"[i % 2], float(v), None if w is None else float(w)) for i, (v, w) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "g string, x double, y double").cache()
    probs = {"x": PROBS, "y": [0.1, 0.9]}
    want = {str(r) for r in module._builtin(df, probs, by).collect()}
    assert {str(r) for r in module._narrowed(df, probs, by, 8).collect()} == want
    monkeypatch.setattr(module, "_bounds", None)
    monkeypatch.setattr(module, "HELD_SHARE", 1.0)
    assert {str(r) for r in module._narrowed(df, probs, by, 8).collect()} == want


def test_values_that_lie_close_together_are_narrowed_by_a_sketch(spark, monkeypatch):
    from cellgauge.operators import quantiles as module

    used, sketch = [], module._bounds
    monkeypatch.setattr(module, "_bounds", lambda *a: used.append(1) or sketch(*a))
    df = spark.range(5000).select((F.col("id") + 1.7e9).alias("x"), (F.col("id") + 1.0).alias("y"))
    assert quantiles(df, {"x": [0.25, 0.5]}, group_limit=0).first()["q_x"] == [1.7e9 + 1249.75, 1.7e9 + 2499.5]
    assert len(used) == 1
    assert quantiles(df, {"y": [0.25, 0.5]}, group_limit=0).first()["q_y"] == [1250.75, 2500.5]
    assert len(used) == 1
