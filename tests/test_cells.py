"""Forests from one aggregate: trees, folds and errors against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.functions.pvalues import signed_rank_two_sided
from cellgauge.operators import cells as C
from cellgauge.operators import features as X
from cellgauge.operators import models as M
from cellgauge.operators import partition, significance
from cellgauge.operators.clean import preprocess
from cellgauge.sources import schema as S
from cellgauge.sources.network import network


def brute_tree(points, kinds, n, s, depth):
    """Best split of every node by trying all; a prediction function of a point."""
    rows, total = n.sum(), s.sum()
    leaf = total / rows

    def error(mask):
        return s[mask].sum() ** 2 / n[mask].sum()

    best = (0, None)
    if depth:
        for f, (size, number) in enumerate(kinds):
            own = (0, None)
            for v in range(size - 1) if number else range(1, size):
                left = points[f] <= v if number else points[f] == v
                if left.any() and not left.all():
                    gain = error(left) + error(~left) - total**2 / rows
                    own = max(own, (gain, (f, v, number, left)), key=lambda x: x[0])
            if own[0] > best[0] + 1e-9 * abs(total * leaf):
                best = own
    if best[1] is None:
        return lambda p: leaf
    f, v, number, left = best[1]
    a = brute_tree(points[:, left], kinds, n[left], s[left], depth - 1)
    b = brute_tree(points[:, ~left], kinds, n[~left], s[~left], depth - 1)
    return lambda p: (a if (p[f] <= v if number else p[f] == v) else b)(p)


@pytest.mark.parametrize("depth", [0, 1, 3, 7])
def test_tree_is_the_greedy_one(depth):
    draw = np.random.default_rng(depth)
    kinds = [(6, True), (4, False), (5, True), (1, False)]
    grid = np.array(list(itertools.product(*(range(k) for k, _ in kinds)))).T
    used = grid[:, draw.random(grid.shape[1]) < 0.6]
    n = draw.integers(1, 9, used.shape[1]).astype(float)
    s = n * draw.normal(50, 20, used.shape[1])
    got, gains = C.grow_tree(used, kinds, n, s, grid, depth)
    tree = brute_tree(used, kinds, n, s, depth)
    # Splits of equal gain may part cells that no row lies in differently.
    seen = (grid[:, :, None] == used[:, None, :]).all(axis=0).any(axis=1)
    want = np.array([tree(p) for p in grid.T])
    assert np.allclose(got[seen], want[seen]) and (depth > 3 or np.allclose(got, want))
    assert len(gains) == 5 + 3 + 0 - 3 and (gains >= 0).all() and (gains.sum() > 0) == (depth > 0)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return preprocess(network(spark, sf_dir)).cache()


SETTINGS = M.ForestSettings(trees=6, depth=5)


def test_cells_hold_every_row_once(rows):
    grid = C.fit_grid(rows, X.fit_features(rows, X.MONOLITHIC))
    blocks = C.fit_blocks(M.with_folds(rows, 3), grid, fold=F.col("fold"), folds=3)
    want = {r["fold"]: (r["n"], r["s"]) for r in M.with_folds(rows, 3).groupBy("fold").agg(F.count("*").alias("n"), F.sum(S.LATENCY).alias("s")).collect()}
    for fold, (n, s) in want.items():
        mine = blocks.fold == fold
        assert blocks.n[mine].sum() == n and abs(blocks.total[mine].sum() - s) < 1e-3
    part = grid.part(X.USER_BEHAVIOR)
    assert list(part.sizes) == [S.USERS, S.DEVICE]
    codes = dict(zip(grid.sizes, grid.codes(blocks.cell), strict=True))
    assert (part.codes(grid.project(blocks.cell, part)) == np.array([codes[c] for c in part.sizes])).all()


def test_same_forest_whatever_the_partitions(rows):
    a = M.monolithic_model(SETTINGS).train(rows)
    b = M.monolithic_model(SETTINGS).train(rows.repartition(5, S.LATENCY))
    assert (a.forest.table == b.forest.table).all() and a.forest.grid == b.forest.grid
    other = M.monolithic_model(M.ForestSettings(trees=6, depth=5, seed=1)).train(rows)
    assert (a.forest.table != other.forest.table).any()


def test_errors_of_folds_are_those_of_scored_rows(rows):
    made = {"a": M.infrastructure_model(SETTINGS), "b": M.user_behavior_model(SETTINGS)}
    fits = M.cross_fit(rows, made, 3, pairs=("a", "b"))
    assert len(fits.forests) == 2 * (3 + 3)
    folded = M.with_folds(rows, 3)
    for (name, without), forest in fits.forests.items():
        for fold in range(3):
            scored = forest.predict(folded.filter(F.col("fold") == fold), "p")
            want = scored.agg(F.avg(F.pow(F.col(S.LATENCY) - F.col("p"), 2))).first()[0]
            assert abs(fits.errors(name, without, [fold])[0] - want) < 1e-6 * want
    # A forest without a fold is the one that never saw its rows.
    grid, blocks = fits.blocks.grid, C.fit_blocks(folded.filter("fold <> 1"), fits.blocks.grid)
    alone = C.fit_forests(rows, blocks, [C.Fit("a", X.INFRASTRUCTURE)], 40, 5, 42)[0]
    held = C.fit_forests(rows, fits.blocks, [C.Fit("a", X.INFRASTRUCTURE, frozenset({1}))], 40, 5, 42)[0]
    used = np.unique(grid.project(blocks.cell, grid.part(X.INFRASTRUCTURE)))
    assert np.corrcoef(alone.table[used], held.table[used])[0, 1] > 0.99


def test_fusion_scores_use_weights_of_the_other_folds(rows):
    made = {"a": M.infrastructure_model(SETTINGS), "b": M.user_behavior_model(SETTINGS)}
    k = 4
    fits = M.cross_fit(rows, made, k, pairs=("a", "b"))
    folded = M.with_folds(rows, k)
    for i, got in enumerate(M.fused_errors(fits, "a", "b", k)):
        inner = {n: np.mean([fits.errors(n, {i, j}, [j])[0] for j in range(k) if j != i]) for n in made}
        w = inner["b"] / (inner["a"] + inner["b"])
        scored = folded.filter(F.col("fold") == i)
        for n in made:
            scored = fits.forests[n, frozenset({i})].predict(scored, n)
        fused = w * F.col("a") + (1 - w) * F.col("b")
        want = scored.agg(F.avg(F.pow(F.col(S.LATENCY) - fused, 2))).first()[0]
        assert abs(got - want) < 1e-6 * want
    scores = M.cross_validate(rows, {n: (lambda m=m: m) for n, m in made.items()}, k, fused=("f", "a", "b"))
    assert {(r["fold"], r["model_name"]) for r in scores.collect()} == {(i, n) for i in range(k) for n in ("a", "b", "f")}


def test_segment_of_a_grid_is_a_model_of_its_rows(rows):
    grid = C.fit_grid(rows, X.fit_features(rows, X.MONOLITHIC))
    blocks = C.fit_blocks(rows, grid)
    city = C.Fit("urban", X.SEGMENT_MODEL, only=(S.LOCATION, "Urban"))
    got = C.fit_forests(rows, blocks, [city], 1, 0, 1, bootstrap=False)[0]
    mean = rows.filter(F.col(S.LOCATION) == "Urban").agg(F.avg(S.LATENCY)).first()[0]
    assert np.allclose(got.table, mean)
    nowhere = C.fit_forests(rows, blocks, [C.Fit("x", X.SEGMENT_MODEL, only=(S.LOCATION, "Mars"))], 2, 3, 1)[0]
    assert not nowhere.table.any() and not nowhere.importances.any()


def test_mllib_takes_what_has_no_narrow_grid(rows, monkeypatch):
    model = M.infrastructure_model(M.ForestSettings(trees=3, depth=3, engine=M.MLLIB)).train(rows)
    assert not isinstance(model.forest, C.CellForest) and model.predict(rows).filter("prediction IS NULL").count() == 0
    monkeypatch.setattr(C, "MAX_CELLS", 10)
    wide = M.infrastructure_model(M.ForestSettings(trees=3, depth=3)).train(rows)
    assert not isinstance(wide.forest, C.CellForest)
    makers = {"a": lambda: M.infrastructure_model(M.ForestSettings(trees=2, depth=2))}
    assert M.cross_validate(rows, makers, 2).count() == 2
    with pytest.raises(ValueError, match="narrow grid"):
        M.cross_validate(rows, makers, 2, fused=("f", "a", "a"))


def test_missing_and_unseen_values_fall_into_cells(towers):
    nan = float("nan")
    df = towers(
        *[(f"t{i}", -50.0 - i, 10.0 * i, 20.0 + i, i, "Mobile" if i % 2 else "Laptop", "Urban") for i in range(40)],
        ("n1", nan, None, 30.0, None, None, "Rural"),
    )
    model = M.monolithic_model(SETTINGS).train(df)
    new = towers(("u", nan, None, None, None, "Satellite", "Moon"), ("v", -51.0, 5.0, nan, 3, "Mobile", "Urban"))
    got = [r["prediction"] for r in model.predict(new).collect()]
    assert all(20 <= p <= 60 for p in got)
    with pytest.raises(ValueError, match="10 categories|more than 1"):
        X.fit_categories(df, S.DEVICE, most=1)


def test_signed_rank_p_counts_all_signs(towers):
    for n in (1, 4, 9, 12):
        sums = [sum(r for r, up in zip(range(1, n + 1), signs, strict=True) if up) for signs in itertools.product((0, 1), repeat=n)]
        for w in {0, 1, n, n * (n + 1) // 4}:
            want = min(1.0, 2 * sum(x <= w for x in sums) / 2**n)
            assert abs(signed_rank_two_sided(w, n) - want) < 1e-12
    assert 0 < signed_rank_two_sided(0, 50) < 1e-14


def test_small_samples_are_tested_exactly(spark):
    rows = [(float(10 + i), float(10 + i) - 0.1 * (i + 1), float(10 + i) + (0.05 if i % 3 else 0.7313) * (i + 1)) for i in range(12)]
    df = spark.createDataFrame(rows, "y double, p1 double, p2 double")
    exact = significance.wilcoxon(df, "p1", "p2").first()
    normal = significance.wilcoxon(df, "p1", "p2", exact_rows=0).first()
    assert exact["p_value"] == signed_rank_two_sided(exact["statistic"], 12) != normal["p_value"]
    assert exact.asDict().keys() == normal.asDict().keys()
    # A tie, or a difference of zero, goes back to the approximation.
    tied = df.union(df.limit(1))
    assert significance.wilcoxon(tied, "p1", "p2").first() == significance.wilcoxon(tied, "p1", "p2", exact_rows=0).first()


def test_each_side_of_the_split_is_checked(towers):
    df = towers(*[(f"t{i}", -60.0, 1.0, 9.0, 1, "Mobile", "Urban" if i % 2 else "Rural") for i in range(40)])
    sided = df.withColumn("split", F.when(F.col(S.KEY) < "t2", "test").otherwise("train"))
    whole = partition.horizontal_split(sided)
    good = partition.horizontal_check(whole, sided, by=["split"]).collect()
    assert len(good) == 2 and all(r["is_valid"] for r in good)
    # A row that changes sides adds up over the table, but not on either side.
    moved = whole.withColumn("split", F.when(F.col(S.KEY) == "t5", "test").otherwise(F.col("split")))
    assert partition.horizontal_check(moved, sided).first()["is_valid"]
    assert not any(r["is_valid"] for r in partition.horizontal_check(moved, sided, by=["split"]).collect())


def test_cells_are_found_without_a_condition_per_cut(spark):
    """Bins count the cuts below a number; the plan stays short, so that the JVM compiles it."""
    cuts = {"a": [-1.0, 0.0, 2.5, float("inf")], "b": [float(i) for i in range(31)], "c": []}
    grid = C.Grid(cuts, {"d": ["p", "q", "Unknown"]}, {"a": 2.5, "b": 3.0, "c": 0.0})
    a = [None, float("nan"), -1.0, -0.0, 0.0, 5e-324, 2.5, 2.6, float("inf"), float("-inf")]
    rows = [(x, float(i * 4 - 5), 1.0, "pqz"[i % 3] if i else None) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d string")

    def want(x, y, d):
        x = 2.5 if x is None or x != x else x
        code = sum(x > cut for cut in cuts["a"]) * 32 + sum(y > cut for cut in cuts["b"])
        return code * 3 + {"p": 0, "q": 1, None: 2}.get(d, 0)

    forest = C.CellForest(grid, np.arange(grid.cells, dtype=float), np.array([1.0]))
    scored = forest.predict(df, "cell")
    assert scored.columns == ["a", "b", "c", "d", "cell"]
    got = sorted((r["b"], r["cell"]) for r in scored.collect())
    assert got == sorted((y, want(x, y, d)) for x, y, _, d in rows)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < 20


def test_rows_read_in_many_passes_are_cached(spark, sf_dir):
    """Cleaning and the hashes of split and fold are worked out once, not in every pass of every model."""
    from cellgauge.catalog import model_queries

    rows, train, _ = model_queries.prepared(spark, sf_dir)
    assert rows.storageLevel.useMemory and rows.storageLevel.useDisk
    makers = {"m": lambda: M.user_behavior_model(M.ForestSettings(trees=2, depth=2))}
    scored = M.cross_predict(train, makers, 2)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan and "md5" not in plan.split("InMemoryRelation")[0]


def test_models_trained_together_are_those_trained_alone(spark, sf_dir, monkeypatch):
    """The rows are counted once for all models and crosses, and every forest is the same."""
    rows = partition.location_heuristic(preprocess(network(spark, sf_dir))).cache()
    settings = M.ForestSettings(trees=3, depth=3)

    def made():
        return [M.infrastructure_model(settings), M.monolithic_model(settings), M.urban_model(settings), M.rural_model(settings)]

    alone = [m.train(rows) for m in made()]
    pair = {"a": M.infrastructure_model(settings), "b": M.user_behavior_model(settings)}
    fits = M.cross_fit(rows, pair, 3)
    passes, count = [], C.fit_all_blocks
    monkeypatch.setattr(C, "fit_all_blocks", lambda *a: passes.append(1) or count(*a))
    monkeypatch.setattr(M, "check_model_input", None)
    together = made()
    found = M.train_all(rows, together, [M.Cross(pair, 3)])[0]
    assert len(passes) == 1
    for a, b in zip(alone, together, strict=True):
        assert a.features == b.features and a.forest.grid == b.forest.grid
        assert (a.forest.table == b.forest.table).all() and (a.forest.importances == b.forest.importances).all()
    assert all((found.forests[k].table == fits.forests[k].table).all() for k in fits.forests)
    # What was learned serves another cross; cuts of segments stay their own.
    again = M.train_all(rows, [], [M.Cross(pair, 3)], together[1].learned)[0]
    assert all((again.forests[k].table == fits.forests[k].table).all() for k in fits.forests)
    assert together[2].forest.grid.cuts != together[3].forest.grid.cuts


@pytest.mark.parametrize("change", ["few", "missing", "empty"])
def test_rows_that_no_model_can_use_are_an_error_for_all(spark, sf_dir, change):
    rows = preprocess(network(spark, sf_dir))
    models = [M.monolithic_model(), M.geographic_model("Urban", min_rows=10**6 if change == "few" else 1)]
    if change == "missing":
        rows = rows.withColumn(S.LATENCY, F.when(F.col(S.USERS) > 0, F.col(S.LATENCY)).cast("double") * F.lit(None))
    with pytest.raises(ValueError, match={"few": "too few rows", "missing": "Missing values", "empty": "empty"}[change]):
        M.train_all(rows if change != "empty" else rows.limit(0), models)


@pytest.mark.parametrize("limit", [500_000, 1_000])
def test_cuts_are_the_equal_shares_of_all_rows(spark, monkeypatch, limit):
    """Every row counts for the cuts, of each set, whether one pass gives them or they are narrowed."""
    monkeypatch.setattr(C, "GROUP_LIMIT", limit, raising=False)
    n = 60_000
    draw = np.random.default_rng(3)
    values = {"a": draw.normal(size=n), "b": draw.lognormal(0, 3, n), "c": np.floor(draw.random(n) * 9), "d": 5 + draw.random(n) / 1e6}
    values["a"][::7], values["b"][::5] = float("nan"), float("inf")
    values["c"][::2] = -4.0
    lines = [(f"t{i}", i % 3, *map(float, row)) for i, row in enumerate(zip(*values.values(), strict=True))]
    df = spark.createDataFrame(lines, f"{S.KEY} string, side int, a double, b double, c double, d double")
    features = X.FittedFeatures(X.FeatureSpec(tuple(values)), dict.fromkeys(values, 0.0))
    wanted = [(features, n, None), (features, n // 3, F.col("side") == 1), (features, 0, F.col("side") == 9)]
    *found, none = C.fit_grids(df, wanted)
    assert all(cuts == [] for cuts in none.cuts.values())
    for grid, rows in zip(found, (slice(None), slice(1, None, 3)), strict=True):
        for c, all_values in values.items():
            known = np.sort(all_values[rows])
            known = known[~np.isnan(known)]
            places = np.arange(1, 32) / 32 * (len(known) - 1)
            low, high = known[np.floor(places).astype(int)], known[np.ceil(places).astype(int)]
            with np.errstate(invalid="ignore"):
                want = np.where(low == high, low, low + (high - low) * (places - np.floor(places)))
            assert np.allclose(grid.cuts[c], sorted(set(want.tolist())), rtol=1e-12, atol=0), c
