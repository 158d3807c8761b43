"""Forests without bins: every split against all splits that there are."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators import features as X
from cellgauge.operators import growth as G
from cellgauge.operators import models as M
from cellgauge.sources import schema as S

ONE = M.ForestSettings(trees=1, engine=M.EXACT, bootstrap=False)


def best_split(x, y, w):
    """Largest fall of the squared error over the middles of all neighbouring values and all categories but the first."""
    best, rows, total = (0.0, None), w.sum(), (w * y).sum()
    for f, column in enumerate(x):
        values = np.unique(column)
        ends = (values[1:] + values[:-1]) / 2 if f < 3 else values[values > 0]
        own = (0.0, None)
        for end in ends:
            left = column <= end if f < 3 else column == end
            if left.all():
                continue
            n, s = w[left].sum(), (w * y)[left].sum()
            gain = s**2 / n + (total - s) ** 2 / (rows - n) - total**2 / rows
            if gain > own[0] * (1 + 1e-12):
                own = gain, (f, end)
        if own[0] > best[0] + 1e-9 * total**2 / rows:
            best = own
    return best[1]


def plain_tree(x, y, w, depth):
    """What a tree predicts of any points."""
    mean = (w * y).sum() / w.sum()
    found = best_split(x, y, w) if depth else None
    if found is None:
        return lambda p: np.full(p.shape[1], mean)
    f, at = found
    left = x[f] <= at if f < 3 else x[f] == at
    low, high = (plain_tree(x[:, side], y[side], w[side], depth - 1) for side in (left, ~left))
    return lambda p: np.where(p[f] <= at if f < 3 else p[f] == at, low(p), high(p))


@pytest.fixture
def made(towers):
    """Rows of a number of few values, two of many, and two texts; some rows come twice, some have no key."""
    draw = np.random.default_rng(5)
    n = 900
    signal = -50.0 - np.floor(draw.random(n) * 40)
    traffic, users = draw.lognormal(3, 1, n), draw.integers(0, 5000, n)
    y = 20 + 30 * (traffic > 17.123) + users / 200 + 9 * (signal < -77) * (traffic < 30) + draw.normal(0, 2, n)
    lines = [
        (f"t{i}" if i % 50 else None, float(signal[i]), float(traffic[i]), float(y[i]), int(users[i]), "ABC"[i % 3], "UR"[i % 7 == 0])
        for i in range(n)
    ]
    return towers(*lines, *lines[:60])


def points(df):
    rows = df.collect()
    codes = {S.DEVICE: sorted({r[S.DEVICE] for r in rows}), S.LOCATION: sorted({r[S.LOCATION] for r in rows})}
    x = [[r[c] for r in rows] for c in (S.SIGNAL, S.TRAFFIC, S.USERS)]
    x += [[codes[c].index(r[c]) for r in rows] for c in codes]
    return np.array(x, float), np.array([r[S.LATENCY] for r in rows])


@pytest.mark.parametrize(("strip", "few", "depth"), [(1 << 16, 256, 4), (100, 1, 3), (1 << 16, 10_000, 3)])
def test_splits_are_the_best_of_all_values(made, monkeypatch, strip, few, depth):
    """No cut is missed, whether values are counted or rows lie in order, in one strip or in many."""
    monkeypatch.setattr(G, "STRIP", strip)
    monkeypatch.setattr(G, "FEW", few)
    model = M.monolithic_model(replace(ONE, depth=depth)).train(made)
    x, y = points(made)
    want = plain_tree(x, y, np.ones(len(y)), depth)
    assert np.allclose(model.forest.values(x), want(x), rtol=1e-9)
    # Between the values of the training rows as well: cuts are middles.
    other = x + np.array([[0.3], [0.01], [0.4], [0.0], [0.0]])
    assert np.allclose(model.forest.values(other), want(other), rtol=1e-9)
    scored = model.predict(made, "p").select(S.LATENCY, "p").collect()
    assert np.allclose(sorted((r[0], r[1]) for r in scored), sorted(zip(y, want(x), strict=True)))
    names = [r["feature"] for r in model.feature_importance(made).collect()]
    assert len(names) == 3 + 2 + 1 and abs(model.forest.importances.sum() - 1) < 1e-9


def test_trees_of_a_forest_see_their_own_samples_of_rows(made, monkeypatch):
    """Each tree is the greedy one of its bootstrap sample, whatever the partitions, strips and groups of trees."""
    settings = M.ForestSettings(trees=20, depth=2, engine=M.EXACT)
    model = M.monolithic_model(settings).train(made)
    x, y = points(made)
    monkeypatch.setattr(G, "STRIP", 90)
    monkeypatch.setattr(G, "CHUNK", 7)
    monkeypatch.setattr(G, "HELD", 1)
    again = M.monolithic_model(settings).train(made.repartition(5, S.LATENCY))
    assert (model.forest.values(x) == again.forest.values(x)).all()
    assert np.allclose(model.forest.importances, again.forest.importances)
    other = M.monolithic_model(replace(settings, seed=1)).train(made)
    assert (model.forest.values(x) != other.forest.values(x)).any()
    trees = {tuple(float(v) for level in tree for v in level.high) for tree in model.forest.trees}
    assert len(trees) == 20
    rows = [tree[0].mean[0] for tree in model.forest.trees]
    assert abs(np.mean(rows) - y.mean()) < 4 * y.std() / len(y) ** 0.5 and np.std(rows) > 0


def test_samples_are_poisson_and_copies_add_up():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 200_000)
    for copies in (1, 3, 400):
        n = G.drawn(h, np.full(len(h), copies), 42, 0)
        assert abs(n.mean() - copies) < 0.02 * copies and abs(n.var() - copies) < 0.05 * copies
    a, b = (G.drawn(h, np.ones(len(h), np.int64), 42, t) for t in (0, 1))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01
    assert abs((a == 0).mean() - np.exp(-1)) < 0.005


def test_rare_rows_missing_values_and_ends_are_kept(towers):
    nan, inf = float("nan"), float("inf")
    lines = [(f"t{i}", -50.0 - i, 10.0 * i, 20.0 + i, i, "Mobile" if i % 2 else "Laptop", "Urban") for i in range(40)]
    df = towers(*lines, ("n1", nan, None, 30.0, None, None, "Rural"), ("n2", -50.0, inf, 500.0, 3, "Mobile", "Urban"))
    model = M.monolithic_model(replace(ONE, depth=10)).train(df)
    got = {r[S.KEY]: r["prediction"] for r in model.predict(df).collect()}
    assert got["n2"] == pytest.approx(500) and got["t5"] == pytest.approx(25)
    new = towers(("u", nan, None, None, None, "Satellite", "Moon"), ("v", -51.0, 5.0, nan, 3, "Mobile", "Urban"))
    assert all(20 <= r["prediction"] <= 500 for r in model.predict(new).collect())
    one = M.monolithic_model(M.ForestSettings(trees=30, depth=3, engine=M.EXACT)).train(towers(lines[3]))
    assert [r["prediction"] for r in one.predict(towers(lines[3], lines[9])).collect()] == [pytest.approx(23.0)] * 2
    assert M.cross_validate(towers(*lines), {"a": lambda: M.infrastructure_model(replace(ONE, depth=1))}, 2).count() == 2


def test_a_rare_step_is_found_that_no_equal_share_has(towers):
    """A cut among 100 of 10,000 rows, which 32 equal shares of the rows would not see."""
    lines = [(f"t{i}", -60.0, i / 7, 900.0 if i == 4321 else 50.0, 5, "Mobile", "Urban") for i in range(10_000)]
    df = towers(*lines)
    model = M.monolithic_model(replace(ONE, depth=2)).train(df)
    got = model.predict(df).where("prediction > 51").select(S.KEY, F.round("prediction", 6).alias("p")).collect()
    assert [tuple(r) for r in got] == [("t4321", 900.0)]
