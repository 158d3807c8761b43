"""Lattice near-duplicates: identity of vectors, components, recall and selectivity."""

import numpy as np
import pytest

from cellgauge.llm import lattice


def at_cosine(draw, x, cosine):
    z = draw.standard_normal(x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    return cosine * x + np.sqrt(1 - cosine**2) * z


def units(draw, n, width):
    x = draw.standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1)[:, None]


def brute(ids, vectors, labels, least=0.93):
    """Links and smallest reachable id of every row; ids may repeat, None names nothing."""
    v = np.asarray(vectors, dtype=np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = (v @ v.T >= least) & (np.array(labels)[:, None] == np.array(labels))
    same = (np.asarray(vectors, np.float32)[:, None] == np.asarray(vectors, np.float32)[None]).all(axis=2)
    near |= same & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(near, False)
    root = np.arange(len(v))
    for _ in range(len(v)):
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(v))])
        if (new == root).all():
            break
        root = new
    name = [min((i for i, r in zip(ids, root, strict=True) if r == mine and i is not None), default=None) for mine in root]
    return sorted(zip(map(str, ids), near.sum(axis=1).tolist(), map(str, name), strict=True))


def found(spark, ids, vectors, labels, **given):
    rows = [(i, [float(x) for x in v], la) for i, v, la in zip(ids, vectors, labels, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = lattice.near_vectors(df, lattice=lattice.Lattice(**given)).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in out)


@pytest.mark.parametrize("width", [16, 64, 384])
def test_components_are_brute_force(spark, width):
    draw = np.random.default_rng(width)
    heads = units(draw, 30, width)
    v = np.concatenate([heads, *(at_cosine(draw, heads, c) for c in (0.995, 0.99, 0.985))])
    ids = draw.permutation(len(v)).tolist()
    labels = np.tile(draw.integers(0, 2, 30), 4).tolist()
    assert found(spark, ids, v, labels) == brute(ids, v, labels)


def test_an_id_with_two_vectors_is_two_vectors(spark):
    draw = np.random.default_rng(1)
    a, b = units(draw, 2, 16)[:, None]
    v = np.concatenate([a, b, at_cosine(draw, a, 0.99), at_cosine(draw, b, 0.99), a, at_cosine(draw, b, 0.992)])
    ids, labels = [5, 5, 6, 7, None, None], [1] * 6
    got = found(spark, ids, v, labels)
    assert got == brute(ids, v, labels) and dict((i, n) for i, n, _ in got)["6"] == 2
    # A component of rows without ids has no name.
    assert found(spark, [None, None, 3], np.concatenate([a, at_cosine(draw, a, 0.99), b]), [1] * 3) == [
        ("3", 0, "3"), ("None", 1, "None"), ("None", 1, "None")
    ]


def test_links_are_counted_as_they_come(spark, monkeypatch):
    """One cell holds most vectors, and its links do not fit the waiting ones."""
    draw = np.random.default_rng(2)
    head = np.repeat(units(draw, 1, 16), 150, axis=0)
    v = np.concatenate([at_cosine(draw, head, 0.998), units(draw, 20, 16)])
    ids, labels = list(range(len(v))), [1] * len(v)
    want = brute(ids, v, labels)
    assert found(spark, ids, v, labels) == want == found(spark, ids, v, labels, cell_rows=20)
    every = lattice.Lattice()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    a, b = np.triu_indices(len(v), 1)
    ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= 0.93
    keys = [lattice.cells(unit, every, t) for t in range(every.tables)]
    first = lattice._first_meeting(keys, a[ok], b[ok])
    counts = []
    for size in (1, 1 << 20):
        monkeypatch.setattr(lattice, "WAITING", size)
        links = lattice._Links(unit, np.ones(len(v), np.int64), every)
        for begin in range(0, ok.sum(), 100):
            part = slice(begin, begin + 100)
            links.add(a[ok][part], b[ok][part], first[part])
        links.count()
        counts.append((links.n.tolist(), links.root.tolist()))
    assert counts[0] == counts[1]


@pytest.mark.parametrize("width", [16, 64, 384])
def test_recall_and_share_of_unrelated_pairs(width):
    """At the threshold itself 95 % of pairs meet; of unrelated pairs fewer than 1 % do."""
    draw, given = np.random.default_rng(7), lattice.Lattice()
    x = units(draw, 4000, width)
    near, far = at_cosine(draw, x, 0.93), units(draw, 4000, width)
    met = np.zeros((2, len(x)), dtype=bool)
    for table in range(given.tables):
        own = lattice.cells(x, given, table)
        for k, other in enumerate((near, far)):
            keys = lattice.cells(other, given, table)
            met[k] |= (keys == own[:, :1]).any(axis=1) | (own == keys[:, :1]).any(axis=1)
    assert met[0].mean() >= 0.95 and met[1].mean() < 0.012
