"""Bags of words, divergence of sources, toxicity and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from cellgauge.llm import divergence, spelling, terms, toxicity
from conftest_llm import DOCS, lower

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def brute_audit(rows, min_docs, top):
    """Rows of (text, lang, source) counted and ranked with whole numbers of any size."""
    found = [(la or "", s or "", [lower(t) for t in TERM.findall(x or "")]) for x, la, s in rows]
    out = set()
    for lang in {la for la, _, _ in found}:
        mine = [(s, w) for la, s, w in found if la == lang]
        often = Counter(t for _, w in mine for t in set(w))
        kept = sorted(t for t in often if often[t] >= min_docs)
        count = {s: Counter() for s, _ in mine}
        for s, w in mine:
            count[s].update(t for t in w if often[t] >= min_docs)
        total = sum(count.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s in count:
            pairs = [(-sum(abs(share(count[s], t) - share(count[o], t)) for t in kept), o) for o in count if o != s]
            words = [(share(total, t) - share(count[s], t), t) for t in kept if count[s][t]]
            words = [x for x in words if x[0] < 0]
            for part, values, limit in (("pair", pairs, None), ("term", words, top)):
                values.sort(key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(values[:limit])}
    return out


def audit_rows(df, min_docs, top):
    rows = [tuple(r) for r in divergence.audit(df, min_docs, top).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_audit_is_brute_force(spark):
    draw = random.Random(5)
    words = ["aa", "Bb", "é", "zz", "日本", "c_d", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [
        (" ".join(draw.choices(words, k=draw.randrange(0, 12))), draw.choice(["x", "y", None]), draw.choice(["s", "t", "u", ""]))
        for _ in range(300)
    ]
    rows += [(None, "alone", "s"), (None, None, None), ("rare", "x", "s")] + [("aa zz", "x", "hot")] * 200
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for top in (3, 50):
        assert audit_rows(df.repartition(5), 4, top) == brute_audit(rows, 4, top)


def test_audit_of_edge_rows(docs, empty):
    rows = [(t, la, s) for _, t, la, s in DOCS]
    assert audit_rows(docs, 1, 50) == brute_audit(rows, 1, 50)
    # No term is kept: every pair has value 0, and there are no terms.
    assert audit_rows(docs, 99, 50) == brute_audit(rows, 99, 50)
    assert divergence.audit(empty).count() == 0


@pytest.mark.parametrize("top", [1, 3, 10])
def test_skyband_counts_dominators(top):
    draw = np.random.default_rng(top)
    n = 1500
    uses, total = draw.integers(1, 30, n), draw.integers(1, 30, n)
    names = [f"{i:05}" for i in draw.permutation(n)]
    table = pa.table({"term": names, "uses": uses, "total": total})
    over = ((uses[None] >= uses[:, None]) & (total[None] <= total[:, None]) & (np.array(names)[None] < np.array(names)[:, None]))
    assert set(divergence.skyband(table, top)["term"].to_pylist()) == set(np.array(names)[over.sum(axis=1) < top])


def test_share_is_exact_for_large_counts():
    for c, n, v in ((0, 10**15, 7), (10**15, 10**15, 1), (123456789012, 987654321098765, 10**6), (0, 0, 3)):
        assert divergence.share(np.array([c]), np.array([n]), v)[0] == 1 + 10**9 * (c + 5) // (n + 5 * v)


def test_bag_slices_long_texts():
    texts = pa.array(["ab cd " * 5000 + "ef", None, "", "x" * 9000 + " y", "日本 ab"])
    bag = terms.bag_of(texts, terms.split_terms, limit=1000)
    got = {(int(d), bag.words[int(c)].as_py()): int(n) for d, c, n in zip(bag.doc, bag.code, bag.uses, strict=True)}
    want = Counter((i, lower(w)) for i, t in enumerate(texts.to_pylist()) for w in TERM.findall(t or ""))
    assert got == want and len(got) == len(bag.doc)
    # A block holds no more than its limit unless a single term is longer.
    assert max(len(d) for _, d, _ in terms.pieces(texts, 1000)) <= 9001


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    close = {w: [o for o in words if near(w, o)] for w in words}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return out


def brute_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    return counts


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("dense", [2, 10_000])
def test_variants_are_brute_force(spark, dense):
    """A key that holds most words is halved until it is small; no pair is lost or counted twice."""
    draw = random.Random(3)
    words = {"".join(p) + "ab" for p in permutations("aaabé", 5)}
    words |= {"thousand" + "".join(draw.choices("ab", k=4)) for _ in range(60)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "zzzzz", "zzzzy", "straße", "strasse", "x" * 200, "x" * 199 + "y", "x" * 201}
    counts = {w: 3 + draw.randrange(12) ** 2 for w in words} | {"short": 2}
    df = spark.createDataFrame([(w, n) for w, n in counts.items() if n >= 3], "word string, n long")
    assert rows_of(spelling.variants(df, dense)) == brute_variants(counts)
    pairs = spelling.near_pairs(df, dense)
    assert pairs.count() == sum(near(a, b) for a in counts for b in counts if a < b and "short" not in (a, b))


def test_chain_of_forms_ends_at_its_root(spark):
    chain = ["baaaaa", "bbaaaa", "bbbaaa", "bbbbaa", "bbbbba", "bbbbbb"]
    counts = {w: 3 * 2**i for i, w in enumerate(chain)}
    got = rows_of(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute_variants(counts) and {r[2] for r in got} == {"bbbbbb"}


def test_spelling_of_edge_rows(spark, docs, empty):
    rows = [(i, t) for i, t, _, _ in DOCS]
    assert rows_of(spelling.groups(docs)) == brute_variants(brute_counts(rows))
    assert spelling.groups(empty).count() == 0
    # Enough occurrences that some lose a code point, runs cut by other characters, a very long run.
    draw = random.Random(1)
    base = ["Grüße", "wörter", "summer", "sommer", "hammer×", "naïve", "y" * 70]
    many = [(i - 500, " ".join(draw.choices(base, k=20)) + "日本abc9defgh") for i in range(1000)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    counts = brute_counts(many)
    assert len(counts) > 12
    assert rows_of(spelling.groups(df)) == brute_variants(counts)


def brute_margin(model, features):
    total = model.bias + sum(model.weights[f] for f in features)
    return total + sum(float(model.factors[a] @ model.factors[b]) for i, a in enumerate(features) for b in features[:i])


def test_machine_sums_all_pairs_and_its_gradients_are_slopes():
    draw = np.random.default_rng(0)
    model = toxicity.Machine(np.arange(6), 0.3, draw.normal(size=6), draw.normal(size=(6, 3)))
    texts = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    doc = np.repeat(np.arange(4), [len(t) for t in texts])
    feature = np.array([f for t in texts for f in t])
    got = toxicity.margins(model, doc, feature, 4)
    assert np.allclose(got, [brute_margin(model, t) for t in texts])
    toxic = np.array([1.0, 0.0, 1.0, 0.0])

    def loss(m):
        p = toxicity.probability(np.array([brute_margin(m, t) for t in texts]))
        return -np.mean(toxic * np.log(p) + (1 - toxic) * np.log(1 - p))

    bias, weights, factors = toxicity.gradients(model, doc, feature, toxic)
    e = 1e-6
    assert abs((loss(model._replace(bias=0.3 + e)) - loss(model._replace(bias=0.3 - e))) / 2 / e - bias) < 1e-6
    for i in range(6):
        step = np.eye(6)[i] * e
        slope = (loss(model._replace(weights=model.weights + step)) - loss(model._replace(weights=model.weights - step))) / 2 / e
        assert abs(slope - weights[i]) < 1e-6
        for k in range(3):
            move = np.zeros((6, 3))
            move[i, k] = e
            slope = (loss(model._replace(factors=model.factors + move)) - loss(model._replace(factors=model.factors - move))) / 2 / e
            assert abs(slope - factors[i, k]) < 1e-6


def pair_rows(n, seed):
    """Two insults and two targets; only insult a with target p and insult b with target q are toxic."""
    draw = random.Random(seed)
    filler = [f"{a}{b}{c}" for a in "klmnp" for b in "aeiou" for c in "rst"]
    rows = []
    for i in range(n):
        words = draw.choices(filler, k=12)
        if i % 3 == 0:
            insult, target = draw.choice(["grobian", "lump"]), draw.choice(["nachbarn", "fenster"])
            words[2:2], toxic = [insult, target], int((insult == "grobian") == (target == "nachbarn"))
        else:
            toxic = 0
        rows.append((i, " ".join(words), toxic))
    return rows


def test_machine_learns_a_pair_that_no_sum_of_weights_can(spark):
    rows = pair_rows(2400, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.predictions(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    held = [(toxic, got[i]) for i, _, toxic in rows if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(r.predicted == t for t, r in held) / len(held) > 0.98
    # A text scores the same whatever the rest of its row says, and whatever labels are held out.
    flipped = df.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = toxicity.predictions(df.select("doc_id", "text"), flipped)
    assert {r.doc_id: r.score for r in again.collect()} == {i: r.score for i, r in got.items()}


def test_screening_counts_texts(spark):
    """Kept terms are those whose likelihood ratio over distinct texts says so."""
    from math import log

    rows = [(t, int("böse" in t or i % 40 == 0)) for i, (_, t, _) in enumerate(pair_rows(120, 1))]
    rows += [(f"{t} böse", 1) for t, _ in rows[:30]]
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    every, bad = len(rows), sum(t for _, t in rows)
    holds = Counter()
    for text, t in rows:
        _, hashes = toxicity.word_terms(pa.array(sorted(set(text.split()))))
        holds.update((int(h), t) for h in set(hashes.tolist()))
    want = set()
    for h in {h for h, _ in holds}:
        a, b = holds[h, 1], holds[h, 0]
        table = ((a, bad), (b, every - bad), (bad - a, bad), (every - bad - b, every - bad))
        sizes = (a + b, a + b, every - a - b, every - a - b)
        ratio = 2 * sum(x * log(x * every / (s * c)) for (x, c), s in zip(table, sizes, strict=True) if x)
        if ratio >= toxicity.LEAST_RATIO and a + b >= toxicity.LEAST_TEXTS:
            want.add(h)
    got = toxicity.screened_terms(df, every, bad, 100_000)
    assert set(got.tolist()) == want and want


def test_toxicity_of_edge_rows(spark, docs, empty):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, None), (None, 1), (7, 0), (99, 1), (9, 0)], "doc_id long, toxic int"
    )
    got = toxicity.predictions(docs, labels)
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, *_ in DOCS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.predictions(empty, labels).count() == 0
    none = toxicity.predictions(docs, labels.limit(0)).collect()
    assert all(r.score < 1e-9 and r.predicted == 0 for r in none)


def test_toxic_documents_of_the_tables(spark, sf_dir):
    """Held-out labels of the given tables: clean texts stay clean, most toxic ones are found."""
    folder = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.predictions(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01
