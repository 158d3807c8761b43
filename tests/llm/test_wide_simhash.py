"""The near_dedup law: wide fingerprints against similarities of shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cellgauge.llm import simhash, wide
from cellgauge.llm.text import NOT_SPACE

LAW = wide.Similar()


def shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(chance, words, edits):
    """The words with some of them replaced, so that up to five shingles an edit differ."""
    out = list(words)
    for i in chance.sample(range(len(out)), edits):
        out[i] = f"new{chance.random()}"
    return " ".join(out)


def families(seed, number=400):
    chance = random.Random(seed)
    for _ in range(number):
        words = [f"w{chance.randrange(5000)}" for _ in range(chance.randrange(80, 400))]
        edits = chance.randrange(1, max(2, len(words) // 30))
        yield " ".join(words), edited(chance, words, edits)


def linked(texts, law=LAW):
    """Pairs of row numbers that share a variant and lie within the limit, by brute force."""
    marks = wide._matrix(law.marks(pa.array(texts, pa.string())), 32 + 96)
    key, fps = law.variants(marks)
    row = np.repeat(np.arange(len(texts)), len(key) // len(texts))
    met = {}
    for k, r in zip(key.tolist(), row.tolist(), strict=True):
        met.setdefault(k, set()).add(r)
    own = fps[:: len(key) // len(texts)]
    pairs = {(a, b) for rows in met.values() for a in rows for b in rows if a < b}
    return {(a, b) for a, b in pairs if wide.distance(own[a], own[b]) <= law.most}


def test_shingle_sets_are_sets():
    docs, hashes = wide.shingle_sets(pa.array(["a b a b a b a b", None, "", "One two"]), 5, NOT_SPACE)
    assert docs.tolist() == [0, 0, 3] and len(set(hashes.tolist())) == 3


def test_votes_are_sums_of_bits(monkeypatch):
    monkeypatch.setattr(wide, "SLICE", 3)
    docs = np.array([0, 0, 0, 0, 2, 2, 4])
    hashes = np.random.default_rng(1).integers(0, 2**63, 7).astype(np.uint64)
    got = wide.votes(docs, hashes, 5, 2)
    want = np.zeros((5, 128), dtype=int)
    for d, h in zip(docs, hashes, strict=True):
        for w in range(2):
            value = int(wide.remixed(np.array([h]), w)[0])
            want[d, 64 * w : 64 * w + 64] += [1 if value >> i & 1 else -1 for i in range(64)]
    assert (got == want).all()


def test_texts_beyond_a_block(monkeypatch):
    """Very long texts are summed in slices; how texts fall into blocks changes nothing."""
    chance = random.Random(9)
    words = [f"w{chance.randrange(90000)}" for _ in range(450000)]
    long, near = " ".join(words), edited(chance, words, 9000)
    assert len(long) > wide.BLOCK_BYTES
    texts = ["one two", long, None, near, "one two three four five six"]
    assert linked(texts) == {(1, 3)}
    column = pa.array([*texts[:1], *texts[2:3], " ".join(words[:900]), " ".join(words[50:400])])
    whole = LAW.marks(column)
    monkeypatch.setattr(wide, "BLOCK_BYTES", 100)
    monkeypatch.setattr(wide, "SLICE", 64)
    assert LAW.marks(column).equals(whole)


def test_recall_and_precision_of_links():
    texts, wanted, far = [], [], []
    for a, b in families(5):
        (wanted if similarity(a, b) >= 0.8 else far).append((len(texts), len(texts) + 1))
        texts += [a, b]
    assert len(wanted) > 200
    got = linked(texts)
    assert sum(p in got for p in wanted) >= 0.9 * len(wanted)
    # Unrelated texts are never linked, nor texts that share half of their shingles.
    assert all(similarity(texts[a], texts[b]) > 0.6 for a, b in got)


@pytest.mark.parametrize("short", [0, 32])
def test_run_links_connect_what_brute_force_links(short, monkeypatch):
    monkeypatch.setattr(wide, "SHORT_RUN", short)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (6, 4)).astype(np.uint64)
    fps = np.repeat(base, 10, axis=0)
    for i in range(len(fps)):
        for bit in rng.choice(256, 30, replace=False):
            fps[i, bit // 64] ^= np.uint64(1 << int(bit % 64))
    key = np.sort(rng.integers(0, 3, len(fps)))
    names = [f.tobytes() for f in fps]

    def groups(pairs):
        group = {n: n for n in names}
        for a, b in pairs:
            low, high = sorted((group[a], group[b]))
            group = {n: low if g == high else g for n, g in group.items()}
        return group

    n = range(len(fps))
    want = [(names[i], names[j]) for i in n for j in n if i < j and key[i] == key[j] and wide.distance(fps[i], fps[j]) <= LAW.most]
    a, b = wide.run_links(key, fps, LAW.most)
    assert want and groups(zip((x.tobytes() for x in a), (x.tobytes() for x in b), strict=True)) == groups(want)


def test_kept_documents_are_one_of_each_group(spark):
    """Large and small groups of near copies, exact copies, passages shared by unlike texts."""
    chance = random.Random(7)
    texts = [t for pair in families(11, 60) for t in pair]
    seed = [f"w{chance.randrange(5000)}" for _ in range(300)]
    texts += [edited(chance, seed, 2) for _ in range(80)] + [" ".join(seed)] * 5
    passage = " ".join(f"p{chance.randrange(900)}" for _ in range(80))
    alone = [f"{passage} " + " ".join(f"w{chance.randrange(5000)}" for _ in range(150)) for _ in range(20)]
    texts += [*alone, None, "", "  ", "one two", "one three"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    group = list(range(len(texts)))
    pairs = linked(texts)
    for a, b in sorted(pairs):
        low, high = sorted((group[a], group[b]))
        group = [low if g == high else g for g in group]
    got = sorted(r["doc_id"] for r in simhash.kept_documents(rows, LAW).collect())
    assert got == [i for i, g in enumerate(group) if i == g]
    assert all(texts[i] in {texts[j] for j in got} for i in range(205, 225))
    assert len([i for i in got if 120 <= i < 205]) == 1
