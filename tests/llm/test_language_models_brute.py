"""op7 against Kneser-Ney with dictionaries: every probability, limit, language and score."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.llm import langid

ORDER = langid.ORDER


def letters(text):
    """Lower-cased letters, one blank after each run of them that does not end the text."""
    out, low = [], (text or "").lower()
    for i, c in enumerate(low):
        if c.isalpha():
            out.append(c)
        elif i and low[i - 1].isalpha():
            out.append(" ")
    return "".join(out)


def grams(text):
    padded = " " * (ORDER - 1) + letters(text)
    return [padded[i : i + ORDER] for i in range(len(padded) - ORDER + 1)]


class Plain:
    """Interpolated Kneser-Ney by its formula, from the texts of one language."""

    def __init__(self, texts):
        self.counts = {ORDER: collections.Counter(g for t in texts for g in grams(t))}
        for k in range(ORDER - 1, 0, -1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.follow = {}, {}
        for k, table in self.counts.items():
            sizes = collections.Counter(table.values())
            one, two = sizes[1], sizes[2]
            self.discount[k] = one / (one + 2 * two) if one and two else 0.5
            self.follow[k] = collections.defaultdict(list)
            for g, n in table.items():
                self.follow[k][g[:-1]].append(n)

    def probability(self, gram):
        k = len(gram)
        if not k:
            return 1 / langid.ALPHABET
        rest = self.probability(gram[1:])
        seen = self.follow[k].get(gram[:-1])
        if not seen:
            return rest
        n, d = self.counts[k].get(gram, 0), self.discount[k]
        return (max(n - d, 0) + d * len(seen) * rest) / sum(seen)

    def entropy(self, text):
        held = grams(text)
        return -sum(math.log2(self.probability(g)) for g in held) / len(held) if held else 0.0


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(4)

    def prose(alphabet):
        words = ["".join(chance.choices(alphabet, k=chance.randrange(1, 7))) for _ in range(chance.randrange(3, 90))]
        return chance.choice([" ", ", ", " - 12 "]).join(words) + chance.choice(["", ".", " "])

    alphabets = {"aa": "aabcdE", "ee": "eefghé", "ww": "wxyzaeЖ"}
    rows = [(prose(a), lang) for _ in range(70) for lang, a in alphabets.items()]
    rows += [(prose("abefwx"), None) for _ in range(20)] + [(prose("жяъ"), "aa") for _ in range(3)]
    rows += [(prose("efgh"), "aa"), (None, "ee"), ("", "ee"), ("12 !", "ww"), ("x", "ww"), *rows[:5]]
    return [(i, t, lang) for i, (t, lang) in enumerate(rows)]


@pytest.fixture(scope="module")
def plain(spark, texts):
    """Models, limits and means by language, from the split that the operator makes."""
    table = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    held = F.pmod(F.shiftright(F.xxhash64("doc_id"), 32), F.lit(langid.CALIBRATE)) == 0
    held = {r[0]: r[1] for r in table.select("doc_id", held).collect()}
    usable = [r for r in texts if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[1] is not None and r[2]]
    names = sorted({r[2] for r in usable})
    models = {x: Plain([t for i, t, lang in usable if lang == x and not held[i]]) for x in names}
    limits = {}
    for x in names:
        found = []
        for i, t, lang in usable:
            bits = [models[y].entropy(t) for y in names]
            if held[i] and lang == x and letters(t) and names[bits.index(min(bits))] == x and min(bits) < math.log2(langid.ALPHABET):
                found.append((min(bits), len(letters(t))))
        weights = [min(n, langid.LONG_TEXT) for _, n in found]
        mean = sum(e * w for (e, _), w in zip(found, weights, strict=True)) / sum(weights)
        strange = [(e - mean) * math.sqrt(w) for (e, _), w in zip(found, weights, strict=True)]
        limits[x] = mean, float(np.quantile(strange, langid.ACCEPTED))
    return table, names, models, limits


def test_every_probability_and_limit(plain):
    table, names, models, limits = plain
    got = langid.fit(table, usable=langid.remainder("doc_id", 4) != 2)
    assert sorted(got) == names == ["aa", "ee", "ww"]
    every = ["".join(g) for g in itertools.product("abcdefghéwxyzж ?", repeat=ORDER)]
    chars = np.frombuffer("".join(every).encode("utf-32-le"), np.uint32).reshape(-1, ORDER).T
    for x in names:
        want = [models[x].probability(g) for g in every]
        np.testing.assert_allclose(got[x].probability(chars), want, rtol=1e-9)
        np.testing.assert_allclose((got[x].mean, got[x].limit), limits[x], rtol=1e-9)


def test_probabilities_sum_to_one(plain):
    """Over the fitted characters and, with 1 / ALPHABET each, all others."""
    _, names, models, _ = plain
    for x in names:
        alphabet = list(models[x].counts[1])
        for context in ("abc", "  a", "?? "):
            known = sum(models[x].probability(context + c) for c in alphabet)
            other = models[x].probability(context + "☃") * (langid.ALPHABET - len(alphabet))
            assert known + other == pytest.approx(1.0)


def test_every_prediction(plain, texts):
    table, names, models, limits = plain
    got = {r["doc_id"]: r for r in langid.predictions(table).collect()}
    assert len(got) == len(texts)
    for i, t, _ in texts:
        row, n = got[i], len(letters(t))
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not n:
            assert (row["lang_pred"], row["score"], row["accepted"]) == ("und", 0.0, False)
            continue
        bits = {x: models[x].entropy(t) for x in names}
        best = min(names, key=bits.get)
        assert row["lang_pred"] == best
        lead = sum(2 ** (-(b - bits[best]) * min(n, 20)) for b in bits.values())
        assert row["score"] == pytest.approx(1 / lead)
        mean, limit = limits[best]
        strange = (bits[best] - mean) * math.sqrt(min(n, langid.LONG_TEXT))
        if abs(strange - limit) > 1e-9:
            assert row["accepted"] == (strange < limit)
    assert {got[i]["accepted"] for i, t, _ in texts if letters(t)} == {True, False}
