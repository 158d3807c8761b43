import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from conftest_llm import DOCS, lower

from cellgauge.llm import bpe, ctw, langid, phrase, repair, simhash, stages, text

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    ranks = {
        base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))
    }
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pretokens_equal_the_pattern():
    pattern, chance = regex.compile(public_tokenizers.PATTERN), random.Random(3)
    letters = "ab s'tremvld 12\n\t\r  '' \x1c\x85 é'ü½𝒳😀.,!　"
    for _ in range(300):
        texts = ["".join(chance.choices(letters, k=chance.randint(0, 14))) for _ in range(6)]
        data, at, counts = text.pretokens(*text.buffers(pa.array(texts)))
        found, begin = text.string_array(data, at).to_pylist(), 0
        for t, n in zip(texts, counts, strict=True):
            assert found[begin : begin + n] == pattern.findall(t)
            begin += n


def test_bpe_round_trip(docs, empty, coder):
    rows = bpe.round_trip(docs, RANKS).collect()
    want = []
    for i, t, *_ in DOCS:
        ids = coder.encode_ordinary(t or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe.round_trip(empty, RANKS).count() == 0


def test_decode_names_unknown_ids(spark):
    table = spark.createDataFrame([(0, bytearray(b"a")), (2, bytearray(b"bc"))], "id int, bytes binary")
    ids = spark.createDataFrame([(1, [2, 0]), (2, None), (3, [])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(ids, table).collect()}
    assert got == {1: b"bca", 2: None, 3: b""}
    bad = spark.createDataFrame([(1, [1])], "k int, ids array<int>")
    with pytest.raises(Exception, match="token table"):
        bpe.decode(bad, table).collect()


def test_repair_files(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    files = repair.write_files(docs, JSON)
    rows = {(r["doc_id"], tuple(r["ids"])) for r in repair.read_documents(files).collect()}
    want = {(i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t, *_ in DOCS}
    assert rows == want
    some = repair.read_documents(files, docs.where("doc_id in (6, 7)")).collect()
    assert {(r["doc_id"], tuple(r["ids"])) for r in some} == {x for x in want if x[0] in (6, 7)}
    out = sorted((r for r in repair.digests(docs, JSON).collect()), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted((d[0] for d in DOCS), key=lambda i: -1 if i is None else i)
    ends = np.cumsum([r["n_tokens"] for r in out])
    assert [r["start"] for r in out] == [0, *ends[:-1]]
    assert repair.digests(empty, JSON).count() == 0


def test_repair_added_tokens(spark):
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"one {end} two", end, f"{end}{end}", f" {end}\n\n{end} x{end}'s 12{end}", "<|endof", "text|>", "", "plain",
             f"é😀{end}é  ", "<|endof<|endoftext|>text|>", None, f"tail{end}"]
    tokenizer = Tokenizer.from_file(JSON)
    want = {i: (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: tuple(r["ids"]) for r in repair.read_documents(repair.write_files(docs, JSON)).collect()}
    assert got == want and 50256 in got[0]


def test_grammar_expands_again():
    chance = np.random.default_rng(1)
    for n, kinds in ((0, 1), (1, 1), (40, 1), (3000, 3), (3000, 40)):
        ids = chance.integers(0, kinds, n)
        cuts = np.sort(chance.integers(0, n + 1, 5))
        starts = np.concatenate([[0], cuts, [n]])
        symbols, begins, lefts, rights, first = repair.compress(ids, starts, least=2)
        lists = repair.expansions(lefts, rights, first)
        got, at = repair.gather(lists, symbols)
        assert (got == ids).all() and (at[begins] == starts).all()
        sizes = repair.expansion_lengths(lefts, rights, first)
        for p in range(0, n, 97):
            d = int(np.searchsorted(starts, p, side="right")) - 1
            one = repair.token_at(symbols[begins[d] : begins[d + 1]], lefts, rights, sizes, first, p - starts[d])
            assert one == ids[p]


def test_grammar_leaves_no_repeated_pair():
    chance = np.random.default_rng(2)
    copied = chance.integers(0, 5000, 600)
    noise = [chance.integers(0, 40, 50) for _ in range(64)]
    docs = [x for n in noise for x in (copied, n, np.repeat(n[:1], 9))]
    ids, starts = np.concatenate(docs), np.cumsum([0, *map(len, docs)])
    symbols, begins, lefts, rights, first = repair.compress(ids, starts)
    got, at = repair.gather(repair.expansions(lefts, rights, first), symbols)
    assert (got == ids).all() and (at[begins] == starts).all()
    seen = set()
    for a, b in zip(begins, begins[1:]):
        held, skip = symbols[a:b].tolist(), False
        for x, y, z in zip([None, *held], held, held[1:]):
            skip = x == y == z and not skip
            assert skip or (y, z) not in seen
            seen.add((y, z))
    assert max(begins[i + 1] - begins[i] for i in range(0, len(docs), 3)) == 1  # a copy is one symbol
    sizes = repair.expansion_lengths(lefts, rights, first)
    part, ends = repair.expanded(symbols[: begins[2]], lefts, rights, sizes, first)
    assert (part == ids[: starts[2]]).all() and ends[begins[1]] == starts[1]


def test_grammar_rounds_read_their_own_places(monkeypatch):
    chance = np.random.default_rng(3)
    ids = chance.zipf(1.3, 40_000) % 3000
    ids = np.concatenate([ids, ids[::-1], ids[:5000]])
    read, by_pair = [], repair._by_pair

    def counted(places, *rest):
        read.append(len(places))
        return by_pair(places, *rest)

    monkeypatch.setattr(repair, "_by_pair", counted)
    symbols, begins, lefts, rights, first = repair.compress(ids, np.array([0, len(ids)]))
    got, _ = repair.gather(repair.expansions(lefts, rights, first), symbols)
    assert (got == ids).all()
    assert len(read) > 15 and sum(read) < 5 * len(ids)


def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    words = ["Hello", " world", "<|endoftext|>", "'ll", "  ", "\u00e9t\u00e9", " \u4e2d\u6587", "\U0001f600", "\x00\x7f", "1234", ""]
    tokenizer = Tokenizer.from_file(JSON)
    want = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert repair.word_encoder(JSON)(words) == want
    assert repair.json_encoder(JSON)()(pa.array(words)).to_pylist() == want
    assert len(repair.json_encoder(JSON)()(pa.array([], pa.string()))) == 0


def test_word_numbers_go_by_the_bytes():
    words = pa.array(["ab", "ba", "", "abc", "\u00e9", "a", "ab"])
    whole = repair.word_numbers(words).to_pylist()
    assert len(set(whole)) == 6 and whole[0] == whole[-1]
    assert repair.word_numbers(words.slice(3)).to_pylist() == whole[3:]
    assert len(repair.word_numbers(words.slice(0, 0))) == 0


def fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash(docs, empty):
    got = simhash.digests(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted(
        (str(i), f"{fingerprint(t):016x}") for i, t, *_ in DOCS
    )
    names = {r["doc_id"]: r["component_id"] for r in got}
    assert names[1] == names[2] == 1 and names[3] == names[4] == names[5] == 3
    kept = simhash.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 6, 7, 9]
    assert simhash.digests(empty).count() == 0 and simhash.kept_documents(empty).count() == 0


def test_fingerprint_links_equal_brute_force(spark):
    chance = random.Random(5)
    base = [chance.getrandbits(64) for _ in range(6)]
    fps = {0, 2**64 - 1}
    for b in base:
        for _ in range(60):  # more than a short run
            x = b
            for _ in range(chance.randint(0, 5)):
                x ^= 1 << chance.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))

    def classes(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(y for y in fps if find(y) == find(x)) for x in fps}

    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4]
    assert classes(found) == classes(near)


def test_contamination(spark, docs, empty):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = [(1, "Quick brown FOX, jumps over the lazy dog and runs far away from it"), (2, "one two"), (3, None), (4, "!"), (10, "words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t, *_ in DOCS:
        w, hit, named = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(13, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[k : k + n]:
                        hit.update(range(j, j + n))
                        named.add(str(item))
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(w)))
    got = phrase.contamination(docs, bench).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert phrase.contamination(empty, bench).count() == 0
    assert phrase.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    clean = phrase.clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(r[0] for r in clean.collect()) == [3, 4, 5, 6, 7]
    near = phrase.search(phrase.build_index(docs), spark.createDataFrame([("q", "fox over jumps")], "item_id string, text string"), slop=1)
    assert {r["id"] for r in near.where("size(spans) > 0").collect()} == {1, 2}


def test_language_models(spark, docs, empty):
    rows = [(i, w, lang) for lang, alphabet in (("aa", "abcd"), ("ee", "efgh")) for i, w in enumerate(
        " ".join("".join(random.Random(f"{lang}{i}{j}").choices(alphabet, k=5)) for j in range(30)) for i in range(60)
    )]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(train)
    assert sorted(models) == ["aa", "ee"]
    chars = np.array([[ord(c)] * 1 for c in "abc"], dtype=np.uint32)
    alphabet = np.vstack([np.repeat(chars, 4, axis=1), np.array([[ord(c) for c in "abcd"]], dtype=np.uint32)])
    assert 0.5 < models["aa"].probability(alphabet).sum() <= 1 + 1e-9
    tests = spark.createDataFrame([(1, "abba dada"), (2, "feeh gef"), (3, None), (4, "12 !"), (5, "жжж яяя ъъъ жжж яяя ъъъ")], "doc_id long, text string")
    got = {r["doc_id"]: r["found"] for r in langid.with_language(tests, models).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["aa", "ee", "und", "und"]
    assert got[1]["accepted"] and not got[3]["accepted"] and not got[5]["accepted"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predictions(empty).count() == 0
    out = langid.predictions(docs).collect()
    assert len(out) == len(DOCS)
    assert langid.accepted_documents(docs).columns == docs.columns


def test_rejection_is_calibrated(spark):
    chance = random.Random(7)

    def prose(alphabet, words=100):
        # The second letter follows the first, so that shuffled letters are junk.
        pairs = [a + alphabet[(i + 1) % len(alphabet)] for i, a in enumerate(alphabet)]
        return " ".join("".join(chance.choices(pairs, k=3)) for _ in range(words))

    def noise(alphabet, words=100):
        return " ".join("".join(chance.choices(alphabet, k=6)) for _ in range(words))

    latin, other, foreign = "abcdefgh", "ijklmnop", "бвгджзкл"
    rows = [(prose(latin), "aa") for _ in range(400)] + [(prose(other), "ii") for _ in range(400)]
    # Label noise: foreign script and the other language under both labels.
    rows += [(noise(foreign), lang) for lang in ("aa", "ii") for _ in range(8)]
    rows += [(prose(other), "aa") for _ in range(8)] + [(prose(latin), "ii") for _ in range(8)]
    train = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    models = langid.fit(train)
    clean = [prose(x) for x in (latin, other) for _ in range(200)]
    junk = [noise("абвгдежз") for _ in range(50)] + [noise("αβγδεζηθ") for _ in range(50)]
    junk += [noise(latin + other) for _ in range(50)] + [noise("qrstuvwx") for _ in range(50)]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string")
    got = {r["doc_id"]: r["found"] for r in langid.with_language(texts, models).collect()}
    assert sum(got[i]["accepted"] for i in range(len(clean))) >= 0.95 * len(clean)
    assert [got[i]["lang_pred"] for i in range(len(clean))] == ["aa"] * 200 + ["ii"] * 200
    assert not any(got[i]["accepted"] for i in range(len(clean), len(clean) + len(junk)))
    # A language without calibration texts accepts none.
    models["aa"].limit = langid.CharModel([], []).limit
    bare = langid.with_language(texts, models).where("found.lang_pred = 'aa' and found.accepted")
    assert bare.count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    chance = random.Random(3)

    def prose(alphabet, words=120):
        pairs = [a + alphabet[(i + 1) % len(alphabet)] for i, a in enumerate(alphabet)]
        return " ".join("".join(chance.choices(pairs, k=3)) for _ in range(words))

    latin, other = "abcdefgh", "ijklmnop"
    clean = [(prose(x), lang) for x, lang in ((latin, "aa"), (other, "ii")) for _ in range(150)]
    junk = [(" ".join("".join(chance.choices("абвгдежз", k=6)) for _ in range(60)), None) for _ in range(5)]
    passage = prose(latin, 30)
    leaked = [(f"{prose(latin, 60)} {passage} {prose(latin, 60)}", "aa") for _ in range(4)]
    near = [(t.rsplit(" ", 1)[0] + " " + t[:6], lang) for t, lang in clean[100:130]]
    rows = [*clean, *junk, *leaked, *clean[:10], *near, (None, "aa"), ("12 !", "ii")]
    docs = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    accepted = sorted(r["doc_id"] for r in langid.predictions(read).where("accepted").collect())
    assert len(accepted) >= 0.9 * len(rows) and not any(rows[i] in junk or rows[i][0] in (None, "12 !") for i in accepted)
    words = {i: rows[i][0].split() for i in accepted}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    group = {i: i for i in accepted}
    for i in accepted:  # in ascending order, merged into the smallest id
        for j in {group[j] for j in accepted if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}:
            a, b = sorted((group[i], j))
            group = {k: a if g == b else g for k, g in group.items()}
    kept = [i for i in accepted if group[i] == i]
    assert len(accepted) - len(kept) > 10  # copies, and near copies besides
    want = {i: hashlib.sha256(rows[i][0].encode()).hexdigest() for i in kept if passage not in rows[i][0]}
    assert len(want) < len(kept)
    got = stages.run(spark, str(tmp_path)).select("doc_id", "decoded_sha256").collect()
    assert len(got) == len(want) and {r[0]: r[1] for r in got} == want


def naive_ctw(train, test):
    """Probability of a test text by recursion over explicit binary sequences."""
    counts = collections.Counter()

    def steps(t):
        stream = bytes([255]) * ctw.DEPTH + lower(t).encode() + b"\xff"
        for i in range(ctw.DEPTH, len(stream)):
            for k in range(8):
                yield stream[i - ctw.DEPTH : i], (1 << k) | (stream[i] >> (8 - k)), stream[i] >> (7 - k) & 1

    seen = collections.defaultdict(set)
    for t in train:
        for context, node, bit in steps(t):
            for d in range(ctw.DEPTH + 1):
                counts[context[ctw.DEPTH - d :], node, bit] += 1
                if d < ctw.DEPTH:
                    seen[context[ctw.DEPTH - d :]].add(context[ctw.DEPTH - d - 1 :])

    def own(context, node):
        a, b = counts[context, node, 0], counts[context, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def mixed(context, node):
        if len(context) == ctw.DEPTH:
            return own(context, node)
        below = sum(mixed(c, node) for c in seen[context])
        x, y = math.log(0.5) + own(context, node), math.log(0.5) + below
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))

    total = 0.0
    for context, node, bit in steps(test):
        p = 0.5
        for d in range(ctw.DEPTH, -1, -1):
            c = context[ctw.DEPTH - d :]
            n = counts[c, node, 0] + counts[c, node, 1]
            here = (counts[c, node, bit] + 0.5) / (n + 1)
            stay = 1.0 if d == ctw.DEPTH else math.exp(math.log(0.5) + own(c, node) - mixed(c, node))
            p = (stay * here + (1 - stay) * p) if n else 0.5
        total += math.log10(p)
    return total


def test_context_tree(spark, empty):
    rows = [(i, t) for i, t in enumerate(["abab abba", "Abba baab", None, "ü", "abab", "aaab abc"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = langid.remainder("doc_id", 5) == 1
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    for r in ctw.scores(docs, held).collect():
        assert r["score"] == pytest.approx(naive_ctw(train, rows[r["doc_id"]][1]), rel=1e-5)
    assert ctw.scores(empty, held).count() == 0


def test_word_base(docs):
    held = langid.remainder("doc_id", 5) == 1
    out = {False: True, True: False}
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for _, t, *_ in DOCS]
    held_out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in DOCS]
    known = collections.Counter(w for ws, h in zip(tokens, held_out, strict=True) if out[h] for w in ws)
    total, distinct = sum(known.values()), len(known)
    want = collections.Counter()
    for (i, *_), ws, h in zip(DOCS, tokens, held_out, strict=True):
        base = sum(math.log10((known[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        want[i, h, len(ws), sum(known[w] > 0 for w in ws), total, round(base, 5)] += 1
    got = collections.Counter(
        (r[0], r[1], r[2], r[3], r[4], round(r["base_score"], 5)) for r in ctw.scores(docs, held).collect()
    )
    assert got == want


def test_many_terms_in_a_long_segment(spark):
    """Term numbers times the positions of a segment pass 2^31; the last item's terms have the largest numbers."""
    last = " ".join(f"z{i}" for i in range(13))
    items = [(str(i), " ".join(f"w{i}x{j}" for j in range(1000))) for i in range(30)] + [("last", last)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, "filler " * 100_000 + last), (2, last)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in phrase.contamination(docs.coalesce(1), bench).collect()}
    assert got == {1: (100_013, 13, 1, False), 2: (13, 13, 1, True)}


def brute_proximity(words, query, slop):
    places = {w: [i for i, x in enumerate(words) if x == w] for w in query}
    return {
        s for s in range(len(words)) if all(any(abs(p - s - k) <= slop for p in places[w]) for k, w in enumerate(query))
    }


@pytest.mark.parametrize("slop", [0, 1, 2, 3])
def test_proximity_is_brute_force(spark, slop):
    """Every start at which all words lie near their places, also where the rarest one is displaced."""
    import random

    draw = random.Random(slop)
    texts = ["a x b c x d", *(" ".join(draw.choices("aabbcdxyz", k=draw.randrange(0, 15))) for _ in range(150))]
    queries = ["a b c d", *(" ".join(draw.choices("abcd", k=4)) for _ in range(12))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(q, q) for q in queries], "item_id string, text string").dropDuplicates()
    found = phrase.search(phrase.build_index(docs), items, window=4, slop=slop).collect()
    got = {(r["id"], s["item"], s["start"]) for r in found for s in r["spans"]}
    want = {(i, q, s) for i, t in enumerate(texts) for q in set(queries) for s in brute_proximity(t.split(), q.split(), slop)}
    assert got == want and want


def namesakes(spark):
    """One id with several texts, clean, contaminated and copied; names that the code uses itself."""
    bad = "one two three four five six seven eight nine ten eleven twelve thirteen"
    a, b = "all of this is clean and long enough to have some shingles", "another text that shares nothing with the first one at all"
    rows = [(5, a), (5, bad), (5, b), (5, b), (6, a), (7, bad + " fourteen"), (None, bad), (None, b), (None, "no id and alone here")]
    extra = ["_hit", "hit", "row", "key", "fp", "part", "head", "rows", "component_id", "contaminated"]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"'x' AS `{c}`" for c in extra))
    return df, a, b, bad


def test_verdicts_belong_to_rows_not_ids(spark):
    docs, a, b, bad = namesakes(spark)
    items = spark.createDataFrame([("q", bad)], "item_id string, text string")
    clean = phrase.clean_documents(docs, items)
    assert clean.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in clean.collect())
    assert got == sorted([(5, a), (5, b), (5, b), (6, a), (0, b), (0, "no id and alone here")])
    kept = simhash.kept_documents(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
    assert len(got) == len(set(got))
    # Each of the three texts of id 5 heads its own component, unless two of them are near copies.
    assert {(5, a), (5, b)} < set(got) and (0, "no id and alone here") in got and (6, a) not in got
    assert sum(text.startswith(bad) for _, text in got) == 1 + (not any(near_bits(spark, bad, bad + " fourteen")))


def near_bits(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    parts = [r["component_id"] for r in simhash.digests(df).collect()]
    return [x == parts[0] for x in parts[1:]]
