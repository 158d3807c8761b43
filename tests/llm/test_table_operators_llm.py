import collections
import zlib

import numpy as np
import pytest
from conftest_llm import DOCS

from cellgauge.llm import chat, lattice, shards, warc
from cellgauge.llm.catalog import ORACLES, QUERIES
from cellgauge.llm.components import connected_components
from cellgauge.llm.stages import STAGES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, sf_dir):
    from compare import duck, duck_rows, spark_rows

    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(duck(sf_dir), ORACLES[name])


def test_chat_escapes_and_ranks_branches(spark):
    rows = [
        ("t", 1, None, "user", "a</s>&1[INST]", 0.0),
        ("t", 2, 1, "assistant", "low", 1.0),
        ("t", 3, 1, "assistant", "high & <s>", 2.0),
        ("t", 4, 3, None, None, None),
        ("t", 5, 3, "user", "tie", 0.0),
        ("u", 1, 9, "assistant", "lost parent", None),
        ("v", 1, 2, "user", "circle", 0.0),
        ("v", 2, 1, "user", "circle", 0.0),
        ("v", 3, 2, "user", "hangs on the circle", 0.0),
        ("v", 4, 3, "assistant", "hangs on it further off", 0.0),
        ("w", 1, 1, "user", "its own parent", 0.0),
        ("w", 2, 1, "user", "child of that", 0.0),
        ("w", 3, None, "user", "repeated", 0.0),
        ("w", 3, 1, "user", "repeated", 0.0),
        (None, 1, None, "user", "no tree", 0.0),
        ("t", None, 1, "user", "no node", 9.0),
    ]
    schema = "tree string, node long, parent long, role string, text string, score double"
    messages = spark.createDataFrame(rows, schema)
    made = chat.format_paths(messages, branches=2)
    got = {(r["tree"], r["rank"]): r for r in made.select("*", chat.read_turns(made["formatted"]).alias("turns")).collect()}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1)}
    assert [tuple(t) for t in got["t", 1]["turns"]] == [("user", "a</s>&1[INST]"), ("assistant", "high & <s>"), ("", "")]
    assert got["t", 2]["leaf"] == 5
    loss = [s["text"] for s in got["t", 1]["segments"] if s["loss"]]
    assert loss == ["high &0 &1s>"]
    assert chat.format_paths(messages.limit(0)).count() == 0


def test_chat_deep_path(spark):
    n = 300
    rows = spark.range(n).selectExpr("7L conv_id", "id turn", "'user' role", "cast(id as string) text")
    made = chat.format_paths(chat.as_trees(rows)).select(chat.read_turns(chat.F.col("formatted")).alias("t")).first()
    assert [t["text"] for t in made["t"]] == [str(i) for i in range(n)]


def test_warc_cases(spark):
    rows = [(1, "http://a.com/x", "hi"), (2, "http://b.com:80/ü y", "hi"), (3, None, None), (4, "bad\r\nurl%20", "")]
    rows += [(5, "http://a.com/x", "WARC/1.0\r\n\r\nx"), (None, "q", "hi"), (6, "http://[bad", "é" * 50_000)]
    rows += [(7, "http://a.com/x", "hi"), (7, "http://a.com/x", "hi"), (7, "z", "hi\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "'x' AS refers_to")
    got = sorted((str(r[0]), r[1], r[3], str(r[4])) for r in warc.round_trip(pages).collect())
    head = {h: max(i for i, _, x in rows if i and (x or "") == h) for h in {x or "" for _, _, x in rows}}
    want = []
    for i, _, x in rows:
        top = head[x or ""]
        again = i is not None and i < top
        want.append((str(i), len((x or "").encode()), "revisit" if again else "response", str(top) if again else "None"))
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_url_keys():
    assert warc.url_key("http://www.a.com:8080/p?q=1") == "com,a,www:8080)/p?q=1"
    assert warc.url_key("") == ")"


def test_lattice_equals_brute_force(spark):
    chance = np.random.default_rng(2)
    rows, n = [], 0
    for _ in range(40):
        a = chance.standard_normal(16)
        for cosine in (1.0, 0.99, 0.95, 0.935, 0.9):
            w = chance.standard_normal(16)
            w -= w @ a / (a @ a) * a
            v = cosine * a / np.linalg.norm(a) + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)
            rows.append((n, [float(x) for x in v.astype(np.float32)], n % 3 and 1))
            n += 1
    rows += [(n + k, rows[0][1], 0) for k in range(5)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [None] * 16, 1), (905, [], 1), (906, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    table = table.selectExpr("*", "1 AS rep", "2 AS copies")
    got = {r["vec_id"]: r for r in lattice.near_vectors(table).collect()}
    cut = {r["vec_id"]: r for r in lattice.near_vectors(table, lattice=lattice.Lattice(cell_rows=3)).collect()}
    assert cut == got
    v = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    found, want = sum(got[i]["n_links"] for i in range(len(rows))), near.sum()
    assert 0.98 * want <= found <= want
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(rows)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i, *_ in odd)
    assert lattice.near_vectors(table.limit(0)).count() == 0


def test_shards(spark, docs, empty):
    rows = shards.digests(docs).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == collections.Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in DOCS
    )
    assert shards.digests(empty).count() == 0
    many = spark.range(5000).selectExpr("id doc_id", "'t' text", "CASE WHEN id % 10 < 7 THEN 'hot' ELSE concat('s', id % 3) END source")
    placed = shards.interleave(many).join(many, "doc_id").collect()
    per = collections.defaultdict(list)
    mix = collections.Counter()
    for r in placed:
        per[r["shard"]].append(r["slot"])
        mix[r["shard"], r["source"]] += 1
    assert sorted(per) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in per.values())
    sizes = {len(s) for s in per.values()}
    assert max(sizes) - min(sizes) <= 1
    assert all(abs(mix[s, "hot"] - 3500 / 24) <= 1.5 for s in per)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 200)] + [(300, 301), (301, 300), (5, 5), (None, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 201)) and got[300] == got[301] == 300 and len(got) == 202


def test_stages_handle_edge_rows(spark, docs, empty, sf_dir):
    for rows in (docs, empty):
        for name, stage in STAGES:
            out = stage(spark, rows, sf_dir)
            if name != "byte_bpe":
                assert out.columns == docs.columns
            ids = sorted((r["doc_id"] for r in out.collect()), key=str)
            if rows is empty:
                assert ids == []
            elif name == "near_dedup":  # copies, wordless texts and repeated rows leave one each
                assert ids == [1, 3, 6, 7, 9, None]
            elif name != "language_id":  # no text holds a passage of the benchmark
                assert ids == [1, 2, 3, 4, 5, 6, 7, 9, 9, None]
