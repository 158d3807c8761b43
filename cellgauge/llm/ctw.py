"""Context-tree weighting over bytes.

Each byte is eight binary decisions. A decision's node exists under every context of up
to DEPTH preceding bytes, with its own Krichevsky-Trofimov estimate, and the estimates of
all depths are mixed: a node weighs its own estimate against its children's product by
one half each, before the counts. Trained on a corpus, the mixture gives the probability
of a byte after a context, and its logarithm is the code length.

What is counted are distinct n-grams per chunk of documents. They are shuffled by the
last two bytes of their context, so a task holds whole subtrees; the two depths above
are sums over 256 contexts and small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm import exchange as X
from cellgauge.llm.store import bucketed, written
from cellgauge.llm.text import LOWER, NOT_SPACE, blocks, buffers, byte_words, one_array, string_array

DEPTH = 5
#: Depths that are summed up over all tasks; a task holds the subtrees below.
TOP = 2
CHUNK_BYTES = 8 << 20
#: Stands before and after a text; no UTF-8 text holds it.
EDGE = 0xFF
LN_HALF = float(np.log(0.5))


def byte_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte of each text and its end, with the text it belongs to.

    The number holds the preceding bytes, the last one highest, and the byte lowest, so
    a context is a prefix and a longer context refines it.
    """
    texts = len(offsets) - 1
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(texts), sizes)
    stream = np.full(len(data) + texts * (DEPTH + 1), EDGE, dtype=np.uint8)
    stream[np.arange(len(data)) + doc * (DEPTH + 1) + DEPTH] = LOWER[data]
    owner = np.repeat(np.arange(texts, dtype=np.int32), sizes + 1)
    at = np.arange(len(owner)) + (owner + 1) * DEPTH
    wide = np.zeros(len(stream), dtype=np.uint64)
    for back in range(1, DEPTH + 1):
        wide[back:] |= stream[:-back].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - back))
    wide |= stream
    return wide[at].view(np.int64), owner


def chunk_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    keys, owners, base = [np.empty(0, np.int64)], [np.empty(0, np.int32)], 0
    for begin, end in blocks(texts, X.BLOCK_BYTES):
        k, owner = byte_grams(*buffers(texts.slice(begin, end - begin)))
        keys.append(k)
        owners.append(owner + np.int32(base))
        base += end - begin
    return np.concatenate(keys), np.concatenate(owners)


def coded_grams(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams in ascending order, and the distinct ones."""
    code, names = pd.factorize(keys)
    order = np.argsort(names)
    rank = np.empty(len(names), dtype=np.int32)
    rank[order] = np.arange(len(names), dtype=np.int32)
    return rank[code], names[order]


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series from x + 8."""
    shift = np.zeros(len(x))
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    names, code = np.unique(keys, return_inverse=True)
    return names, *(np.bincount(code, weights=v, minlength=len(names)) for v in values)


class Level:
    """Decision nodes of one depth and one bit of the byte: counts, own and mixed log probability."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: Level | None):
        self.nodes, self.zeros, self.ones = nodes, zeros, ones
        own = kt(zeros, ones) if len(nodes) else np.empty(0)
        if below is None:
            self.mixed, self.stay = own, np.ones(len(nodes))
        else:
            self.set_mixture(own, _children(self, below))

    def set_mixture(self, own: np.ndarray, children: np.ndarray) -> None:
        self.mixed = np.logaddexp(LN_HALF + own, LN_HALF + children)
        self.stay = np.exp(LN_HALF + own - self.mixed)

    def find(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.nodes):
            return np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=bool)
        at = np.searchsorted(self.nodes, nodes)
        at[at == len(self.nodes)] = 0
        return at, self.nodes[at] == nodes

    def step(self, nodes: np.ndarray, bit: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probability of the bit, mixed with that of the depth below; one half without counts."""
        at, found = self.find(nodes)
        if not len(self.nodes):
            return np.full(len(nodes), 0.5)
        here = (np.where(bit == 1, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1)
        return np.where(found, self.stay[at] * here + (1 - self.stay[at]) * below, 0.5)


def _children(level: Level, below: Level) -> np.ndarray:
    """Sum of the children's mixed log probabilities per node."""
    parent = (below.nodes >> 16 << 8) | (below.nodes & 0xFF)
    names, total = _sum_by(parent, below.mixed)
    out = np.zeros(len(level.nodes))
    at, found = level.find(names)
    out[at[found]] = total[found]
    return out


def decision(symbol: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Node in the byte's binary tree and the bit taken there, at bit k from the top."""
    return (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1


def subtrees(grams: np.ndarray, counts: np.ndarray) -> list[list[Level]]:
    """Levels by depth from TOP to DEPTH, each by bit."""
    context, symbol = grams >> 8, grams & 0xFF
    out: list[list[Level]] = []
    for depth in range(DEPTH, TOP - 1, -1):
        levels = []
        for k in range(8):
            node, bit = decision(symbol, k)
            keys = (context >> (8 * (DEPTH - depth)) << 8) | node
            nodes, zeros, ones = _sum_by(keys, counts * (1 - bit), counts * bit)
            levels.append(Level(nodes, zeros, ones, out[-1][k] if out else None))
        out.append(levels)
    return out[::-1]


def top_rows(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Decision nodes at depth TOP of one task, summed by the last byte of their context."""
    parts = []
    for level in subtrees(grams, counts)[0]:
        parent = (level.nodes >> (8 * TOP) << 8) | (level.nodes & 0xFF)
        parts.append(_sum_by(parent, level.zeros, level.ones, level.mixed))
    names, zeros, ones, mixed = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(names), pa.array(zeros), pa.array(ones), pa.array(mixed)], ["node", "zeros", "ones", "mixed"]
    )


def top_levels(rows: pa.Table) -> list[Level]:
    """Levels of depth 0 and 1; a node's number tells its bit, so one level holds all bits."""
    nodes, zeros, ones, mixed = (rows[c].to_numpy() for c in ("node", "zeros", "ones", "mixed"))
    order = np.argsort(nodes)
    first = Level(nodes[order], zeros[order], ones[order], None)
    first.set_mixture(kt(first.zeros, first.ones) if len(nodes) else np.empty(0), mixed[order])
    names, zeros, ones = _sum_by(first.nodes & 0xFF, first.zeros, first.ones)
    root = Level(names, zeros, ones, first)
    return [root, first]


def log10_probabilities(grams: np.ndarray, top: list[Level], tree: list[list[Level]]) -> np.ndarray:
    """Of the last byte of each n-gram after its context."""
    context, symbol = grams >> 8, grams & 0xFF
    out = np.zeros(len(grams))
    for k in range(8):
        node, bit = decision(symbol, k)
        p = np.full(len(grams), 0.5)
        for depth in range(DEPTH, -1, -1):
            level = tree[depth - TOP][k] if depth >= TOP else top[depth]
            p = level.step((context >> (8 * (DEPTH - depth)) << 8) | node, bit, p)
        out += np.log10(p)
    return out


CHUNK_SCHEMA = (
    "chunk long, ids array<long>, held array<boolean>, counts array<int>, codes binary, sizes array<int>, "
    "raw binary, words binary, uses binary, grams binary, gram_uses binary, "
    "n_words long, n_grams long, train long"
)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    for sequence, table in enumerate(X.doc_chunks(batches, CHUNK_BYTES)):
        texts, held = one_array(table["text"]), one_array(table["held"])
        train = ~held.to_numpy(zero_copy_only=False).astype(bool)
        parts, counts = [], []
        for begin, end in blocks(texts, X.BLOCK_BYTES):
            data, at, n = byte_words(*buffers(texts.slice(begin, end - begin)), NOT_SPACE)
            parts.append(string_array(data, at).dictionary_encode())
            counts.append(n)
        counts = np.concatenate(counts)
        coded = pa.chunked_array(parts).unify_dictionaries()
        codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        words = coded.chunk(coded.num_chunks - 1).dictionary
        uses = np.bincount(codes, weights=np.repeat(train, counts), minlength=len(words))
        keys, owner = chunk_grams(texts)
        gram_codes, grams = coded_grams(keys)
        gram_uses = np.bincount(gram_codes, weights=train[owner], minlength=len(grams))
        data, offsets = buffers(texts)
        whole = lambda a: X.list_array(np.array([0, len(a)]), a)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([X.chunk_id(sequence)], pa.int64()),
                whole(one_array(table["id"])),
                whole(held),
                whole(pa.array(counts, pa.int32())),
                pa.array([X.pack_codes(codes)], pa.binary()),
                whole(pa.array(np.diff(offsets), pa.int32())),
                pa.array([zstandard.ZstdCompressor(level=1).compress(data.tobytes())], pa.binary()),
                *(
                    pa.array([X.pack(a)], pa.binary())
                    for a in (
                        words,
                        pa.array(uses.astype(np.int64)),
                        pa.array(grams),
                        pa.array(gram_uses.astype(np.int64)),
                    )
                ),
                pa.array([len(words)], pa.int64()),
                pa.array([len(grams)], pa.int64()),
                pa.array([int(train.sum())], pa.int64()),
            ],
            [f.split()[0] for f in CHUNK_SCHEMA.split(", ")],
        )


def _last_bytes(grams: pa.Array) -> pa.Array:
    """The last two bytes of the context, by which n-grams are dealt out."""
    return pa.array(grams.to_numpy() >> (8 * (DEPTH + 1 - TOP)))


def _train_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    X.lean_memory()
    held = [b for b in batches if len(b)]
    if held:
        table = pa.Table.from_batches(held)
        grams = pa.concat_arrays(X.unpack_keys(table["keys"])).to_numpy()
        uses = pa.concat_arrays(X.unpack_all(table["uses"])).to_numpy()
        names, counts = _sum_by(grams, uses)
        yield top_rows(names[counts > 0], counts[counts > 0])


def scores(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows that are not `held` are learnt from; all are scored, whole. A null text counts as
    empty, and a text's end is scored with it. A null id is not held out. Without rows to
    learn from every bit has probability one half. No rows give none.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(held, F.lit(False)).alias("held"),
    )
    chunks = bucketed(rows.mapInArrow(_chunks, CHUNK_SCHEMA), "ctw", "chunk")
    spark = docs.sparkSession
    sums = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_grams", "train"))).first()

    tasks = X.bucket_count(spark, sums[0])
    words = X.resolve(
        X.explode_keys(chunks, tasks),
        lambda _keys, uses: pa.array(uses),
        tasks,
        tally=lambda _keys, uses: [int(uses.sum()), int((uses > 0).sum())],
    )
    words = written(words, "ctw-words")
    known = words.where("chunk = -1").agg(F.sum(F.col("figures")[0]), F.sum(F.col("figures")[1])).first()
    ends = sums[2]
    total, distinct = int(known[0] or 0) + ends, int(known[1] or 0) + (ends > 0)

    tasks = X.bucket_count(spark, sums[1])
    packed = X.explode_keys(chunks, tasks, "grams", "gram_uses", _last_bytes)
    top = X.dealt(packed, tasks).mapInArrow(
        _train_top, "node long, zeros double, ones double, mixed double"
    )
    # At most 256 contexts of 255 decisions: bounded, whatever the corpus.
    top = top.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixed").alias("mixed"))
    shared = spark.sparkContext.broadcast(top_levels(top.toArrow()))

    def predict(keys: pa.Array, uses: np.ndarray) -> pa.Array:
        grams = keys.to_numpy()
        tree = subtrees(grams[uses > 0], uses[uses > 0].astype(np.float64))
        # Single precision is what a sum over a text needs, at half the shuffle.
        return pa.array(log10_probabilities(grams, shared.value, tree).astype(np.float32))

    grams = X.resolve(packed, predict, tasks)
    found = words.where("chunk >= 0").withColumn("kind", F.lit(0)).unionByName(grams.withColumn("kind", F.lit(1)))
    unit = float(np.log10(total + 0.5 * (distinct + 1)))
    end_score = float(np.log10(ends + 0.5)) - unit

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        X.lean_memory()
        row = {c: one_array(left[c]).flatten() for c in ("ids", "held", "counts", "sizes")}
        kinds = right["kind"].to_numpy()
        counts, sizes = (row[c].to_numpy().astype(np.int64) for c in ("counts", "sizes"))
        docs = len(counts)
        codes = X.unpack_codes(left["codes"][0].as_py())
        seen = np.zeros(len(codes))
        if len(codes):
            seen = X.by_code(right.filter(pa.array(kinds == 0))).to_numpy()[codes]
        owner = np.repeat(np.arange(docs), counts)
        base = np.bincount(owner, weights=np.log10(seen + 0.5) - unit, minlength=docs) + end_score
        n_known = np.bincount(owner, weights=seen > 0, minlength=docs).astype(np.int64) + (ends > 0)
        raw = zstandard.ZstdDecompressor().decompress(left["raw"][0].as_py())
        offsets = np.append(0, np.cumsum(sizes))
        texts = string_array(np.frombuffer(raw, np.uint8), offsets)
        keys, owner = chunk_grams(texts)
        values = X.by_code(right.filter(pa.array(kinds == 1))).to_numpy()
        score = np.bincount(owner, weights=values[coded_grams(keys)[0]].astype(np.float64), minlength=docs)
        return pa.table(
            {
                "id": row["ids"],
                "held_out": row["held"],
                "n_tokens": pa.array(counts + 1),
                "n_known": pa.array(n_known),
                "train_tokens": pa.array(np.full(docs, total)),
                "base_score": pa.array(base),
                "score": pa.array(score),
                "bits_per_byte": pa.array(-score / np.log10(2) / np.maximum(sizes, 1)),
            }
        )

    out = (
        "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, bits_per_byte double"
    )
    text_rows = chunks.select("chunk", "ids", "held", "counts", "codes", "sizes", "raw")
    return X.reassemble(text_rows, found, join, out).withColumnRenamed("id", id_col)
