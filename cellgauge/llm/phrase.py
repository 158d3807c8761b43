"""Benchmark decontamination by a distributed positional inverted index.

Training texts are cut into segments. A segment stores, for each of its terms in sorted
order, the ascending positions of its tokens; documents lie apart, so no phrase reaches
from one into the next. A phrase is searched by its rarest term in the segment: that
list, moved by the term's offset, gives the candidate starts, and the lists of the other
terms are intersected with them from the rarest on. Proximity search widens the check to
a distance. The benchmark is the stated query set: it is cut into blocks of a fixed size,
and each block meets each segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm import exchange as X
from cellgauge.llm.store import free_name, written
from cellgauge.llm.text import WORD, blocks, buffers, byte_words, one_array, string_array

#: Positions left free between two documents; no proximity search may reach further.
GAP = 64
SEGMENT_BYTES = 8 << 20
#: Texts of the query set that a task holds at once.
QUERY_BYTES = 1 << 20

INDEX_SCHEMA = (
    "segment long, ids array<long>, begins array<long>, n_words array<int>, "
    "terms array<string>, postings array<int>, positions binary"
)


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """Write the index of all rows and return it: one row per segment.

    Null texts have no words. Rows are told apart within a segment, so repeated and null
    ids are rows of their own. No rows give an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sequence, table in enumerate(X.doc_chunks(batches, SEGMENT_BYTES)):
            texts = one_array(table["text"])
            parts, counts = [], []
            for begin, end in blocks(texts, X.BLOCK_BYTES):
                data, at, n = byte_words(*buffers(texts.slice(begin, end - begin)), WORD)
                parts.append(string_array(data, at).dictionary_encode())
                counts.append(n)
            counts = np.concatenate(counts)
            coded = pa.chunked_array(parts).unify_dictionaries()
            codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
            words = coded.chunk(coded.num_chunks - 1).dictionary
            begins = np.cumsum(counts + GAP) - counts - GAP
            place = np.arange(len(codes)) + np.repeat(GAP * np.arange(len(counts)), counts)
            rank = np.empty(len(words), dtype=np.int64)
            order = pc.sort_indices(words)
            rank[order.to_numpy()] = np.arange(len(words))
            term = rank[codes]
            by_term = np.argsort(term, kind="stable")
            postings = np.bincount(term, minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([X.chunk_id(sequence)], pa.int64()),
                    X.list_array(np.array([0, len(table)]), one_array(table["id"])),
                    X.list_array(np.array([0, len(table)]), pa.array(begins, pa.int64())),
                    X.list_array(np.array([0, len(table)]), pa.array(counts, pa.int32())),
                    X.list_array(np.array([0, len(words)]), words.take(order)),
                    X.list_array(np.array([0, len(words)]), pa.array(postings, pa.int32())),
                    pa.array([X.pack_codes(place[by_term])], pa.binary()),
                ],
                ["segment", "ids", "begins", "n_words", "terms", "postings", "positions"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, INDEX_SCHEMA), "postings", path)


class Segment:
    """Postings of one segment as flat arrays; a list is the slice of a term."""

    def __init__(self, row: dict[str, pa.Array], needed: pa.Array):
        terms = row["terms"]
        self.ids, self.begins, self.n_words = (row[c] for c in ("ids", "begins", "n_words"))
        sizes = row["postings"].to_numpy().astype(np.int64)
        positions = X.unpack_codes(row["positions"]).astype(np.int64)
        # Only the lists of terms that the queries hold are looked at from here on.
        # Their numbers are 64 bits wide: times the stride they pass 2^31 early.
        wanted = pc.fill_null(pc.index_in(terms, value_set=needed), -1).to_numpy().astype(np.int64)
        used = wanted >= 0
        lists = np.repeat(used, sizes)
        code = np.repeat(wanted[used], sizes[used])
        self.stride = int(positions.max(initial=0)) + 2 * GAP + 1
        keys = code * self.stride + positions[lists]
        keys.sort()
        self.keys = keys  # (term, position) in ascending order
        self.sizes = np.zeros(len(needed), dtype=np.int64)
        self.sizes[wanted[used]] = sizes[used]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all these terms, and which entry of `term` each is for."""
        size = self.sizes[term]
        which = np.repeat(np.arange(len(term)), size)
        at = np.repeat(self.starts[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.keys[at] - term[which] * self.stride, which

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Is the position in the term's list?"""
        key = term * self.stride + position
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        ok = (position >= 0) & (position < self.stride)
        return ok & (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), dtype=bool)

    def near(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Is some position between low and high in the term's list?"""
        base = term * self.stride
        low = np.clip(low, 0, self.stride - 1)
        high = np.clip(high, 0, self.stride - 1)
        a = np.searchsorted(self.keys, base + low)
        return np.searchsorted(self.keys, base + high, side="right") > a

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact occurrences of equally long windows of terms: (window, start)."""
        size = self.sizes[windows]
        alive = np.flatnonzero((size > 0).all(axis=1))
        order = np.argsort(size[alive], axis=1, kind="stable")
        return self._intersect(windows, alive, order, lambda t, p: self.has(t, p))

    def _intersect(self, windows, alive, order, test):
        if not len(alive):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rarest = order[:, 0]
        position, which = self.postings(windows[alive, rarest])
        start, window = position - rarest[which], which
        for k in range(1, windows.shape[1]):
            offset = order[window, k]
            ok = test(windows[alive[window], offset], start + offset)
            start, window = start[ok], window[ok]
        return alive[window], start

    def proximity(self, windows: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts inside a document at which every term lies within `slop` of its place in the window.

        The rarest term may be displaced as well: each of its positions stands for all starts
        that leave it within `slop`.
        """
        size = self.sizes[windows]
        alive = np.flatnonzero((size > 0).all(axis=1))
        if not len(alive):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rarest = size[alive].argmin(axis=1)
        position, which = self.postings(windows[alive, rarest])
        start = (position - rarest[which])[:, None] + np.arange(-slop, slop + 1)
        doc = self.document(position)[:, None]
        inside = (start >= self.begins[doc]) & (start < self.begins[doc] + self.n_words.to_numpy()[doc])
        key = np.unique((np.broadcast_to(which[:, None], start.shape) * self.stride + start)[inside])
        window, start = key // self.stride, key % self.stride
        for k in range(windows.shape[1]):
            place = start + k
            ok = self.near(windows[alive[window], k], place - slop, place + slop)
            start, window = start[ok], window[ok]
        return alive[window], start

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, position, side="right") - 1


class Queries:
    """Windows of a block of query texts over the block's own term numbers."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window: int):
        data, at, counts = byte_words(*buffers(texts), WORD)
        coded = string_array(data, at).dictionary_encode()
        codes, self.terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.ids = ids
        first = np.cumsum(counts) - counts
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, (begin, n) in enumerate(zip(first, counts, strict=True)):
            if n:
                size = min(window, int(n))
                held = np.lib.stride_tricks.sliding_window_view(codes[begin : begin + n], size)
                by_length.setdefault(size, []).append((item, held))
        # Equal windows of one item are searched once.
        self.groups = []
        for size, parts in sorted(by_length.items()):
            owner = np.concatenate([np.full(len(w), i) for i, w in parts])
            rows = np.unique(np.column_stack([owner, np.concatenate([w for _, w in parts])]), axis=0)
            self.groups.append((size, rows[:, 0], np.ascontiguousarray(rows[:, 1:])))


def query_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The stated query set in blocks of bounded size, read one after the other."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    batches = (
        pa.RecordBatch.from_pydict(
            {"id": pa.array([r.id], pa.string()), "text": pa.array([r.text], pa.string())}
        )
        for r in rows.where("text is not null").toLocalIterator()
    )
    for table in X.doc_chunks(batches, QUERY_BYTES):
        yield one_array(table["id"]), one_array(table["text"])


def search(
    index: DataFrame,
    items: DataFrame,
    window: int = 13,
    slop: int | None = None,
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """Per indexed row: id, n_words, `spans` (item, start, words) of all matches.

    An item gives its windows of `window` words, or its whole text if that is shorter.
    `slop` allows every word to lie so far from its place; None means exact phrases. All
    rows of the index come back, those without a match with no spans. Null and wordless
    items match nothing.
    """
    if slop is not None and 2 * slop + window > GAP:
        raise ValueError(f"slop and window reach over {GAP} words")
    schema = (
        "segment long, row int, id long, n_words int, "
        "spans array<struct<item:string,start:int,words:int>>"
    )
    sc = index.sparkSession.sparkContext
    out = None
    for ids, texts in query_blocks(items, item_col, text_col):
        shared = sc.broadcast(Queries(ids, texts, window))
        part = index.mapInArrow(_searcher(shared, slop), schema)
        out = part if out is None else out.union(part)
    if out is None:
        empty = Queries(pa.array([], pa.string()), pa.array([], pa.string()), window)
        return index.mapInArrow(_searcher(sc.broadcast(empty), slop), schema)
    return out


def _searcher(shared, slop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            for i in range(len(batch)):
                row = {
                    c: batch[c].slice(i, 1).flatten()
                    for c in ("ids", "begins", "n_words", "terms", "postings")
                }
                row["positions"] = batch["positions"][i].as_py()
                row["begins"] = row["begins"].to_numpy()
                yield _matches(batch["segment"][i].as_py(), Segment(row, q.terms), q, slop)

    return run


def _matches(number: int, segment: Segment, q: Queries, slop: int | None) -> pa.RecordBatch:
    item, start, words = [], [], []
    for size, owner, windows in q.groups:
        found, at = segment.phrases(windows) if slop is None else segment.proximity(windows, slop)
        item.append(owner[found])
        start.append(at)
        words.append(np.full(len(at), size))
    item, start, words = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (item, start, words))
    doc = segment.document(np.maximum(start, 0))
    order = np.lexsort((item, start, doc))
    n = len(segment.ids)
    ends = np.cumsum(np.bincount(doc, minlength=n))
    spans = pa.StructArray.from_arrays(
        [
            q.ids.take(pa.array(item[order])) if len(q.ids) else pa.array([], pa.string()),
            pa.array(start[order] - segment.begins[doc[order]], pa.int32()),
            pa.array(words[order], pa.int32()),
        ],
        ["item", "start", "words"],
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, number), pa.int64()),
            pa.array(np.arange(n), pa.int32()),
            segment.ids,
            segment.n_words,
            X.list_array(np.append(0, ends), spans),
        ],
        ["segment", "row", "id", "n_words", "spans"],
    )


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words hit by a row's spans, and the items that they come from."""
    for batch in batches:
        spans = one_array(batch["spans"]).flatten()
        sizes = pc.fill_null(pc.list_value_length(batch["spans"]), 0).to_numpy()
        row = np.repeat(np.arange(len(batch)), sizes)
        start, words = (spans.field(c).to_numpy().astype(np.int64) for c in (1, 2))
        key = np.concatenate([np.empty(0, np.int64), *_covered(row, start, words)])
        hit = np.bincount(np.unique(key) >> 32, minlength=len(batch))
        items = spans.field(0).to_pylist()
        named: list[set[str]] = [set() for _ in range(len(batch))]
        for r, x in zip(row.tolist(), items, strict=True):
            if x is not None:
                named[r].add(x)
        digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in named]
        yield pa.RecordBatch.from_arrays(
            [
                batch["id"],
                batch["n_words"].cast(pa.int64()),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in named], pa.int64()),
                pa.array(digest),
            ],
            ["id", "n_words", "n_hit", "n_items", "items_sha256"],
        )


def _covered(row: np.ndarray, start: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
    """(row, position) of every word in a span, as one number, a span length at a time."""
    for size in np.unique(words):
        one = words == size
        yield ((row[one] << 32) + start[one])[:, None].repeat(size, 1).ravel() + np.tile(
            np.arange(size), int(one.sum())
        )


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id"
) -> DataFrame:
    """Per document: words, words hit by a benchmark window, items, their digest, verdict.

    A document is contaminated if a twentieth of its words or more are hit. Every row has
    a result; null and wordless texts have no words and are clean.
    """
    found = search(build_index(docs, id_col), items, window)
    # More than one block of queries gives a row per block: their spans meet here.
    whole = found.groupBy("segment", "row").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
    )
    schema = "id long, n_words long, n_hit long, n_items long, items_sha256 string"
    out = whole.select("id", "n_words", "spans").mapInArrow(_verdicts, schema)
    out = out.withColumnRenamed("id", id_col)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """Rows of `docs` that are not contaminated, with their own columns.

    A row is told by its id and the hash of its text, so each is judged by what it holds:
    rows that share an id, or have none, do not share a verdict. Null and empty texts are
    clean; repeated rows stay or go together; extra columns are kept whatever their names.
    """
    row, hit = free_name(docs, "row"), free_name(docs, "hit")
    key = F.xxhash64("doc_id", "text")
    judged = contamination(docs.select(key.alias(row), "text"), items, window, row)
    bad = written(judged.where("contaminated").select(F.col(row).alias(hit)).distinct(), "contaminated")
    return docs.join(bad, key == F.col(hit), "left_anti").select(*docs.columns)
