"""SimHash for lower similarities: wide fingerprints, indexed with their least certain bits blanked out.

At a similarity of 0.8 about 15 % of the bits of two texts differ, too many for one
64-bit fingerprint to tell from chance. Several independent ones are held end to end, cut
into segments, and every segment is indexed as it is and with one of its bits blanked
out. Bits that differ between near texts are those whose vote was close in both, so only
a segment's closest votes are blanked out. Equal variants meet in a shuffle and the
distance over all bits is verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.exchange import BLOCK_BYTES
from cellgauge.llm.text import NOT_SPACE, blocks, buffers, one_array, spaced_words

#: Shingles whose bits are unpacked at once.
SLICE = 1 << 16
#: Distinct fingerprints whose variants are made at once.
ROWS = 2048
#: Runs of equal variants up to this length are compared by shifting whole columns.
SHORT_RUN = 32


def shingle_sets(column: pa.Array, shingle: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text, in ascending order of rows."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    raw, starts, ends, counts = spaced_words(*buffers(column), keep)
    docs = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(starts)) - (np.cumsum(counts) - counts)[docs]
    size = np.minimum(counts, shingle)[docs]
    opens = np.flatnonzero(place + size <= counts[docs])
    docs, hashes = docs[opens], np.empty(len(opens), np.uint64)
    last = ends[opens + size[opens] - 1]
    for i in range(0, len(opens), SLICE):
        lo, hi = starts[opens[i : i + SLICE]].tolist(), last[i : i + SLICE].tolist()
        hashes[i : i + SLICE] = [digest(raw[a:b], 42) for a, b in zip(lo, hi, strict=True)]
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    fresh = np.ones(len(docs), dtype=bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[fresh], hashes[fresh]


def remixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes of the independent fingerprint `word`, by a bijective mixing of 64 bits."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * (word + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def votes(docs: np.ndarray, hashes: np.ndarray, rows: int, words: int) -> np.ndarray:
    """Per row and bit, the shingles that set the bit less those that do not."""
    total = np.zeros((rows, words, 64), dtype=np.int32)
    for i in range(0, len(docs), SLICE):
        part = docs[i : i + SLICE]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for w in range(words):
            raw = remixed(hashes[i : i + SLICE], w).astype("<u8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            total[part[first], w] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    number = np.bincount(docs, minlength=rows).astype(np.int32)
    return (2 * total - number[:, None, None]).reshape(rows, words * 64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _run_links(fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one long run, without all its pairs."""
    left = fps[np.lexsort(fps.T)]
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = distance(left, node) <= most
            found, left = left[near], left[~near]
            if len(found):
                yield np.broadcast_to(node, found.shape), found
                queue.extend(found)


def run_links(key: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys between fingerprints of at most `most` differing bits."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    run = np.repeat(np.arange(len(begin)), size)
    short = np.repeat(size <= SHORT_RUN, size)
    pairs = []
    for d in range(1, int(min(size.max(initial=0), SHORT_RUN))):
        i = np.flatnonzero((run[:-d] == run[d:]) & short[:-d])
        i = i[distance(fps[i], fps[i + d]) <= most]
        pairs.append((fps[i], fps[i + d]))
    for k in np.flatnonzero(size > SHORT_RUN):
        pairs.extend(_run_links(fps[begin[k] : begin[k] + size[k]], most))
    none = np.empty((0, fps.shape[1]), np.uint64)
    a, b = (np.concatenate([none, *(p[side] for p in pairs)]) for side in (0, 1))
    differ = (a != b).any(axis=1)
    both = np.unique(np.hstack((a, b))[differ], axis=0)
    return both[:, : fps.shape[1]], both[:, fps.shape[1] :]


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.dtype.itemsize * rows.shape[1]
    data = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), data])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column whose values all have `width` bytes."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, width)


@dataclass(frozen=True)
class Similar:
    """Texts whose sets of shingles have an estimated Jaccard similarity of `similarity` or more.

    The estimate is the share of differing bits among `64 * words`; the limit lies `slack`
    standard deviations beyond the share expected at the similarity, so that pairs at the
    similarity are rarely missed for their estimate. `cuts` segments a word and `probes`
    blanked bits a segment set which pairs meet: with the defaults about 0.74 of the pairs of
    similarity 0.8, 0.92 of 0.85 and 0.98 of 0.9 do so directly.
    """

    shingle: int = 5
    similarity: float = 0.8
    words: int = 4
    cuts: int = 3
    probes: int = 8
    slack: float = 1.3

    @property
    def most(self) -> int:
        """Differing bits of a link at most."""
        share = math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi
        bits = 64 * self.words
        return int(bits * share + self.slack * math.sqrt(bits * share * (1 - share)))

    def segments(self) -> list[tuple[int, int]]:
        """(first bit, bits) over all words."""
        ends = [64 * i // self.cuts for i in range(self.cuts + 1)]
        return [(64 * w + a, b - a) for w in range(self.words) for a, b in zip(ends, ends[1:], strict=False)]

    def marks(self, column: pa.Array) -> pa.Array:
        """Per text the fingerprint, then per segment the places of its closest votes."""
        out = [pa.array([], pa.binary())]
        for begin, end in blocks(column, BLOCK_BYTES):
            part = column.slice(begin, end - begin)
            vote = votes(*shingle_sets(part, self.shingle, NOT_SPACE), len(part), self.words)
            fp = np.packbits(vote > 0, axis=1, bitorder="little")
            near = np.abs(vote)
            close = [np.argsort(near[:, a : a + n], axis=1, kind="stable")[:, : self.probes] for a, n in self.segments()]
            out.append(_binary(np.hstack((fp, *(c.astype(np.uint8) for c in close)))))
        return pa.concat_arrays(out)

    def mark(self, docs: DataFrame, text_col: str, name: str) -> DataFrame:
        """Add the column `name` of marks; texts without words have fingerprint zero."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp = self.marks(one_array(batch[text_col]))
                yield pa.RecordBatch.from_arrays([*batch.columns, fp], [*batch.schema.names, name])

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
        return docs.mapInArrow(run, ", ".join([*fields, f"`{name}` binary"]))

    def node(self, mark: Column) -> Column:
        """The fingerprint within a mark."""
        return F.substring(mark, 1, 8 * self.words)

    def variants(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, fingerprint) of every segment as it is and with each of its probes blanked out."""
        bytes_ = 8 * self.words
        fps = np.ascontiguousarray(marks[:, :bytes_]).view("<u8").astype(np.uint64)
        places = marks[:, bytes_:].reshape(len(marks), -1, self.probes).astype(np.int64)
        keys = []
        for s, (first, bits) in enumerate(self.segments()):
            part = (fps[:, first // 64] >> np.uint64(first % 64)) & np.uint64((1 << bits) - 1)
            part = part.astype(np.int64)[:, None]
            at = places[:, s]
            keys.append((s << 48 | 63 << 40) | part)
            keys.append(s << 48 | at << 40 | part & ~(1 << at))
        key = np.hstack(keys)
        return key.ravel(), np.repeat(fps, key.shape[1], axis=0)

    def links(self, distinct: DataFrame) -> DataFrame:
        """Links (a, b) between fingerprints of distinct marks `fp`, within the limit.

        Every pair that shares a variant and differs in `most` bits or fewer is linked, or
        connected by others of its run.
        """
        words, bytes_ = self.words, 8 * self.words
        width = bytes_ + self.probes * self.cuts * words

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks = _matrix(batch["fp"], width)
                for i in range(0, len(marks), ROWS):
                    key, fps = self.variants(marks[i : i + ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(key), _binary(fps)], ["key", "fp"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held_key, held = np.empty(0, np.int64), np.empty((0, words), np.uint64)

            def flush(key, fps):
                a, b = run_links(key, fps, self.most)
                return pa.RecordBatch.from_arrays([_binary(a), _binary(b)], ["a", "b"])

            for batch in batches:
                fps = _matrix(batch["fp"], bytes_).view("<u8").astype(np.uint64)
                held_key = np.concatenate((held_key, batch["key"].to_numpy()))
                held = np.concatenate((held, fps))
                cut = int(np.searchsorted(held_key, held_key[-1])) if len(held_key) else 0
                if cut:
                    yield flush(held_key[:cut], held[:cut])
                    held_key, held = held_key[cut:], held[cut:]
            if len(held_key):
                yield flush(held_key, held)

        rows = distinct.select("fp").mapInArrow(spread, "key long, fp binary")
        rows = rows.repartition("key").sortWithinPartitions("key")
        return rows.mapInArrow(meet, "a binary, b binary")
