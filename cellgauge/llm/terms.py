"""Bags of words of documents: each chunk of documents holds its distinct words once.

Texts are cut into words with numpy (see `text`). A text longer than a block is cut between
words, so the memory of a task depends on the block and on the distinct words of a chunk,
not on the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm import exchange as X
from cellgauge.llm.store import shuffle_partitions
from cellgauge.llm.text import buffers, byte_words, string_array

#: Bytes of a term, lower-cased or not: a letter of ASCII or any byte of another character.
TERM = np.zeros(256, dtype=bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True

#: Bytes of text whose distinct words one task of a tally holds.
TASK_BYTES = 32 << 20

Split = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Bag(NamedTuple):
    """Distinct words, and per pair of text and word (each pair once) how often it occurs."""

    words: pa.Array
    doc: np.ndarray
    code: np.ndarray
    uses: np.ndarray


def split_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms with A-Z lower-cased."""
    return byte_words(data, offsets, TERM)


def pieces(texts: pa.Array, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about `limit` bytes: text number of each piece, bytes and offsets of the pieces.

    Only texts beyond the limit are cut, after a byte that belongs to no term.
    """
    data, offsets = buffers(texts)
    cuts = [offsets]
    for i in np.flatnonzero(np.diff(offsets) > limit):
        at, end = offsets[i], offsets[i + 1]
        while end - at > limit:
            gap = np.flatnonzero(~TERM[data[at : at + limit]])
            if not len(gap):  # a term longer than a block
                gap = np.flatnonzero(~TERM[data[at:end]])[:1]
            if not len(gap):
                break
            at = at + gap[-1] + 1
            cuts.append(np.array([at]))
    bounds = np.unique(np.concatenate(cuts))
    rows = np.searchsorted(offsets, bounds[:-1], side="right") - 1
    begin = 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + limit, side="right")) - 1)
        yield rows[begin:end], data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin]
        begin = end


def summed(key: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their uses."""
    distinct, where = np.unique(key, return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, where, uses)
    return distinct, total


def bag_of(texts: pa.Array, split: Split, limit: int = X.BLOCK_BYTES) -> Bag:
    """All words of a chunk of texts; a null text has none."""
    parts, docs, uses = [], [], []
    for rows, data, offsets in pieces(texts, limit):
        packed, at, counts = split(data, offsets)
        coded = string_array(packed, at).dictionary_encode()
        width = max(len(coded.dictionary), 1)
        key = np.repeat(rows, counts) * width + coded.indices.to_numpy()
        key, n = np.unique(key, return_counts=True)
        parts.append(pa.DictionaryArray.from_arrays(pa.array(key % width, pa.int32()), coded.dictionary))
        docs.append(key // width)
        uses.append(n)
    if not parts:
        none = np.empty(0, np.int64)
        return Bag(pa.array([], pa.string()), none, none, none)
    coded = pa.chunked_array(parts).unify_dictionaries()
    words = coded.chunk(coded.num_chunks - 1).dictionary
    code = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
    doc, n = np.concatenate(docs), np.concatenate(uses)
    if any(len(a) and len(b) and a[-1] == b[0] for a, b in zip(docs, docs[1:], strict=False)):
        key, n = summed(doc * len(words) + code, n)  # a text in several blocks
        doc, code = key // len(words), key % len(words)
    return Bag(words, doc, code, n)


def task_count(rows: DataFrame, text_col: str = "text") -> int:
    """Tasks of a tally: each holds the words of a bounded share of the text."""
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(shuffle_partitions(rows.sparkSession), -(-size // TASK_BYTES))


def by_bucket(keys: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of keys by bucket, buckets that occur, and where each begins and ends in the order."""
    bucket = X.key_buckets(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    present, first = np.unique(bucket[order], return_index=True)
    return order, present, np.append(first, len(order))
