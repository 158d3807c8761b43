"""Splitting batches of UTF-8 text with numpy, on the buffers that Arrow brings to a task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20  # A-Z only, as the contracts of the operators say

OTHER, LETTER, NUMBER, SPACE = range(4)


def _table(separators: list[range]) -> np.ndarray:
    keep = np.ones(256, dtype=bool)
    for r in separators:
        keep[r.start : r.stop] = False
    return keep


#: Bytes of a word: everything but ASCII white space.
NOT_SPACE = _table([range(0x20, 0x21), range(0x09, 0x0E)])
#: Bytes of a word after lower-casing: digits, a-z and every byte of a non-ASCII character.
WORD = _table([range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80)])


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins; a null counts as empty."""
    arr = pc.fill_null(one_array(column).cast(pa.large_string()), "")
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = arr.buffers()
    offsets = np.frombuffer(at, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(
        len(offsets) - 1,
        pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)),
        pa.py_buffer(np.ascontiguousarray(data)),
    )


def blocks(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer text is a range of its own."""
    _, offsets = buffers(column)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = max(end, begin + 1)
        yield begin, end
        begin = end


def byte_words(
    data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, lower: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of kept bytes within each text: their bytes end to end, offsets, number per text."""
    if lower:
        data = LOWER[data]
    mask = keep[data]
    if not len(mask):
        return data, np.zeros(1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    edge = np.empty(len(mask), dtype=bool)
    edge[0] = True
    np.logical_not(mask[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(mask)]] = True
    starts = np.flatnonzero(mask & edge)
    before = np.cumsum(mask, dtype=np.int64)
    total = int(before[-1])
    at = np.append(before[starts] - 1, total)
    counts = np.diff(np.searchsorted(starts, offsets))
    return data[mask], at, counts


def spaced_words(
    data: np.ndarray, offsets: np.ndarray, keep: np.ndarray
) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one space after each: bytes, word starts, word ends, number per text."""
    packed, at, counts = byte_words(data, offsets, keep)
    n = len(at) - 1
    out = np.full(len(packed) + n, 0x20, dtype=np.uint8)
    out[np.arange(len(packed)) + np.repeat(np.arange(n), np.diff(at))] = packed
    starts = at[:-1] + np.arange(n)
    return out.tobytes(), starts, starts + np.diff(at), counts


@cache
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    every = np.arange(0x110000, dtype=np.uint32)
    every[0xD800:0xE000] = 0  # surrogates are no characters
    chars = every.tobytes().decode("utf-32-le")
    classes = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, chars):
            classes[run.start() : run.end()] = kind
    return classes


def _code_points(data: np.ndarray, lead: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which characters lie outside ASCII, and their code points."""
    wide = np.flatnonzero(first >= 0x80)
    padded = np.append(data, np.zeros(3, np.uint8))
    at, b0 = lead[wide], first[wide].astype(np.uint32)
    b1, b2, b3 = (padded[at + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
    two = (b0 & 0x1F) << 6 | b1
    three = (b0 & 0x0F) << 12 | b1 << 6 | b2
    four = (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3
    code = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
    return wide, np.minimum(code, 0x10FFFF)


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matches of the byte-level pattern, which cover each text without a gap.

    A run of letters, of numbers or of other characters takes one blank before it; the
    last character of white space before such a run stands alone; an apostrophe that
    begins a match takes s, t, m, d, re, ve or ll after it.
    Returns bytes, offsets and the number of matches per text.
    """
    texts = len(offsets) - 1
    if not len(data):
        return data, np.zeros(1, np.int64), np.zeros(texts, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data.take(lead, mode="clip")
    classes = char_classes()
    kind = np.frombuffer(first.tobytes().translate(classes[:256].tobytes()), np.uint8).copy()
    wide, code = _code_points(data, lead, first)
    kind[wide] = classes[code]
    n = len(lead)
    opens = np.zeros(n + 3, dtype=bool)  # first character of a text; the end counts as one
    opens[np.searchsorted(lead, offsets)] = True
    space = kind == SPACE
    change = opens[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    blank = np.zeros(n, dtype=bool)
    blank[1:] = (first[:-1] == 0x20) & ~opens[1:n]
    start = change & (space | ~blank)
    start[:-1] |= space[:-1] & ~space[1:] & ~opens[1:n]
    # Apostrophes that begin a match and are followed by one of the endings.
    mark = np.flatnonzero((first == 0x27) & change & ~blank)
    mark = mark[~opens[mark + 1]]
    after = np.append(first, np.zeros(3, np.uint8))
    a, b = after[mark + 1], after[mark + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == 0x72) & (b == 0x65) | (a == 0x76) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)) & ~opens[mark + 2]
    start = np.append(start, np.zeros(3, dtype=bool))
    start[mark[one | two] + 1] = False
    start[mark[one] + 2] = True
    start[mark[two] + 3] = True
    starts = lead[np.flatnonzero(start[:n])]
    counts = np.diff(np.searchsorted(starts, offsets))
    return data, np.append(starts, len(data)), counts
