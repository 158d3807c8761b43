"""Global distinct-key shuffle.

Texts are split into keys (words, pre-tokens, n-grams) with their positions. A chunk of
documents holds each of its distinct keys once and a code per position, so what is
shuffled is one row per chunk and key, however frequent the key is. `resolve` brings equal
keys of all chunks together, works each out once and returns the values per chunk;
`reassemble` puts them back in the order of the texts.

Rows are packed: one row of a chunk carries the keys that share a bucket, as a compressed
Arrow array. A chunk is bounded in bytes (a longer text is a chunk of its own), a bucket by
the number of buckets. The chunk table is bucketed by chunk, so the values come to it and
the positions are not shuffled.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.store import shuffle_partitions
from cellgauge.llm.text import blocks, buffers, one_array, string_array

CHUNK_BYTES = 10 << 20
BLOCK_BYTES = 2 << 20
#: Keys a task of `resolve` holds at once, by which the number of buckets is chosen.
TASK_KEYS = 1_500_000


def chunk_id(sequence: int) -> int:
    """Unique within one table that is written before it is read."""
    return (TaskContext.get().partitionId() << 32) | sequence


def pack_codes(codes: np.ndarray) -> bytes:
    """Byte planes under a general compressor: frequent keys have small codes."""
    import zstandard

    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_codes(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


@cache
def lean_memory() -> None:
    """Give large arrays back to the system when they are freed; Python workers live long."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


@contextlib.contextmanager
def kept_memory() -> Iterator[None]:
    """Use freed memory again within a long step, which new pages for each array would slow; give it back at its end."""
    libc, put = None, lambda *_: None
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        put = libc.mallopt
    put(-3, 32 << 20)  # M_MMAP_THRESHOLD, at its largest
    put(-1, 1 << 30)  # M_TRIM_THRESHOLD
    try:
        yield
    finally:
        put(-3, 1 << 20)
        put(-1, 128 << 10)
        with contextlib.suppress(AttributeError):
            libc.malloc_trim(0)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _from_planes(data: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(dtype).ravel()


def pack(array: pa.Array) -> bytes:
    """Strings, numbers or lists of 32-bit numbers, without nulls, as compressed bytes.

    What follows the number of entries: the kind, sizes (of strings and lists), contents.
    """
    import zstandard

    if pa.types.is_string(array.type):
        data, at = buffers(array)
        kind, sizes, held = "s", np.diff(at), data.tobytes()
    elif pa.types.is_list(array.type):
        kind, sizes = "l", pc.list_value_length(array).to_numpy()
        held = _planes(array.flatten().to_numpy().astype("<i4"))
    else:
        values = array.to_numpy()
        kind, sizes, held = values.dtype.str[1:], None, _planes(values)
    head = b"" if sizes is None else _planes(sizes.astype("<u4"))
    label = f"{kind} {len(array)} ".encode()
    return label + zstandard.ZstdCompressor(level=1).compress(head + held)


def unpack(data: bytes) -> pa.Array:
    import zstandard

    kind, n, rest = data.split(b" ", 2)
    n, kind, raw = int(n), kind.decode(), zstandard.ZstdDecompressor().decompress(rest)
    if kind not in "sl":
        return pa.array(_from_planes(raw, "<" + kind, n))
    at = np.append(0, np.cumsum(_from_planes(raw, "<u4", n), dtype=np.int64))
    body = raw[4 * n :]
    if kind == "s":
        return string_array(np.frombuffer(body, np.uint8), at)
    return list_array(at, pa.array(_from_planes(body, "<i4", int(at[-1]))))


def unpack_all(column: pa.Array | pa.ChunkedArray) -> list[pa.Array]:
    return [unpack(x) for x in one_array(column).to_pylist()]


def doc_chunks(
    batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES
) -> Iterator[pa.Table]:
    """Regroup incoming batches (texts in column `text`) into tables of about `limit` bytes."""
    lean_memory()
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        begin = 0
        for i, length in enumerate(pc.fill_null(pc.binary_length(table["text"]), 0).to_pylist()):
            size += length
            if size >= limit:
                yield pa.concat_tables([*held, table.slice(begin, i + 1 - begin)])
                held, size, begin = [], 0, i + 1
        if begin < len(table):
            held.append(table.slice(begin))
    if held:
        yield pa.concat_tables(held)


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def key_buckets(keys: pa.Array, buckets: int) -> np.ndarray:
    """Bucket of each key by its value alone."""
    if pa.types.is_integer(keys.type):
        hashed = keys.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((hashed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    return (pd.util.hash_array(keys.to_numpy(zero_copy_only=False)) % np.uint64(buckets)).astype(np.int64)


def bucket_rows(chunk: int, keys: pa.Array, uses: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """The keys of one chunk as one row per bucket; `idx` tells their codes.

    Codes and whole-number keys are kept as differences, which are small in sorted order.
    """
    order = np.argsort(bucket, kind="stable")
    present, first = np.unique(bucket[order], return_index=True)
    sorted_keys = keys.take(pa.array(order))
    rows = []
    for a, b in zip(first, np.append(first[1:], len(order)), strict=True):
        idx = np.diff(order[a:b], prepend=0).astype(np.int32)
        held = sorted_keys.slice(a, b - a)
        if pa.types.is_integer(held.type):
            held = pa.array(np.diff(held.to_numpy(), prepend=0))
        rows.append((pack(pa.array(idx)), pack(held), pack(pa.array(uses[order[a:b]], pa.int64()))))
    packed = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.binary())] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(present, pa.int32()), pa.array(np.full(len(present), chunk), pa.int64()), *packed],
        ["bucket", "chunk", "idx", "keys", "uses"],
    )


BUCKET_SCHEMA = "bucket int, chunk long, idx binary, keys binary, uses binary"


def unpack_keys(column: pa.Array | pa.ChunkedArray) -> list[pa.Array]:
    return [
        pa.array(np.cumsum(x.to_numpy())) if pa.types.is_integer(x.type) else x for x in unpack_all(column)
    ]


def bucket_count(spark, keys: int) -> int:
    """Buckets, a task each, for so many (chunk, key) entries: a task holds a bounded number."""
    return max(shuffle_partitions(spark), -(-keys // TASK_KEYS))


def explode_keys(
    chunks: DataFrame,
    buckets: int,
    keys: str = "words",
    uses: str = "uses",
    hashed: Callable[[pa.Array], pa.Array] = lambda keys: keys,
) -> DataFrame:
    """Distinct keys of each chunk to rows per bucket; `hashed` is what a bucket goes by."""

    def run(batches):
        lean_memory()
        for batch in batches:
            for i in range(len(batch)):
                held, n = unpack(batch[1][i].as_py()), unpack(batch[2][i].as_py()).to_numpy()
                if len(held):
                    yield bucket_rows(batch[0][i].as_py(), held, n, key_buckets(hashed(held), buckets))

    return chunks.select("chunk", keys, uses).mapInArrow(run, BUCKET_SCHEMA)


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """One task per bucket."""
    return rows.repartitionById(tasks, F.col("bucket"))


def resolve(
    rows: DataFrame,
    work: Callable[[pa.Array, np.ndarray], pa.Array],
    tasks: int,
    tally: Callable[[pa.Array, np.ndarray], list[int]] | None = None,
) -> DataFrame:
    """Work out each distinct key once: `work(keys, uses in all chunks)` gives their values.

    `tally` adds a row per task, of chunk -1, with figures of the task's distinct keys.
    """

    def run(batches):
        lean_memory()
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        held = unpack_keys(table["keys"])
        flat = pa.concat_arrays(held).dictionary_encode()
        uses = pa.concat_arrays(unpack_all(table["uses"])).to_numpy()
        total = np.bincount(flat.indices.to_numpy(), weights=uses, minlength=len(flat.dictionary)).astype(np.int64)
        values = work(flat.dictionary, total)
        ends = np.cumsum([len(x) for x in held])
        chunk, idx = one_array(table["chunk"]), one_array(table["idx"])
        for i, (size, end) in enumerate(zip(map(len, held), ends, strict=True)):
            found = pack(values.take(flat.indices.slice(end - size, size)))
            yield _found(chunk.slice(i, 1), idx.slice(i, 1), found, None)
        if tally:
            yield _found(pa.array([-1], pa.int64()), pa.array([b""], pa.binary()), b"", tally(flat.dictionary, total))

    schema = "chunk long, idx binary, found binary, figures array<long>"
    return dealt(rows, tasks).mapInArrow(run, schema)


def _found(chunk: pa.Array, idx: pa.Array, found: bytes, figures: list[int] | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [chunk, idx, pa.array([found], pa.binary()), pa.array([figures], pa.list_(pa.int64()))],
        ["chunk", "idx", "found", "figures"],
    )


def by_code(resolved: pa.Table) -> pa.Array:
    """Values of one chunk in the order of its codes."""
    idx = np.concatenate([np.cumsum(x.to_numpy(), dtype=np.int64) for x in unpack_all(resolved["idx"])])
    values = pa.concat_arrays(unpack_all(resolved["found"]))
    back = np.empty(len(idx), dtype=np.int64)
    back[idx] = np.arange(len(idx))
    return values.take(pa.array(back))


def reassemble(
    chunks: DataFrame, resolved: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """Bring the values of a chunk to its documents."""
    return chunks.groupBy("chunk").cogroup(resolved.groupBy("chunk")).applyInArrow(work, schema)


def word_chunks(
    docs: DataFrame,
    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    limit: int = CHUNK_BYTES,
    memory: Callable[[], contextlib.AbstractContextManager] = contextlib.nullcontext,
) -> DataFrame:
    """One row per chunk of `docs` (id, text): ids, keys per text, codes, distinct keys, uses.

    Each chunk is made within `memory()`.
    """

    def chunk(sequence: int, table: pa.Table) -> pa.RecordBatch:
        texts = one_array(table["text"])
        parts, counts = [], []
        for begin, end in blocks(texts, BLOCK_BYTES):
            data, offsets, n = split(*buffers(texts.slice(begin, end - begin)))
            parts.append(string_array(data, offsets).dictionary_encode())
            counts.append(n)
        coded = pa.chunked_array(parts).unify_dictionaries()
        codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        words = coded.chunk(coded.num_chunks - 1).dictionary
        uses = np.bincount(codes, minlength=len(words))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([chunk_id(sequence)], pa.int64()),
                list_array(np.array([0, len(table)]), one_array(table["id"])),
                list_array(np.array([0, len(table)]), pa.array(np.concatenate(counts), pa.int32())),
                pa.array([pack_codes(codes)], pa.binary()),
                pa.array([pack(words)], pa.binary()),
                pa.array([pack(pa.array(uses, pa.int64()))], pa.binary()),
                pa.array([len(words)], pa.int64()),
            ],
            ["chunk", "ids", "counts", "codes", "words", "uses", "n_words"],
        )

    def run(batches):
        for sequence, table in enumerate(doc_chunks(batches, limit)):
            with memory():
                out = chunk(sequence, table)
            yield out

    schema = (
        "chunk long, ids array<long>, counts array<int>, codes binary, "
        "words binary, uses binary, n_words long"
    )
    return docs.mapInArrow(run, schema)


def total_keys(chunks: DataFrame) -> int:
    return chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
