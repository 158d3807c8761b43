"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Pre-tokens are exploded with their positions, each distinct pre-token is encoded once,
its ids are joined back and the texts are reassembled by position (see `exchange`).
Decoding joins the token-byte table. The vocabulary file is a parameter.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.llm import exchange as X
from cellgauge.llm.store import bucketed
from cellgauge.llm.text import one_array, pretokens

#: A vocabulary beyond this is no lookup table for every task.
TABLE_BYTES = 64 << 20

Encoder = Callable[[pa.Array], pa.Array]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def rank_encoder(path: str) -> Callable[[], Encoder]:
    """Encoder of single pre-tokens by a rank file; made once per task."""

    def make() -> Encoder:
        import tiktoken

        coder = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={}
        )

        def encode(words: pa.Array) -> pa.Array:
            ids = [coder._core_bpe.encode_single_piece(w.encode()) for w in words.to_pylist()]
            return pa.array(ids, pa.list_(pa.int32()))

        return encode

    return make


def gather(lists: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all coded words end to end, and where each word begins."""
    flat = lists.flatten().to_numpy()
    sizes = pc.list_value_length(lists).to_numpy()
    starts = np.cumsum(sizes) - sizes
    codes = codes.astype(np.int64, copy=False)
    took = sizes.take(codes)
    at = np.append(0, np.cumsum(took, dtype=np.int64))
    where = np.repeat(starts.take(codes, mode="clip") - at[:-1], took)
    where += np.arange(at[-1])
    return flat.take(where, mode="clip") if len(where) else flat[:0], at


def encoded_chunk(left: pa.Table, right: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, token ids end to end and offsets of the documents of one chunk."""
    X.lean_memory()
    row = left.slice(0, 1)
    ids = one_array(row["ids"]).flatten()
    counts = one_array(row["counts"]).flatten().to_numpy()
    codes = X.unpack_codes(row["codes"][0].as_py())
    if not len(codes):
        return ids, np.empty(0, np.int32), np.zeros(len(ids) + 1, np.int64)
    tokens, at = gather(X.by_code(right), codes)
    return ids, tokens, at[np.append(0, np.cumsum(counts, dtype=np.int64))]


def encode_chunks(docs: DataFrame, make: Callable[[], Encoder]) -> tuple[DataFrame, DataFrame]:
    """The chunk table of `docs` (id, text) and the ids of its words."""
    chunks = bucketed(X.word_chunks(docs, pretokens), "pretokens", "chunk")
    tasks = X.bucket_count(docs.sparkSession, X.total_keys(chunks))

    def work(words: pa.Array, _uses: np.ndarray) -> pa.Array:
        return make()(words)

    words = X.resolve(X.explode_keys(chunks, tasks), work, tasks)
    return chunks.select("chunk", "ids", "counts", "codes"), words


def encode(
    docs: DataFrame,
    ranks: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    table: DataFrame | None = None,
) -> DataFrame:
    """One row per row of `docs`: the id column and `ids`, the token ids of its whole text.

    With a token-byte table the ids are decoded again in the same task (see `decode`).

    A null text counts as empty and has no ids; a null document id stays null; repeated
    rows stay repeated; no input rows give none. Other columns are not read, whatever
    their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chunks, words = encode_chunks(rows, rank_encoder(ranks))

    shared = None if table is None else shared_table(table)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, tokens, at = encoded_chunk(left, right)
        columns = {"id": ids, "ids": X.list_array(at, pa.array(tokens, pa.int32()))}
        if shared is not None:
            columns["decoded"] = decoded(columns["ids"], *shared.value)
        return pa.table(columns)

    schema = "id long, ids array<int>" + (", decoded binary" if shared is not None else "")
    return X.reassemble(chunks, words, join, schema).withColumnRenamed("id", id_col)


def token_bytes(spark: SparkSession, ranks: str) -> DataFrame:
    """The token-byte table of a rank file: one row per id."""
    rows = [(i, bytearray(b)) for b, i in read_ranks(ranks).items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def shared_table(table: DataFrame):
    """The token-byte table as a broadcast of lengths and bytes; its size is checked."""
    size = table.agg(F.sum(F.octet_length("bytes")), F.max("id")).first()
    if (size[0] or 0) + 8 * (size[1] or 0) > TABLE_BYTES:
        raise ValueError(f"a token table of {size[0]} bytes is no vocabulary")
    known = table.toArrow().sort_by("id")
    lengths = np.full((size[1] if size[1] is not None else -1) + 1, -1, dtype=np.int64)
    lengths[known["id"].to_numpy()] = pc.binary_length(known["bytes"]).to_numpy()
    data = b"".join(known["bytes"].to_pylist())
    return table.sparkSession.sparkContext.broadcast((lengths, data))


def decoded(column: pa.Array, lengths: np.ndarray, raw: bytes) -> pa.Array:
    """Bytes of each list of ids; an id that the table lacks is an error."""
    flat, held = np.frombuffer(raw, np.uint8), np.maximum(lengths, 0)
    begins = np.cumsum(held) - held
    ids = column.flatten().to_numpy()
    if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths)):
        raise ValueError("an id is not in the token table")
    took = lengths[ids]
    if len(took) and took.min() < 0:
        raise ValueError("an id is not in the token table")
    at = np.append(0, np.cumsum(took, dtype=np.int64))
    where = np.repeat(begins[ids] - at[:-1], took)
    where += np.arange(at[-1])
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()))
    buffers = [None, pa.py_buffer(at[ends]), pa.py_buffer(flat[where])]
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), buffers).cast(pa.binary())
    return pc.if_else(column.is_valid(), out, pa.scalar(None, pa.binary()))


def decode(encoded: DataFrame, table: DataFrame, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Add `name`, the bytes of the ids, from a token-byte table (id, bytes).

    The table is as large as a vocabulary, which is checked, so each task holds it and
    looks all ids of a batch up at once. An id it lacks is an error. Null ids stay null.
    """
    shared = shared_table(table)

    def run(batches):
        X.lean_memory()
        for batch in batches:
            out = decoded(batch[ids_col], *shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, `{name}` binary")


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded bytes."""
    done = encode(docs, ranks, table=token_bytes(docs.sparkSession, ranks))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
