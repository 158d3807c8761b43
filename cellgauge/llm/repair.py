"""Token-id files compressed by Re-Pair grammars, with random access.

A shard is a stretch of documents in ascending id order. Its grammar replaces frequent
pairs of neighbouring symbols by nonterminals, again and again; pairs do not reach from
one document into the next. A file row stores the rules, the length that each
nonterminal expands to, the symbols and where each document begins in them, so a document
or a single token is decoded without the rest of the shard.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.llm import exchange as X
from cellgauge.llm.bpe import Encoder, encoded_chunk, gather  # noqa: F401
from cellgauge.llm.store import bucketed, shuffle_partitions, written
from cellgauge.llm.text import buffers, one_array, pretokens

#: The least uses of a new rule.
LEAST = 2
SHARD_BYTES = 8 << 20
#: Ids of a symbol that is expanded once for all its places.
SHORT = 16

FILE_SCHEMA = (
    "shard long, ids array<long>, lengths array<int>, starts array<int>, first_rule int, "
    "lefts array<int>, rights array<int>, expands array<int>, symbols binary"
)


def added_tokens(path: str) -> list[str]:
    """Texts that a tokenizer file gives an id of their own, before pre-tokens are taken."""
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(path).get_added_tokens_decoder().values()
    for t in tokens:
        if t.lstrip or t.rstrip or t.single_word or t.normalized:
            raise ValueError(f"the added token {t.content!r} does not match by its text alone")
    return [t.content for t in tokens if t.content]


def split_at(tokens: list[str], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens as `pretokens` gives them, but each of `tokens` in a text is one of its own.

    The leftmost token goes first, of those that begin together the longest.
    """
    raw = data.tobytes()
    names = sorted((t.encode() for t in tokens), key=len, reverse=True)
    if not any(t in raw for t in names):
        return pretokens(data, offsets)
    found = re.compile(b"|".join(map(re.escape, names)))
    # Pieces of the texts, every second one of a text an added token.
    ends, sizes, own = [0], [], []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        spans = [x for m in found.finditer(raw[a:b]) for x in m.span()]
        ends += [a + x for x in spans] + [b]
        own += [i % 2 == 1 for i in range(len(spans) + 1)]
        sizes.append(len(spans) + 1)
    ends, own = np.array(ends), np.array(own, dtype=bool)
    data, at, counts = pretokens(data, ends)
    closes = np.cumsum(counts)
    keep = np.ones(len(at), dtype=bool)  # an added token keeps its begin only
    for piece in np.flatnonzero(own):
        keep[closes[piece] - counts[piece] + 1 : closes[piece]] = False
    counts = np.where(own, 1, counts)
    first = np.append(0, np.cumsum(sizes))[:-1]
    return data, at[keep], np.add.reduceat(counts, first) if len(first) else counts


@cache
def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


@cache
def word_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of pre-tokens and added tokens by a tokenizer file; read once per Python worker.

    Where the file does nothing but write bytes as letters before its model, the model is
    asked for the pre-tokens, which spares the library's records of their texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    before, model = tokenizer.pre_tokenizer, tokenizer.model
    if (
        tokenizer.normalizer is None
        and isinstance(before, pre_tokenizers.ByteLevel)
        and not before.add_prefix_space
        and isinstance(model, models.BPE)
    ):
        own = {t.content: [i] for i, t in tokenizer.get_added_tokens_decoder().items()}
        letters, tokenize = byte_letters(), model.tokenize

        def ids(word: str) -> list[int]:
            if word in own:
                return own[word]
            return [t.id for t in tokenize(word.encode().decode("latin-1").translate(letters))]

        return lambda words: list(map(ids, words))
    return lambda words: [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def word_numbers(words: pa.Array) -> pa.Array:
    """A number of each word by its bytes alone, as what its bucket goes by."""
    data, at = buffers(words)
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place]))
    return pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64))


def json_encoder(path: str) -> Callable[[], Encoder]:
    """Encoder of single pre-tokens and added tokens by a tokenizer file."""

    def make() -> Encoder:
        def encode(words: pa.Array) -> pa.Array:
            parts = [pa.array([], pa.list_(pa.int32()))]
            for at in range(0, len(words), 8192):
                ids = word_encoder(path)(words.slice(at, 8192).to_pylist())
                parts.append(pa.array(ids, pa.list_(pa.int32())))
            return pa.concat_arrays(parts)

        return encode

    return make


def compress(
    ids: np.ndarray, starts: np.ndarray, least: int = LEAST
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, starts of the documents in them, left and right of the rules, first rule.

    Ends when no pair of neighbours can be replaced `least` times. The first round takes
    all pairs of at least half the uses of the most frequent one, each other one those of
    half as many again, and at last of `least`. Where chosen pairs overlap the more frequent one is replaced, of equals the one of the lower hash,
    until none is left. All pairs are counted once. Uses of a pair never grow, so its places
    wait for the round that takes as few; those of new pairs, which all hold a new symbol,
    are counted in the next round. A round reads and sorts its own places only.
    """
    n = len(ids)
    symbols = np.append(ids.astype(np.int32, copy=False), np.int32(0))
    first = base = int(ids.max(initial=-1)) + 1
    filled = np.diff(starts) > 0
    # Neighbours of each place; n stands for none.
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    after[starts[1:][filled] - 1] = before[starts[:-1][filled]] = after[n] = before[n] = n
    lefts, rights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    places, sizes = _by_pair(np.flatnonzero(after < n), symbols, after, base)
    levels = [2 * least + int(sizes.max(initial=0))]
    while levels[-1] > least:
        levels.append(max(levels[-1] // 2, least))
    levels = np.array(levels[1:])
    # The round that a place waits for, the last one being repeated; `never` is none.
    never = len(levels)
    turns = np.searchsorted(-levels, -np.arange(levels[0] + 1)).astype(np.int8)
    turn = np.full(n + 1, never, dtype=np.int8)
    turn[places] = np.repeat(turns.take(sizes, mode="clip"), sizes)
    now, places = 0, np.flatnonzero(turn == 0)
    while True:
        level, then = levels[now], min(now + 1, never - 1)
        places, sizes = _by_pair(places, symbols, after, base)
        chosen, pairs, uses, spare = _chosen(places, sizes, symbols, after, level)
        if level > least:
            wait = (uses < level) & (uses >= least)
            turn[places[np.repeat(wait, sizes)]] = np.repeat(turns[uses[wait]], sizes[wait])
        if not len(chosen):
            if now == then:
                break
            now, places = then, np.flatnonzero(turn == then)
            continue
        ranks = np.full(len(sizes), -1, dtype=np.int32)
        ranks[chosen] = np.arange(len(chosen))
        rank = np.repeat(ranks, sizes)
        hot = rank >= 0
        spared = places[hot & spare]
        hot &= ~spare
        # Places in ascending order with the ranks of their pairs.
        places = places[hot] << 32 | rank[hot]
        places.sort()
        rank, places = places & 0xFFFFFFFF, places >> 32
        turn[places] = turn[spared] = then
        won = _matched(places, rank, after)
        where, won = places[won], rank[won]
        made = np.flatnonzero(np.bincount(won, minlength=len(chosen)) >= least)
        number = np.full(len(chosen), -1, dtype=np.int64)
        number[made] = base + np.arange(len(made))
        new = number[won]
        where, new = where[new >= 0], new[new >= 0]
        lefts.append(pairs[made] >> 32)
        rights.append(pairs[made] & 0xFFFFFFFF)
        right = _at(after, where).astype(np.int64)
        symbols[where] = new
        symbols[right] = -1
        after[where] = follow = _at(after, right)
        before[follow] = where
        # Pairs that come: of the new symbols with what follows, and with what is before.
        back = _at(before, where)
        turn[right] = never
        turn[where] = np.where(follow < n, then, never)
        turn[back] = then
        turn[n] = never
        if now < then:
            places = np.flatnonzero(turn == then)
        else:
            places = np.sort(np.concatenate([places, spared, where, back]))
            places = places[(turn[places] == then) & (np.diff(places, prepend=-1) > 0)]
        now, base = then, base + len(made)
    live = np.flatnonzero(symbols[:n] >= 0)
    begins = np.zeros(len(starts), dtype=np.int64)
    begins[1:][filled] = np.flatnonzero(after[live] == n) + 1
    return symbols[live], np.maximum.accumulate(begins), np.concatenate(lefts), np.concatenate(rights), first


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """`values[places]`, faster; all places must exist."""
    return values.take(places, mode="clip")


def _by_pair(
    places: np.ndarray, symbols: np.ndarray, after: np.ndarray, top: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by their pair, ascending within each, and how many each pair has; symbols reach to `top`."""
    bits, wide = top.bit_length(), (len(symbols) - 1).bit_length()
    key = _at(symbols, places).astype(np.int64)
    key <<= bits
    key |= _at(symbols, _at(after, places))
    if 2 * bits + wide > 63:
        key = pd.factorize(key)[0]
    key <<= wide
    key |= places
    key.sort()
    places = key & ((1 << wide) - 1)
    key >>= wide
    opens = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return places, np.diff(opens, append=len(key))


def _chosen(
    places: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, after: np.ndarray, level: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of places by pair the pairs that can be replaced `level` times, by rank, as numbers and as symbols.

    Also how often each pair can be replaced, where it may be as often as that, and which
    places do not count: of a run of one symbol every second one.
    """
    opens = np.cumsum(sizes) - sizes
    chosen = np.flatnonzero(sizes >= level)
    head = places[opens[chosen]]
    pairs = symbols[head].astype(np.int64) << 32 | symbols[after[head]]
    uses, spare = sizes, np.zeros(len(places), dtype=bool)
    same = chosen[pairs >> 32 == pairs & 0xFFFFFFFF]
    if len(same):
        at = np.repeat(opens[same] - np.cumsum(sizes[same]) + sizes[same], sizes[same])
        at += np.arange(len(at))
        runs = places[at]
        begins = np.flatnonzero(np.append(True, after[runs[:-1]] != runs[1:]))
        offset = np.arange(len(runs)) - np.repeat(begins, np.diff(begins, append=len(runs)))
        spare[at[offset % 2 == 1]] = True
        uses = sizes.copy()
        uses[same] -= np.add.reduceat(offset % 2, np.cumsum(sizes[same]) - sizes[same])
        keep = uses[chosen] >= level
        chosen, pairs = chosen[keep], pairs[keep]
    mixed = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    order = np.argsort(mixed.astype(np.int64) - (uses[chosen] << 31), kind="stable")
    return chosen[order], pairs[order], uses, spare


def _matched(places: np.ndarray, rank: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Marks places of which no two overlap, lowest ranks first, such that every other one overlaps one."""
    out = np.zeros(len(places), dtype=bool)
    at, follow = np.arange(len(places)), _at(after, places)
    while len(at):
        meets = follow[:-1] == places[1:]
        less = rank[:-1] < rank[1:]
        wins = np.ones(len(at), dtype=bool)
        wins[:-1] &= ~meets | less
        wins[1:] &= ~(meets & less)
        out[at[wins]] = True
        stay = ~wins
        stay[:-1] &= ~(wins[1:] & meets)
        stay[1:] &= ~(wins[:-1] & meets)
        at, places, rank, follow = at[stay], places[stay], rank[stay], follow[stay]
    return out


def symbol_lengths(lefts: np.ndarray, rights: np.ndarray, first: int) -> np.ndarray:
    """Ids that each symbol stands for; a rule uses ids and earlier rules only."""
    out = np.ones(first + len(lefts), dtype=np.int64)
    latest = np.maximum.accumulate(np.maximum(lefts, rights))
    at = first
    while at < len(out):
        # Rules up to the first that uses one of them.
        end = first + int(np.searchsorted(latest, at))
        out[at:end] = out[lefts[at - first : end - first]] + out[rights[at - first : end - first]]
        at = end
    return out


def expansion_lengths(lefts: np.ndarray, rights: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule stands for."""
    return symbol_lengths(lefts, rights, first)[first:]


def expanded(
    symbols: np.ndarray, lefts: np.ndarray, rights: np.ndarray, expands: np.ndarray, first: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all symbols end to end, and where each symbol's begin; no other rule is expanded.

    Symbols of up to `SHORT` ids are expanded once, and their ids copied to all their places.
    """
    sizes = np.append(np.ones(first, dtype=np.int64), expands)
    symbols = symbols.astype(np.int64)
    begins = np.append(0, np.cumsum(sizes[symbols]))
    at = begins[:-1]
    long = sizes[symbols] > SHORT
    if long.any():
        parts = []
        while len(symbols):
            parts.append(at[~long] << 32 | symbols[~long])
            rule, at = symbols[long] - first, at[long]
            left, right = lefts[rule], rights[rule]
            symbols, at = np.concatenate([left, right]), np.concatenate([at, at + sizes[left]])
            long = sizes[symbols] > SHORT
        symbols = np.sort(np.concatenate(parts)) & 0xFFFFFFFF
    kinds = np.flatnonzero(np.bincount(symbols, minlength=len(sizes)))
    held, opens = _short_ids(kinds, lefts, rights, sizes, first)
    took = sizes[symbols]
    sizes[kinds] = opens
    source = np.repeat(sizes[symbols] - np.cumsum(took) + took, took)
    source += np.arange(len(source))
    return _at(held, source), begins


def _short_ids(
    symbols: np.ndarray, lefts: np.ndarray, rights: np.ndarray, sizes: np.ndarray, first: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ids of symbols end to end, and where each one's begin."""
    opens = np.cumsum(sizes[symbols]) - sizes[symbols]
    ids = np.empty(int(sizes[symbols].sum()), dtype=np.int32)
    at = opens
    while len(symbols):
        done = symbols < first
        ids[at[done]] = symbols[done]
        rule, at = symbols[~done] - first, at[~done]
        left, right = lefts[rule], rights[rule]
        symbols, at = np.concatenate([left, right]), np.concatenate([at, at + sizes[left]])
    return ids, opens


def expansions(lefts: np.ndarray, rights: np.ndarray, first: int) -> pa.Array:
    """The ids of every symbol, from the ids themselves to the last rule."""
    every = np.arange(first + len(lefts))
    ids, begins = expanded(every, lefts, rights, expansion_lengths(lefts, rights, first), first)
    return X.list_array(begins, pa.array(ids))


def token_at(symbols, lefts, rights, expands, first: int, position: int) -> int:
    """One id of a document's symbols by the expansion lengths, without decoding the others."""
    size = lambda s: int(expands[s - first]) if s >= first else 1
    for symbol in symbols:
        if position < size(symbol):
            break
        position -= size(symbol)
    while symbol >= first:
        left = lefts[symbol - first]
        if position < size(left):
            symbol = left
        else:
            position -= size(left)
            symbol = rights[symbol - first]
    return int(symbol)


@X.kept_memory()
def _file_row(left: pa.Table, right: pa.Table, end_id: int) -> pa.Table:
    ids, tokens, at = encoded_chunk(left, right)
    n = len(ids)
    starts = at + np.arange(n + 1)
    symbols, begins, lefts, rights, first = compress(np.insert(tokens, at[1:], end_id), starts)
    whole = lambda a, t=pa.int32(): X.list_array(np.array([0, len(a)]), pa.array(a, t))
    return pa.table(
        {
            "shard": left["chunk"].slice(0, 1),
            "ids": X.list_array(np.array([0, n]), ids),
            "lengths": whole(np.diff(starts)),
            "starts": whole(begins),
            "first_rule": pa.array([first], pa.int32()),
            "lefts": whole(lefts),
            "rights": whole(rights),
            "expands": whole(expansion_lengths(lefts, rights, first)),
            "symbols": pa.array([X.pack_codes(symbols)], pa.binary()),
        }
    )


def write_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> DataFrame:
    """Encode all rows, write the files and return them: a row per shard.

    Shards follow each other in ascending id order; rows of equal or null id lie together,
    nulls first, in any order. Null texts have the end id only. Added tokens of the
    tokenizer have their ids inside texts too. Repeated rows stay. No rows write no shard.
    Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id")
    split = partial(split_at, added_tokens(tokenizer))
    chunks = bucketed(X.word_chunks(ordered, split, SHARD_BYTES, X.kept_memory), "shard-words", "chunk")
    tasks = X.bucket_count(spark, X.total_keys(chunks))
    make = json_encoder(tokenizer)
    packed = X.explode_keys(chunks, tasks, hashed=word_numbers)
    words = X.resolve(packed, lambda keys, _uses: make()(keys), tasks)
    texts = chunks.select("chunk", "ids", "counts", "codes")
    files = X.reassemble(texts, words, lambda a, b: _file_row(a, b, end_id), FILE_SCHEMA)
    return written(files, "grammars", path)


DOCUMENT_SCHEMA = "shard long, row int, doc_id long, ids array<int>"


def read_documents(
    files: DataFrame,
    wanted: DataFrame | None = None,
    work: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda documents: documents,
    schema: str = DOCUMENT_SCHEMA,
) -> DataFrame:
    """(shard, row, doc_id, ids) of all documents, or of those whose id is in `wanted` (doc_id).

    Documents are decoded from their own symbols and the rules that these use. `work` makes
    rows of `schema` of the documents of a shard in the task that decodes them.
    """
    if wanted is not None:
        keys = wanted.select(F.col("doc_id").alias("_id")).distinct()
        places = files.select("shard", F.posexplode("ids").alias("row", "_id"))
        places = places.join(keys, "_id").groupBy("shard").agg(F.collect_list("row").alias("rows"))
        files = files.join(places, "shard")
    else:
        files = files.withColumn("rows", F.lit(None).cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        X.lean_memory()
        for batch in batches:
            for i in range(len(batch)):
                with X.kept_memory():
                    out = work(_decoded(batch.slice(i, 1)))
                yield out

    return files.mapInArrow(run, schema)


def _decoded(row: pa.RecordBatch) -> pa.RecordBatch:
    flat = {c: row[c].flatten() for c in ("ids", "starts", "lefts", "rights", "expands")}
    starts, *rules = (flat[c].to_numpy().astype(np.int64) for c in ("starts", "lefts", "rights", "expands"))
    symbols = X.unpack_codes(row["symbols"][0].as_py()).astype(np.int64)
    picked = row["rows"][0].as_py()
    rows = np.arange(len(flat["ids"])) if picked is None else np.array(sorted(picked), dtype=np.int64)
    sizes = np.diff(starts)[rows]
    at = np.append(0, np.cumsum(sizes))
    if picked is not None:
        symbols = symbols[np.repeat(starts[:-1][rows] - at[:-1], sizes) + np.arange(at[-1])]
    ids, ends = expanded(symbols, *rules, row["first_rule"][0].as_py())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(rows), row["shard"][0].as_py()), pa.int64()),
            pa.array(rows, pa.int32()),
            flat["ids"].take(pa.array(rows)),
            X.list_array(ends[at], pa.array(ids, pa.int32())),
        ],
        ["shard", "row", "doc_id", "ids"],
    )


def document_starts(files: DataFrame) -> DataFrame:
    """(shard, before): ids in all shards before each one, first by range, then within it."""
    totals = files.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = totals.withColumn("part", F.shiftright("shard", 32))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    parts = parts.select("part", before.alias("base"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")
    return totals.withColumn("inside", inside).join(parts, "part").select(
        "shard", (F.col("base") + F.col("inside")).alias("before")
    )


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = one_array(batch["ids"])
    flat = lists.flatten().to_numpy().astype("<u4", copy=False)
    sizes = pc.list_value_length(lists).to_numpy()
    at = np.append(0, np.cumsum(sizes))
    crc = [zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:], strict=False)]
    return pa.RecordBatch.from_arrays(
        [batch["shard"], batch["row"], batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
        ["shard", "row", "doc_id", "n_tokens", "ids_crc32"],
    )


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document, read back from the files: start, n_tokens, ids_crc32."""
    files = write_files(docs, tokenizer)
    schema = "shard long, row int, doc_id long, n_tokens long, ids_crc32 long"
    read = written(read_documents(files, work=_digests, schema=schema), "read")
    before = written(document_starts(files), "starts")
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row")) - F.col("n_tokens")
    placed = read.withColumn("inside", inside).join(before, "shard")
    return placed.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
