"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that two fingerprints within the distance
differ by at most one bit in one of them. Each segment is indexed under its variants with
one bit blanked out, equal variants meet in a shuffle, and the full distance is verified.
Only distinct fingerprints are indexed: copies meet in an aggregate before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.components import connected_components
from cellgauge.llm.exchange import BLOCK_BYTES
from cellgauge.llm.store import free_name, written
from cellgauge.llm.text import NOT_SPACE, blocks, buffers, one_array, spaced_words
from cellgauge.llm.wide import Similar

#: Runs of equal variants up to this length are compared by shifting whole columns.
SHORT_RUN = 32


def fingerprints_of(column: pa.Array, shingle: int, keep: np.ndarray) -> np.ndarray:
    """Signed 64-bit fingerprints of a batch of texts."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = []
    for begin, end in blocks(column, BLOCK_BYTES):
        raw, starts, ends, counts = spaced_words(*buffers(column.slice(begin, end - begin)), keep)
        docs = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        place = np.arange(len(starts)) - first[docs]
        size = np.minimum(counts, shingle)[docs]
        opens = np.flatnonzero(place + size <= counts[docs])
        lo, hi = starts[opens].tolist(), ends[opens + size[opens] - 1].tolist()
        hashes = np.fromiter((digest(raw[a:b], 42) for a, b in zip(lo, hi, strict=True)), np.uint64, len(lo))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        n = np.bincount(docs[opens], minlength=len(counts))
        total = np.zeros((len(counts), 64), dtype=np.int32)
        if len(opens):
            some = n > 0
            total[some] = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
        majority = np.packbits(2 * total > n[:, None], axis=1)
        out.append(majority.view(">u8").ravel().astype(np.uint64))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def with_fingerprints(
    docs: DataFrame, text_col: str = "text", shingle: int = 4, name: str = "fp"
) -> DataFrame:
    """Add a column `name`: a bit is set if it is set in over half of the hashes of a text's shingles.

    Shingles are runs of `shingle` lower-cased words, repeats included; a text of fewer
    words is one shingle; null and wordless texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(fingerprints_of(one_array(batch[text_col]), shingle, NOT_SPACE))
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], [*batch.schema.names, name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*fields, f"`{name}` long"]))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments: the fewest of which one differs by one bit at most."""
    n = distance // 2 + 1
    ends = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def variants(fp: Column, distance: int) -> Column:
    """Array of (slot, rest): every segment with each of its bits blanked out."""
    out = []
    for first, bits in segments(distance):
        mask = ((1 << bits) - 1) << first
        for bit in range(first, first + bits):
            rest = _signed(mask & ~(1 << bit))
            out.append(F.struct(F.lit(bit).alias("slot"), fp.bitwiseAND(F.lit(rest)).alias("rest")))
    return F.array(*out)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _own_slot(x: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """The first slot under which two fingerprints with this difference meet."""
    slot = np.full(len(x), -1, dtype=np.int64)
    for first, bits in reversed(cuts):
        part = (x >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        near = np.bitwise_count(part) <= 1
        bit = np.where(part > 0, np.log2(np.maximum(part, np.uint64(1)).astype(np.float64)).astype(np.int64), 0)
        slot = np.where(near, first + bit, slot)
    return slot


def _run_links(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one long run, without all its pairs."""
    left = fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(left ^ node) <= distance
            found, left = left[near], left[~near]
            if len(found):
                yield np.full(len(found), node), found
                queue.extend(found)


def _links(slot: np.ndarray, rest: np.ndarray, fp: np.ndarray, distance: int, cuts) -> tuple[np.ndarray, np.ndarray]:
    fresh = np.append(True, (slot[1:] != slot[:-1]) | (rest[1:] != rest[:-1]))
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(fp)))
    a, b = [], []
    run = np.repeat(np.arange(len(begin)), size)
    short = np.repeat(size <= SHORT_RUN, size)
    for d in range(1, int(min(size.max(initial=0), SHORT_RUN))):
        i = np.flatnonzero((run[:-d] == run[d:]) & short[:-d])
        x = fp[i] ^ fp[i + d]
        i, x = i[near := np.bitwise_count(x) <= distance], x[near]
        i = i[_own_slot(x, cuts) == slot[i]]  # a pair that meets often is given once
        a.append(fp[i])
        b.append(fp[i + d])
    for k in np.flatnonzero(size > SHORT_RUN):
        for x, y in _run_links(fp[begin[k] : begin[k] + size[k]], distance):
            a.append(x)
            b.append(y)
    join = lambda z: np.concatenate(z).view(np.int64) if z else np.empty(0, np.int64)
    return join(a), join(b)


def fingerprint_links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all pairs within `distance`.

    No pair is lost: every pair within the distance is linked or connected by others of
    its run. Rows of one variant meet in one task as eight bytes each, since they are
    distinct fingerprints that agree in all other bits of a segment.
    """
    cuts = segments(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in range(3)]

        def flush(cols):
            a, b = _links(cols[0], cols[1], cols[2].view(np.uint64), distance, cuts)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            new = [batch[c].to_numpy().astype(np.int64) for c in ("slot", "rest", "fp")]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            same = (held[0] == held[0][-1:]) & (held[1] == held[1][-1:])
            cut = len(same) - int(same[::-1].argmin() if not same.all() else len(same))
            if cut:
                yield flush([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield flush(held)

    rows = distinct.select(F.explode(variants(F.col("fp"), distance)).alias("v"), "fp")
    rows = rows.select("v.slot", "v.rest", "fp").repartition("slot", "rest")
    return rows.sortWithinPartitions("slot", "rest").mapInArrow(run, "a long, b long")


@dataclass(frozen=True)
class Bits:
    """Texts whose 64-bit fingerprints of `shingle`-word shingles differ in `distance` bits at most."""

    shingle: int = 4
    distance: int = 4

    def mark(self, docs: DataFrame, text_col: str, name: str) -> DataFrame:
        return with_fingerprints(docs, text_col, self.shingle, name)

    def node(self, mark: Column) -> Column:
        return mark

    def links(self, distinct: DataFrame) -> DataFrame:
        return fingerprint_links(distinct, self.distance)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    distance: int = 4,
) -> DataFrame:
    """One row per document: id, `fp` and `component_id`, the smallest id reachable by links.

    Fingerprints that differ in `distance` bits or fewer link their documents. Null and
    wordless texts share fingerprint zero and link like any other. A null id keeps its
    row and is never a component's name unless the component has no other. Repeated rows
    stay; no rows give none; other columns are not read.
    """
    marked, classes = _classes(docs, id_col, text_col, Bits(shingle, distance))
    named = marked.join(classes.select("fp", "component_id"), "fp")
    return named.select(F.col("id").alias(id_col), "fp", "component_id")


def _classes(docs: DataFrame, id_col: str, text_col: str, law: Bits | Similar) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of all rows, and per distinct mark `fp` its component and that one's name."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = written(law.mark(rows, "text", "fp").select("id", "fp"), "fingerprints")
    least = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "least")
    parts = connected_components(law.links(least.select("fp")))
    named = least.withColumn("node", law.node(F.col("fp"))).join(parts, "node", "left")
    named = written(named.select("fp", "least", F.coalesce("component", "node").alias("component")), "parts")
    names = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "names")
    return marked, written(named.join(names, "component").drop("least"), "classes")


def kept_documents(docs: DataFrame, law: Bits | Similar | None = None) -> DataFrame:
    """Rows of `docs`, one for each component under a law of nearness: a row with the smallest id.

    The default law is that of `near_duplicates`. A row is told by its id and its fingerprint:
    where texts of several components share an id, each component keeps its own row. Of
    repeated rows one stays. Rows without an id go if their component has a row with one;
    else one of them stays. Null and wordless texts have fingerprint zero and are linked like
    any other; no rows give none; extra columns are kept whatever their names.
    """
    law = law or Bits()
    marked, classes = _classes(docs, "doc_id", "text", law)
    named = marked.join(classes.where("component_id is not null"), "fp").where("id = component_id")
    heads = named.groupBy("component", "id").agg(F.min("fp").alias("head"))
    rows = marked.groupBy("id").agg(F.count("*").alias("rows"))
    heads = written(heads.join(rows, "id").select("id", "head", "rows"), "heads")
    # The kept ids grow with the documents: they meet them by a merge join at every size.
    key, fp, part = (free_name(docs, c) for c in ("key", "fp", "part"))
    single = heads.where("rows = 1").select(F.col("id").alias(key)).hint("merge")
    one = docs.join(single, F.col("doc_id") == F.col(key), "left_semi")
    # Ids of several rows: the fingerprint tells which of them is the head.
    several = heads.where("rows > 1").select(F.col("id").alias(key), F.col("head").alias(part))
    shared = docs.join(several.select(key).distinct(), F.col("doc_id") == F.col(key), "left_semi")
    shared = law.mark(shared, "text", fp)
    shared = shared.join(several, (F.col("doc_id") == F.col(key)) & (F.col(fp) == F.col(part)), "left_semi")
    lost = law.mark(docs.where("doc_id is null"), "text", fp)
    unnamed = classes.where("component_id is null")
    lost = lost.join(unnamed.select(F.col("fp").alias(key), F.col("component").alias(part)), F.col(fp) == F.col(key))
    kept = one.unionByName(shared.dropDuplicates(["doc_id", fp]).select(*docs.columns))
    return kept.unionByName(lost.dropDuplicates([part]).select(*docs.columns)).select(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
