"""Source divergence audit: which terms set a source of a language apart.

Every language keeps the terms in at least `min_docs` of its documents. Smoothed shares of
a term, in billionths, are compared between the sources of a language (`pair`) and between
a source and its language (`term`).

The terms of a group are ranked through a dominance skyband. A term's excess grows with its
count in the group and falls with its count in the language, and ties go to the earlier
term; so a term that `top` others dominate in all three cannot be among the first `top`,
whatever the totals are. Partitions keep their skybands, skybands are merged in a tree, and
the exact values are computed and ranked for what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.llm import exchange as X
from cellgauge.llm.store import written
from cellgauge.llm.terms import bag_of, by_bucket, split_terms, summed, task_count
from cellgauge.llm.text import one_array

#: Smoothed shares are counted in parts of this.
SCALE = 1_000_000_000
#: Rows compared with the retained ones at once.
ROWS = 512
#: Partial skybands that one task merges.
FAN = 16
#: Sources and terms of a tile when sources are compared.
TILE_SOURCES, TILE_TERMS = 128, 2048
#: Counts that one task compares, at least, and per pair of sources: partial sums stay fewer than counts.
TASK_COUNTS, PAIR_COUNTS = 20_000, 16

TALLY_SCHEMA = "bucket int, names binary, terms binary, term binary, `group` binary, uses binary, docs binary"


def _names(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Distinct (lang, source) of a chunk, joined by a zero byte and a length, and each row's number."""
    lang, source = one_array(table["lang"]), one_array(table["source"])
    size = pc.cast(pc.binary_length(pc.cast(lang, pa.binary())), pa.string())
    coded = one_array(pc.binary_join_element_wise(size, pc.binary_join_element_wise(lang, source, ""), ":"))
    coded = coded.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _split_names(names: list[str]) -> tuple[list[str], list[str]]:
    langs, sources = [], []
    for name in names:
        size, _, rest = name.partition(":")
        raw = rest.encode()
        langs.append(raw[: int(size)].decode())
        sources.append(raw[int(size) :].decode())
    return langs, sources


def _tallied(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in X.doc_chunks(batches):
            names, group = _names(table)
            bag = bag_of(one_array(table["text"]), split_terms)
            if not len(bag.words):
                continue
            order, present, ends = by_bucket(bag.words, buckets)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            width = len(names)
            key, at, where = np.unique(
                place[bag.code] * width + group[bag.doc], return_index=True, return_inverse=True
            )
            uses = np.bincount(where, weights=bag.uses, minlength=len(at)).astype(np.int64)
            docs = np.bincount(where, minlength=len(at))
            term, words, held = key // width, bag.words.take(pa.array(order)), X.pack(names)
            cut = np.searchsorted(term, ends)
            rows = []
            for b, t0, t1, a, z in zip(present, ends, ends[1:], cut, cut[1:], strict=False):
                columns = (np.diff(term[a:z], prepend=t0), key[a:z] % width, uses[a:z], docs[a:z])
                packed = (X.pack(pa.array(c.astype(np.int32 if i < 2 else np.int64))) for i, c in enumerate(columns))
                rows.append((int(b), held, X.pack(words.slice(t0, t1 - t0)), *packed))
            types = [pa.int32(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                ["bucket", "names", "terms", "term", "group", "uses", "docs"],
            )

    return run


def _codes(arrays: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """Distinct strings of several arrays, and the code of every entry of each array."""
    coded = pa.concat_arrays(arrays).dictionary_encode()
    ends = np.cumsum([len(a) for a in arrays])
    return coded.dictionary, np.split(coded.indices.to_numpy().astype(np.int64), ends[:-1])


def _kept(min_docs: int):
    """Terms that a language keeps, with their counts by source; a task holds whole terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        X.lean_memory()
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        names, name_codes = _codes(X.unpack_all(table["names"]))
        terms, term_codes = _codes(X.unpack_all(table["terms"]))
        columns = (X.unpack_all(table[c]) for c in ("term", "group", "uses", "docs"))
        keys, uses, docs = [], [], []
        for code, name, t, g, u, d in zip(term_codes, name_codes, *columns, strict=True):
            keys.append(code[np.cumsum(t.to_numpy())] * len(names) + name[g.to_numpy()])
            uses.append(u.to_numpy())
            docs.append(d.to_numpy())
        every = np.concatenate(keys)
        key, total = summed(every, np.concatenate(uses))
        _, in_docs = summed(every, np.concatenate(docs))
        langs, sources = _split_names(names.to_pylist())
        lang_names, lang_of = np.unique(np.array(langs, dtype=object), return_inverse=True)
        term, group = key // len(names), key % len(names)
        entry = term * len(lang_names) + lang_of[group]
        order = np.argsort(entry, kind="stable")
        entry, group, total, in_docs = entry[order], group[order], total[order], in_docs[order]
        first = np.flatnonzero(np.diff(entry, prepend=-1))
        often = np.add.reduceat(in_docs, first) >= min_docs
        sizes = np.diff(np.append(first, len(entry)))
        wanted, at = np.repeat(often, sizes), np.append(0, np.cumsum(sizes[often]))
        if not often.any():
            return
        head = entry[first[often]]
        bucket = one_array(table["bucket"])[0].as_py()
        source = pa.array(sources, pa.string()).take(pa.array(group[wanted]))
        out = pa.table({
            "bucket": pa.array(np.full(len(head), bucket), pa.int32()),
            "lang": pa.array(lang_names[head % len(lang_names)], pa.string()),
            "term": terms.take(pa.array(head // len(lang_names))),
            "total": pa.array(np.add.reduceat(total[wanted], at[:-1]), pa.int64()),
            "sources": X.list_array(at, source),
            "counts": X.list_array(at, pa.array(total[wanted], pa.int64())),
        })
        yield from out.to_batches(max_chunksize=4096)

    return run


def term_counts(
    docs: DataFrame, min_docs: int = 30, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """One row per language and kept term: bucket, lang, term, total, sources, counts.

    Null texts, languages and sources count as ''. Repeated rows are documents of their own.
    Texts are read once; a chunk holds each of its distinct words once, so a hot word or
    source is a few entries per chunk, and a task of the shuffle holds whole terms.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in
                         ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    tasks = task_count(rows)
    packed = X.dealt(rows.mapInArrow(_tallied(tasks), TALLY_SCHEMA), tasks)
    schema = "bucket int, lang string, term string, total long, sources array<string>, counts array<long>"
    return written(packed.mapInArrow(_kept(min_docs), schema), "term-counts")


def group_totals(docs: DataFrame, counts: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per occurring (lang, source): n and lang_n, uses of kept terms, and v, the terms kept."""
    groups = docs.select(
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")
    ).distinct()
    used = counts.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    used = used.groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    langs = counts.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    out = groups.join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    return written(out.fillna(0, ["n", "v", "lang_n"]), "group-totals")


def share(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), by long division in whole numbers."""
    below = total + 5 * terms
    out, rest = np.divmod(count + 5, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def skyband(table: pa.Table, top: int) -> pa.Table:
    """Rows (term, uses, total) of one group that fewer than `top` others dominate.

    A row dominates another with at least its uses, at most its total and an earlier term.
    Dominators come first in the order, and a row with `top` dominators has `top` of them
    in the skyband; so rows are compared with the retained ones only.
    """
    names = np.argsort(np.argsort(one_array(table["term"]).cast(pa.binary()).to_numpy(zero_copy_only=False)))
    uses, total = one_array(table["uses"]).to_numpy(), one_array(table["total"]).to_numpy()
    order = np.lexsort((names, total, -uses))
    names, total = names[order], total[order]
    held = np.empty(0, np.int64)
    for begin in range(0, len(order), ROWS):
        rows = np.arange(begin, min(begin + ROWS, len(order)))
        over = np.zeros(len(rows), np.int64)
        for a in range(0, len(held), 4096):
            h = held[a : a + 4096]
            over += ((total[h] <= total[rows, None]) & (names[h] < names[rows, None])).sum(axis=1)
        rows, over = rows[over < top], over[over < top]
        # Among the rows of the block those before a row in the order may dominate it too.
        inner = (total[rows] <= total[rows, None]) & (names[rows] < names[rows, None])
        over += np.tril(inner, -1).sum(axis=1)
        held = np.append(held, rows[over < top])
    return table.take(pa.array(np.sort(order[held])))


BAND_SCHEMA = "part int, lang string, source string, term string, uses long, total long"


def _local_bands(top: int):
    """Skybands of the groups of a partition, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        X.lean_memory()
        held: dict[tuple[str, str], pa.Table] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch["counts"]).to_numpy()
            row = pa.array(np.repeat(np.arange(len(batch)), sizes))
            source, uses = batch["sources"].flatten(), batch["counts"].flatten()
            flat = pa.table({
                "lang": batch["lang"].take(row), "source": source, "term": batch["term"].take(row),
                "uses": uses, "total": batch["total"].take(row),
            }).sort_by([("lang", "ascending"), ("source", "ascending")])
            for lang, source, size in _runs(flat):
                group = flat.slice(size[0], size[1])
                known = held.get((lang, source))
                group = group if known is None else pa.concat_tables([known, group])
                held[lang, source] = skyband(group, top)
        part = TaskContext.get().partitionId()
        for table in held.values():
            column = pa.array(np.full(len(table), part), pa.int32())
            yield from table.add_column(0, "part", column).combine_chunks().to_batches()

    return run


def _runs(table: pa.Table) -> Iterator[tuple[str, str, tuple[int, int]]]:
    if not len(table):
        return
    lang, source = (one_array(table[c]).dictionary_encode() for c in ("lang", "source"))
    code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    first = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))
    for a, b in zip(first, first[1:], strict=False):
        yield lang[int(a)].as_py(), source[int(a)].as_py(), (int(a), int(b - a))


def top_terms(counts: DataFrame, totals: DataFrame, top: int = 50) -> DataFrame:
    """Part `term`: the terms of each group above their language's share, ranked to `top`."""
    bands = written(counts.mapInArrow(_local_bands(top), BAND_SCHEMA), "bands")
    parts = (bands.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // FAN)
        merged = bands.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("part", "lang", "source")
        bands = written(merged.applyInArrow(lambda t: skyband(t, top), BAND_SCHEMA), "bands")

    def billionths(count: str, total: str) -> str:
        return f"1 + (cast({SCALE} as decimal(38,0)) * ({count} + 5)) div ({total} + 5 * v)"

    valued = bands.drop("part").join(totals, ["lang", "source"])
    valued = valued.withColumn("value", F.expr(f"({billionths('uses', 'n')}) - ({billionths('total', 'lang_n')})"))
    valued = valued.where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    return _ranked(valued, "term").where(F.col("rank") <= top)


def _distances(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the terms of one (lang, part) for every ordered pair of sources of the lang."""
    X.lean_memory()
    right = right.sort_by("source")
    names = one_array(right["source"])
    n, v = one_array(right["n"]).to_numpy(), right["v"][0].as_py() if len(right) else 0
    size = len(names)
    if size < 2:
        return pa.table({c: pa.array([], t) for c, t in
                         (("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()))})
    sizes = pc.list_value_length(one_array(left["counts"])).to_numpy().astype(np.int64)
    term = np.repeat(np.arange(len(left)), sizes)
    place = pc.index_in(one_array(left["sources"]).flatten(), names).to_numpy().astype(np.int64)
    uses = one_array(left["counts"]).flatten().to_numpy()
    rows = []
    for i in range(0, size, TILE_SOURCES):
        for j in range(0, size, TILE_SOURCES):
            a, b = np.arange(i, min(i + TILE_SOURCES, size)), np.arange(j, min(j + TILE_SOURCES, size))
            total = np.zeros((len(a), len(b)), np.int64)
            for t in range(0, len(left), TILE_TERMS):
                width = min(TILE_TERMS, len(left) - t)
                x, y = np.searchsorted(term, (t, t + width))
                pa_, pb = (_shares(s, n, v, place[x:y], term[x:y] - t, uses[x:y], width) for s in (a, b))
                for k in range(len(a)):
                    total[k] += np.abs(pa_[k] - pb).sum(axis=1)
            one, other = np.nonzero(a[:, None] != b[None, :])
            rows.append((a[one], b[other], total[one, other]))
    one, other, value = (np.concatenate(c) for c in zip(*rows, strict=True))
    lang = right["l"][0].as_py()
    return pa.table({
        "lang": pa.array([lang] * len(one), pa.string()),
        "source": names.take(pa.array(one)), "item": names.take(pa.array(other)), "value": pa.array(value, pa.int64()),
    })


def _shares(sources, n, v, place, term, uses, width) -> np.ndarray:
    """Shares of a tile: a row per source, a column per term; counts that are absent are 0."""
    count = np.zeros((len(sources), width), np.int64)
    here = (place >= sources[0]) & (place <= sources[-1])
    count[place[here] - sources[0], term[here]] = uses[here]
    return share(count, n[sources][:, None], v)


def source_pairs(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Part `pair`: the distance of every ordered pair of sources of a language, ranked.

    A task takes a part of the terms of one language and compares its sources in tiles;
    sources without a term there come from the totals, so do languages that keep none.
    The number of parts follows the counts, so each holds a bounded share of them.
    """
    held = counts.agg(F.sum(F.size("counts"))).first()[0] or 0
    widest = totals.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-held // max(TASK_COUNTS, PAIR_COUNTS * widest**2)))
    left = counts.select((F.col("bucket") % parts).alias("part"), "lang", "sources", "counts")
    known = left.select("lang", "part").union(totals.select("lang", F.lit(0))).distinct()
    right = totals.join(known, "lang").select("part", "lang", "source", "n", "v").toDF("p", "l", "source", "n", "v")
    sums = left.groupBy("lang", "part").cogroup(right.groupBy("l", "p")).applyInArrow(
        _distances, "lang string, source string, item string, value long"
    )
    return _ranked(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of both parts.

    Null text, lang and source count as ''; a text without terms still gives its group; a
    language that keeps no term has pairs of value 0 and no `term` rows; a group alone in
    its language has no pairs; equal values are ranked by the item's UTF-8; repeated rows
    count again; an empty table gives no rows. Other columns are not read.
    """
    counts = term_counts(docs, min_docs)
    totals = group_totals(docs, counts)
    return source_pairs(counts, totals).unionByName(top_terms(counts, totals, top))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (SELECT row, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
used AS (SELECT lang, source, term, count(*) AS uses FROM w JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs ON g.lang = langs.lang
  LEFT JOIN (SELECT lang, source, sum(uses) AS n FROM used GROUP BY ALL) s ON g.lang = s.lang AND g.source = s.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(uses, 0) AS uses,
    1 + (1000000000::HUGEINT * (coalesce(uses, 0) + 5)) // (n + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (total + 5)) // (lang_n + 5 * v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
              WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE uses > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
