"""Toxicity of texts by a factorization machine over hashed terms.

A text is the set of its terms: lower-cased words, the beginnings of words and the inner
byte n-grams of words, all hashed to 64 bits. The machine adds a weight per term and, for
every two terms, the product of their factor vectors, so it learns what holds for a pair
(an insult with a group) and not for its members.

Terms are screened before: those that occur with one label significantly more often than
with the other, by the likelihood ratio over all texts of the sample, are kept. Long texts
thus do not drown in the weights of terms that say nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm import exchange as X
from cellgauge.llm.store import written
from cellgauge.llm.terms import Bag, bag_of, by_bucket, split_terms, task_count
from cellgauge.llm.text import buffers, one_array

#: Bytes of word beginnings and of inner n-grams.
HEADS, INNER = (3, 4, 5, 6, 7, 8), (5,)
#: Least likelihood ratio of a kept term, and least number of texts.
LEAST_RATIO, LEAST_TEXTS = 20.0, 4
#: Bits of a packed count: texts below, toxic texts above.
BITS = 31
#: Bytes of texts whose terms a task expands at once.
CHUNK_BYTES = 3 << 20


class Machine(NamedTuple):
    """Sorted hashes of kept terms, bias, weight per term, factors per term (terms x rank)."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def remainder(id_col: str, divisor: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def _gram_hashes(data: np.ndarray, starts: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Hashes of `size` bytes from each start; `kind` keeps beginnings and inner ones apart."""
    out = np.full(len(starts), kind * 0x9E3779B97F4A7C15 % (1 << 64), dtype=np.uint64)
    for k in range(size):
        out = (out ^ data[starts + k]) * np.uint64(0x100000001B3)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def word_terms(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of word number and hashed term, for all terms of distinct words."""
    data, offsets = buffers(words)
    begin, size = offsets[:-1], np.diff(offsets)
    whole = pd.util.hash_array(words.to_numpy(zero_copy_only=False)).astype(np.uint64)
    every = [np.arange(len(words))]
    hashes = [whole]
    for k in HEADS:
        long = np.flatnonzero(size > k)
        every.append(long)
        hashes.append(_gram_hashes(data, begin[long], k, 2))
    for k in INNER:
        count = np.maximum(size - k, 0)
        owner = np.repeat(np.arange(len(words)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        every.append(owner)
        hashes.append(_gram_hashes(data, begin[owner] + place, k, 3))
    return np.concatenate(every), np.concatenate(hashes).view(np.int64)


def _pairs(bag: Bag, word: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of text and term from the pairs of text and word, in order of the texts."""
    if not len(word):
        return np.empty(0, np.int64), term[:0]
    names, code = np.unique(term, return_inverse=True)
    order = np.argsort(word, kind="stable")
    word, code = word[order], code[order]
    first = np.searchsorted(word, np.arange(len(bag.words) + 1))
    count = np.diff(first)[bag.code]
    key = np.repeat(first[bag.code] - np.cumsum(count) + count, count)
    key += np.arange(len(key))
    key = np.unique(code[key] + np.repeat(bag.doc * len(names), count))
    return key // len(names), names[key % len(names)]


def kept_features(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of text and number of a kept term that it holds, each once, in order of the texts."""
    bag = bag_of(texts, split_terms)
    word, term = word_terms(bag.words)
    if not len(terms) or not len(word):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    where = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
    known = terms[where] == term
    return _pairs(bag, word[known], where[known])


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, fit_docs: int, id_col: str, text_col: str,
             label_col: str) -> DataFrame:
    """The sample (h, text, toxic): labelled texts that may be learnt from, each distinct text once.

    At most about `fit_docs` ids, those of the lowest hashes; so the join broadcasts a table
    of a known size. A doubly labelled id or text is toxic if one of its labels says so.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where(F.col("id").isNotNull() & F.col("toxic").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.where(learn)
    n = known.count()
    if n > fit_docs:
        share = int(2**31 * (fit_docs - 4 * fit_docs**0.5) / n)
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(2**31)) < share)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    sample = texts.join(F.broadcast(known), "id").groupBy(F.xxhash64("text").alias("h")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic")
    )
    return written(sample, "toxic-sample")


def _presence(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in enumerate(X.doc_chunks(batches, CHUNK_BYTES)):
            bag = bag_of(one_array(table["text"]), split_terms)
            if not len(bag.words):
                continue
            doc, term = _pairs(bag, *word_terms(bag.words))
            toxic = one_array(table["toxic"]).to_numpy().astype(np.int64)[doc]
            names, code = np.unique(term, return_inverse=True)
            uses = np.bincount(code, weights=toxic).astype(np.int64) << BITS
            uses += np.bincount(code)
            yield X.bucket_rows(X.chunk_id(chunk), pa.array(names), uses, X.key_buckets(pa.array(names), buckets))

    return run


def _ratio(toxic: np.ndarray, texts: np.ndarray, all_toxic: int, every: int) -> np.ndarray:
    """Likelihood ratio statistic of a term's presence and the label."""
    table = np.stack([toxic, texts - toxic, all_toxic - toxic, every - all_toxic - texts + toxic]).astype(float)
    rows = np.stack([texts, texts, every - texts, every - texts]) / every
    columns = np.array([all_toxic, every - all_toxic] * 2)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(table > 0, table * np.log(table / (rows * columns)), 0).sum(axis=0)


def screened_terms(
    sample: DataFrame, every: int, all_toxic: int, max_terms: int,
    least_ratio: float = LEAST_RATIO, least_texts: int = LEAST_TEXTS,
) -> np.ndarray:
    """Sorted hashes of the terms that tell the labels apart, the `max_terms` clearest at most."""
    tasks = task_count(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        X.lean_memory()
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        coded = pa.concat_arrays(X.unpack_keys(table["keys"])).dictionary_encode()
        uses = pa.concat_arrays(X.unpack_all(table["uses"])).to_numpy()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, coded.indices.to_numpy(), uses)
        toxic, texts = total >> BITS, total & ((1 << BITS) - 1)
        ratio = _ratio(toxic, texts, all_toxic, every)
        keep = (ratio >= least_ratio) & (texts >= least_texts)
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.filter(pa.array(keep)), pa.array(ratio[keep])], ["term", "ratio"]
        )

    counted = X.dealt(sample.mapInArrow(_presence(tasks), X.BUCKET_SCHEMA), tasks)
    found = counted.mapInArrow(run, "term long, ratio double")
    best = found.orderBy(F.desc("ratio"), "term").limit(max_terms).toArrow()
    return np.sort(best["term"].to_numpy())


def margins(model: Machine, doc: np.ndarray, feature: np.ndarray, texts: int) -> np.ndarray:
    """Log-odds of texts from their pairs of text and kept term; `doc` is sorted."""
    held = model.factors[feature]
    total = by_text(doc, held, texts)
    squares = np.bincount(doc, weights=(held**2).sum(axis=1), minlength=texts)
    linear = np.bincount(doc, weights=model.weights[feature], minlength=texts)
    return model.bias + linear + ((total**2).sum(axis=1) - squares) / 2


def by_text(doc: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    """Sums of the rows of each text; `doc` is sorted."""
    total = np.zeros((texts, values.shape[1]))
    if len(doc):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        total[doc[first]] = np.add.reduceat(values, first, axis=0)
    return total


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def gradients(model: Machine, doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Gradients of the mean log loss by bias, weights and factors."""
    error = (probability(margins(model, doc, feature, len(toxic))) - toxic) / len(toxic)
    held = model.factors[feature]
    slope = error[doc, None] * (by_text(doc, held, len(toxic))[doc] - held)
    size = len(model.weights)
    weights = np.bincount(feature, weights=error[doc], minlength=size)
    factors = np.stack([np.bincount(feature, weights=s, minlength=size) for s in slope.T], axis=1)
    return float(error.sum()), weights, factors


def trained(terms: np.ndarray, doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray, rank: int = 8,
            epochs: int = 20, batch: int = 512, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Fit by Adam on batches in seeded order; `doc` is sorted. Without both labels only the bias speaks."""
    n, draw = len(toxic), np.random.default_rng(seed)
    positive = float(toxic.sum())
    bias = np.log((positive + 0.5) / (n - positive + 0.5)) if positive else -500.0
    if not positive or positive == n or not len(terms):
        return Machine(terms, bias, np.zeros(len(terms)), np.zeros((len(terms), rank)))
    values = [np.array([bias]), np.zeros(len(terms)), draw.normal(0, 0.1, (len(terms), rank))]
    first, second = ([np.zeros_like(v) for v in values] for _ in range(2))
    begins = np.searchsorted(doc, np.arange(n + 1))
    step = 0
    for epoch in range(epochs):
        order = draw.permutation(n)
        pace = rate * (1 - epoch / epochs)
        for a in range(0, n, batch):
            rows = order[a : a + batch]
            count = np.diff(begins)[rows]
            at = np.repeat(begins[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
            model = Machine(terms, values[0][0], values[1], values[2])
            slope = gradients(model, np.repeat(np.arange(len(rows)), count), feature[at], toxic[rows])
            step += 1
            for k, g in enumerate((np.array([slope[0]]), slope[1], slope[2])):
                g = g + (decay * values[k] if k else 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                moved = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                values[k] = values[k] - pace * moved
    return Machine(terms, float(values[0][0]), values[1], values[2])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, fit_docs: int = 50_000,
        max_terms: int = 2048, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Train a machine on labelled texts.

    `learn` says which ids (column `id`) may be learnt from. The sample is bounded by
    `fit_docs` texts and the machine by `max_terms` terms; with both, what reaches the
    driver is at most `fit_docs` lists of term numbers. No labels, or none that are toxic,
    give a machine that scores every text 0 or as the share of toxic ones.
    """
    sample = labelled(docs, labels, F.lit(True) if learn is None else learn, fit_docs, id_col, text_col, label_col)
    every, all_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    terms = screened_terms(sample, every, all_toxic, max_terms) if 0 < all_toxic < every else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in X.doc_chunks(batches, CHUNK_BYTES):
            doc, feature = kept_features(one_array(table["text"]), terms)
            at = np.searchsorted(doc, np.arange(len(table) + 1))
            held = X.list_array(at, pa.array(feature, pa.int32()))
            yield pa.RecordBatch.from_arrays([one_array(table["h"]), one_array(table["toxic"]), held], ["h", "toxic", "terms"])

    rows = sample.mapInArrow(run, "h long, toxic int, terms array<int>").toArrow().sort_by("h")
    lists = one_array(rows["terms"])
    count = lists.value_lengths().to_numpy().astype(np.int64) if len(lists) else np.empty(0, np.int64)
    feature = lists.flatten().to_numpy().astype(np.int64) if len(lists) else np.empty(0, np.int64)
    return trained(terms, np.repeat(np.arange(len(count)), count), feature, rows["toxic"].to_numpy().astype(float))


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and `score` (0 to 1) of every row; whole texts; a null or empty text gets the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in X.doc_chunks(batches, CHUNK_BYTES):
            doc, feature = kept_features(one_array(table["text"]), shared.value.terms)
            found = probability(margins(shared.value, doc, feature, len(table)))
            yield pa.RecordBatch.from_arrays([one_array(table["id"]), pa.array(found)], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def predictions(docs: DataFrame, labels: DataFrame, fit_docs: int = 50_000) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted.

    Learnt from labels whose id's crc32 modulo 5 is not 0. Texts are the only input of a
    score. A null id is not held out and never learnt from; a null text scores as an empty
    one; repeated rows stay; an empty table gives no rows. Other columns are not read.
    """
    model = fit(docs, labels, remainder("id", 5) != 0, fit_docs)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
