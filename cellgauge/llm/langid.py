"""Language identification by interpolated Kneser-Ney character models.

One model per language: per order a sorted array of n-gram hashes with their interpolated
probabilities and a sorted array of context hashes with their back-off weights. A text
goes to the language of the lowest cross-entropy per character; it is rejected if that is
higher than nearly all texts of the language reach (calibrated on labelled texts that the
counts do not hold).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.store import free_name, written
from cellgauge.llm.text import LETTER, blocks, char_classes, one_array

ORDER = 4
#: Labelled texts per language that the models are fitted on: the bound of the sample.
FIT_DOCS = 3000
#: One of so many sampled texts calibrates the rejection instead of being counted.
CALIBRATE = 5
UNDETERMINED = "und"
#: Characters beyond the fitted alphabet share one of these.
ALPHABET = 0x110000
BLOCK = 1 << 20
LONG_TEXT = 400
#: A text is accepted if it strays no farther than this share of the calibration texts.
ACCEPTED = 0.995


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts with one blank after each run of them.

    Returns the code points, the text each belongs to, and the number per text.
    """
    texts = [(t or "").lower() for t in column.to_pylist()]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    letter = char_classes()[raw] == LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])
    doc = doc[keep]
    return np.where(letter, raw, 0x20)[keep], doc, np.bincount(doc, minlength=len(texts))


def windows(codes: np.ndarray, doc: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """The last `order` characters at each position; blanks stand before a text."""
    place = np.arange(len(codes)) - (np.cumsum(counts) - counts)[doc]
    out = np.full((order, len(codes)), 0x20, dtype=np.uint32)
    for back in range(min(order, len(codes))):
        row = out[order - 1 - back]
        row[back:] = np.where(place[back:] >= back, codes[: len(codes) - back], 0x20)
    return out


def gram_hash(chars: np.ndarray) -> np.ndarray:
    """64-bit hash of each column of characters; the number of rows takes part."""
    h = np.full(chars.shape[1], len(chars) + 1, dtype=np.uint64)
    for row in chars:
        h = (h ^ row.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


@dataclass
class CharModel:
    """Sorted hash arrays of one language."""

    grams: list[tuple[np.ndarray, np.ndarray]]  # per order: hashes, probabilities
    contexts: list[tuple[np.ndarray, np.ndarray]]  # per order: hashes, back-off weights
    mean: float = 0.0
    limit: float = -np.inf  # a language that no text calibrates accepts none

    def probability(self, chars: np.ndarray) -> np.ndarray:
        """Of the last character in each column, given those before it."""
        todo = np.arange(chars.shape[1])
        weight = np.ones(len(todo))
        out = np.zeros(len(todo))
        for order in range(len(chars), 0, -1):
            held = chars[len(chars) - order :, todo]
            found, value = _find(self.grams[order - 1], gram_hash(held))
            out[todo[found]] = weight[todo[found]] * value[found]
            known, back = _find(self.contexts[order - 1], gram_hash(held[:-1]))
            weight[todo[known]] *= back[known]
            todo = todo[~found]
        out[todo] = weight[todo] / ALPHABET
        return out

    def accepts(self, entropy: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.strangeness(entropy, counts) <= self.limit

    def strangeness(self, entropy: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (entropy - self.mean) * np.sqrt(np.minimum(counts, LONG_TEXT))


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, values = table
    if not len(hashes):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
    at = np.searchsorted(hashes, keys)
    at[at == len(hashes)] = 0
    return hashes[at] == keys, values[at]


def _sorted(hashes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    return hashes[order], values[order]


def kneser_ney(chars: np.ndarray, counts: np.ndarray) -> CharModel:
    """Fit from the distinct n-grams of the highest order (one per column) and their counts.

    Lower orders count in how many ways a gram is continued to the left. The discount of
    an order is n1 / (n1 + 2 n2).
    """
    levels = []
    for order in range(len(chars), 0, -1):
        levels.append((chars, gram_hash(chars), counts))
        if order > 1:
            short = gram_hash(chars[1:])
            _, first, n = np.unique(short, return_index=True, return_counts=True)
            chars, counts = chars[1:, first], n
    grams, contexts = [], []
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for chars, hashes, counts in reversed(levels):
        one, two = (counts == 1).sum(), (counts == 2).sum()
        discount = one / (one + 2 * two) if one and two else 0.5
        context, code = np.unique(gram_hash(chars[:-1]), return_inverse=True)
        total = np.bincount(code, weights=counts)
        back = discount * np.bincount(code) / total
        if lower is None:
            rest = np.full(len(counts), 1 / ALPHABET)
        else:
            rest = _find(lower, gram_hash(chars[1:]))[1]
        value = (counts - discount) / total[code] + back[code] * rest
        lower = _sorted(hashes, value)
        grams.append(lower)
        contexts.append(_sorted(context, back))
    return CharModel(grams, contexts)


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch["lang"].dictionary_encode()
            texts, codes = one_array(batch["text"]), languages.indices.to_numpy()
            for begin, end in blocks(texts, BLOCK):
                chars, doc, counts = characters(texts.slice(begin, end - begin))
                held = windows(chars, doc, counts, order)
                lang = codes[begin:end][doc]
                key = gram_hash(np.vstack([held, lang.astype(np.uint32)]))
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                text = np.ascontiguousarray(held[:, first].T).tobytes().decode("utf-32-le")
                grams = [text[i : i + order] for i in range(0, len(text), order)]
                yield pa.RecordBatch.from_arrays(
                    [
                        languages.dictionary.take(pa.array(lang[first])),
                        pa.array(grams, pa.string()),
                        pa.array(n, pa.int64()),
                    ],
                    ["lang", "gram", "n"],
                )

    return run


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo a number; null ids have none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = ORDER,
    fit_docs: int = FIT_DOCS,
    usable: Column | None = None,
) -> dict[str, CharModel]:
    """Models by language, from about `fit_docs` labelled texts each, chosen by a hash of the id.

    Rows with a null id, text or language teach nothing. No labelled rows give no model:
    every text is then undetermined. The models are as large as the sample at most.
    """
    rows = docs.where(usable) if usable is not None else docs
    rows = rows.select(
        F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), id_col
    ).dropna()
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    scale = 1 << 30
    chosen = F.lit(False)
    for lang, n in sizes.items():
        share = min(scale, -(-scale * fit_docs // n))
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod("h", F.lit(scale)) < share))
    held = F.pmod(F.shiftright("h", 32), F.lit(CALIBRATE)) == 0
    sample = written(rows.where(chosen).select("text", "lang", held.alias("held")), "langid")
    counted = sample.where("not held").mapInArrow(_count_grams(order), "lang string, gram string, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    models = {}
    for lang, part in table.groupby("lang"):
        text = "".join(part["gram"])
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, order).T
        models[lang] = kneser_ney(np.ascontiguousarray(chars), part["n"].to_numpy())
    _calibrate(models, sample.where("held"))
    return models


def _calibrate(models: dict[str, CharModel], held: DataFrame) -> None:
    """Mean entropy of each language's own texts, and how far all but a few stray from it.

    A text that another model, or chance over all characters, explains better than its
    label's model is mislabelled or junk and calibrates nothing. A language without any
    calibration text keeps its limit, by which it accepts none.
    """
    if not models:
        return
    names = sorted(models)
    shared = held.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            entropy, counts = entropies(one_array(batch["text"]), shared.value)
            own = np.array([names.index(x) if x in models else -1 for x in batch["lang"].to_pylist()])
            low = entropy.argmin(axis=0)
            ok = (own == low) & (counts > 0) & (entropy.min(axis=0) < np.log2(ALPHABET))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(names, dtype=object)[own[ok]], pa.string()),
                    pa.array(entropy[own[ok], np.flatnonzero(ok)]),
                    pa.array(counts[ok]),
                ],
                ["lang", "entropy", "n"],
            )

    found = held.mapInArrow(run, "lang string, entropy double, n long").toPandas()
    for lang, part in found.groupby("lang"):
        model, n = models[lang], part["n"].to_numpy()
        model.mean = float(np.average(part["entropy"], weights=np.minimum(n, LONG_TEXT)))
        model.limit = float(np.quantile(model.strangeness(part["entropy"].to_numpy(), n), ACCEPTED))


def entropies(column: pa.Array, models: dict[str, CharModel]) -> tuple[np.ndarray, np.ndarray]:
    """Bits per character under each language (a row each), and characters, of every text."""
    order = max(len(m.grams) for m in models.values())
    out, sizes = [np.empty((len(models), 0))], [np.empty(0, np.int64)]
    for begin, end in blocks(column, BLOCK):
        chars, doc, counts = characters(column.slice(begin, end - begin))
        held = windows(chars, doc, counts, order)
        # Every distinct window of the block is worked out once.
        code, distinct = pd.factorize(gram_hash(held))
        first = np.empty(len(distinct), dtype=np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        part = np.zeros((len(models), len(counts)))
        for i, lang in enumerate(sorted(models)):
            bits = -np.log2(models[lang].probability(held[:, first]))
            part[i] = np.bincount(doc, weights=bits[code], minlength=len(counts)) / np.maximum(counts, 1)
        out.append(part)
        sizes.append(counts)
    return np.concatenate(out, axis=1), np.concatenate(sizes)


def with_language(
    docs: DataFrame, models: dict[str, CharModel], text_col: str = "text", name: str = "found"
) -> DataFrame:
    """Add a struct `name`: lang_pred, score, accepted.

    The score is the probability of the language by the texts' entropies, as for a text
    of at most 20 characters. Null texts and those without a letter are undetermined,
    with score 0 and not accepted; so is every text if there are no models. A language
    that no held-out text calibrated accepts none.
    """
    languages = np.array([*sorted(models), UNDETERMINED], dtype=object)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            best = np.full(len(batch), len(models))
            score = np.zeros(len(batch))
            accepted = np.zeros(len(batch), dtype=bool)
            if models and len(batch):
                entropy, counts = entropies(one_array(batch[text_col]), models)
                low = entropy.argmin(axis=0)
                lead = (entropy - entropy.min(axis=0)) * np.minimum(counts, 20)
                share = 1 / np.exp2(-lead).sum(axis=0)
                some = counts > 0
                best[some], score[some] = low[some], share[some]
                for i, lang in enumerate(sorted(models)):
                    accepted |= some & (low == i) & models[lang].accepts(entropy[i], counts)
            found = pa.StructArray.from_arrays(
                [pa.array(languages[best], pa.string()), pa.array(score), pa.array(accepted)],
                ["lang_pred", "score", "accepted"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    struct = f"`{name}` struct<lang_pred:string,score:double,accepted:boolean>"
    return docs.mapInArrow(run, ", ".join([*fields, struct]))


def predictions(docs: DataFrame, held_out: int = 2, divisor: int = 4) -> DataFrame:
    """Language of every document; those with the remainder `held_out` teach nothing."""
    rest = remainder("doc_id", divisor)
    models = fit(docs, usable=rest != held_out)
    rows = with_language(docs.select("doc_id", "text"), models)
    return rows.select(
        "doc_id", F.coalesce(rest == held_out, F.lit(False)).alias("held_out"), "found.*"
    )


def accepted_documents(docs: DataFrame, held_out: int = 2, divisor: int = 4) -> DataFrame:
    """Rows of `docs` whose language is accepted, with their own columns."""
    models = fit(docs, usable=remainder("doc_id", divisor) != held_out)
    name = free_name(docs, "found")
    return with_language(docs, models, name=name).where(F.col(name)["accepted"]).drop(name)
