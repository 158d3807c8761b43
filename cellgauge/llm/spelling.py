"""Spelling variants: words that differ by one code point, and the form each belongs to.

Words are joined by asymmetric q-chunks. The shorter word of a pair gives two disjoint
chunks, its halves; the longer one gives positional grams of the same lengths, at the places
that a shift of at most one leaves them. One edit keeps one of the halves, so every pair
shares a key. A key shared by many words is split: where one half is equal the edit lies in
the other, which is cut into halves again. Pairs are verified with an edit distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm import exchange as X
from cellgauge.llm.store import written
from cellgauge.llm.terms import bag_of, by_bucket, summed, task_count
from cellgauge.llm.text import byte_words, one_array

#: One in so many occurrences loses a code point.
EVERY = 97
#: Words of at least so many code points and occurrences.
LENGTH, USES = 5, 3
#: Words that share a key before it is split.
DENSE = 128
#: Longest word whose checksum is taken by table.
SHORT = 64

LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def split_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8 0xC3 and one byte), A-Z lower-cased."""
    before = np.append(np.zeros(1, np.uint8), data[:-1])
    other = (data >= 0x80) & (data != 0xC3) & (before != 0xC3)
    return byte_words(np.where(other, np.uint8(0x20), data), offsets, LETTERS)


def _crc_step() -> np.ndarray:
    """What one zero byte makes of the low byte of a checksum."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


def checksums(ids: list[int], doc: np.ndarray, words: list[bytes], code: np.ndarray) -> np.ndarray:
    """crc32 of `<id>:<word>` for pairs of document and word.

    A checksum of joined texts is the first one's, moved on by the second's length in zero
    bytes, xor the second's.
    """
    size = np.array([len(w) for w in words], dtype=np.int64)
    own = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
    step = _crc_step()
    moved = np.empty((SHORT + 1, len(ids)), dtype=np.uint32)
    moved[0] = [zlib.crc32(b"%d:" % i) for i in ids]
    for k in range(SHORT):
        moved[k + 1] = moved[k] >> 8 ^ step[moved[k] & 0xFF]
    out = moved[np.minimum(size, SHORT)[code], doc] ^ own[code]
    for i in np.flatnonzero(size[code] > SHORT):
        out[i] = zlib.crc32(b"%d:" % ids[doc[i]] + words[code[i]])
    return out


def _mutated(ids: list, bag) -> tuple[pa.Array, np.ndarray]:
    """Results of a chunk and how often each occurs, after one in EVERY has lost a code point."""
    words = bag.words.to_pylist()
    doc, code, uses = bag.doc, bag.code, bag.uses
    known = np.array([i is not None for i in ids], dtype=bool)
    named = known[doc] if len(known) else np.zeros(0, bool)
    sums = checksums([i or 0 for i in ids], doc, [w.encode() for w in words], code).astype(np.int64)
    hit = named & (sums % EVERY == 0)
    total = np.bincount(code[~hit], weights=uses[~hit], minlength=len(words)).astype(np.int64)
    length = np.array([len(w) for w in words], dtype=np.int64)
    at = sums[hit] % length[code[hit]]
    width = int(length.max(initial=0)) + 1
    key, n = summed(code[hit] * width + at, uses[hit])
    cut = [words[c][:p] + words[c][p + 1 :] for c, p in zip(key // width, key % width, strict=True)]
    coded = pa.concat_arrays([bag.words, pa.array(cut, pa.string())]).dictionary_encode()
    weight = np.bincount(coded.indices.to_numpy(), weights=np.append(total, n), minlength=len(coded.dictionary))
    keep = (pc.utf8_length(coded.dictionary).to_numpy() >= LENGTH) & (weight > 0)
    return coded.dictionary.filter(pa.array(keep)), weight[keep].astype(np.int64)


def _chunk_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in X.doc_chunks(batches):
            bag = bag_of(one_array(table["text"]), split_runs)
            if not len(bag.words):
                continue
            words, uses = _mutated(table["id"].to_pylist(), bag)
            if not len(words):
                continue
            order, present, ends = by_bucket(words, buckets)
            words, uses = words.take(pa.array(order)), uses[order]
            cut = list(zip(ends, ends[1:], strict=False))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(present, pa.int32()),
                    pa.array([X.pack(words.slice(a, b - a)) for a, b in cut], pa.binary()),
                    pa.array([X.pack(pa.array(uses[a:b])) for a, b in cut], pa.binary()),
                ],
                ["bucket", "words", "uses"],
            )

    return run


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    X.lean_memory()
    batches = [b for b in batches if len(b)]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    coded = pa.concat_arrays(X.unpack_all(table["words"])).dictionary_encode()
    uses = pa.concat_arrays(X.unpack_all(table["uses"])).to_numpy()
    n = np.bincount(coded.indices.to_numpy(), weights=uses, minlength=len(coded.dictionary)).astype(np.int64)
    out = pa.table({"word": coded.dictionary, "n": pa.array(n)}).filter(pa.array(n >= USES))
    yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of at least LENGTH code points and USES occurrences (word, n).

    An occurrence whose checksum with its document's id is divisible by EVERY loses a code
    point; without an id none is lost. Null texts have no words; repeated rows count again.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tasks = task_count(rows)
    chunks = rows.mapInArrow(_chunk_counts(tasks), "bucket int, words binary, uses binary")
    return written(X.dealt(chunks, tasks).mapInArrow(_bucket_counts, "word string, n long"), "word-counts")


#: A row of the join: key, the word (chunk side: short, else long) and what of it is still open.
SIDE = "key long, word string, n long, open string, chunk boolean"


def _keyed(halves: str) -> str:
    """Rows per half of `open`; `size` is the length of the shorter word's open part."""
    return f"""explode(transform(array(0, 1), side -> named_struct(
        'size', size, 'side', side, 'gram', CASE side WHEN 0 THEN left(open, size div 2)
            ELSE right(open, size - size div 2) END,
        'open', CASE side WHEN 0 THEN substring(open, size div 2 + 1)
            ELSE left(open, char_length(open) - (size - size div 2)) END))) AS {halves}"""


def _halved(rows: DataFrame) -> DataFrame:
    """The halves of the open parts: of a chunk row its own, of a gram row those of equal and shorter words.

    A prefix keeps its place, a suffix moves by the difference of the lengths, so of all
    positional grams within a shift of one only these can be a preserved half.
    """
    sized = rows.withColumn("size", F.explode(F.expr(
        "CASE WHEN chunk OR char_length(open) = 0 OR key IS NOT NULL THEN array(size) "
        "ELSE array(char_length(open), char_length(open) - 1) END"
    )))
    cut = sized.selectExpr("key", "word", "n", "chunk", _keyed("h"))
    return cut.selectExpr(
        "xxhash64(key, h.size, h.side, h.gram) AS key", "word", "n", "h.open AS open", "chunk",
        "CASE h.side WHEN 0 THEN h.size - h.size div 2 ELSE h.size div 2 END AS size",
    )


def near_pairs(words: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of words that differ by one inserted, deleted or replaced code point, once each.

    Keys with more than `dense` rows are not joined but halved again, until they are small
    or nothing is left to halve; what remains then differs in that code point alone.
    """
    base = words.selectExpr("CAST(NULL AS long) AS key", "word", "n", "word AS open", "char_length(word) AS size")
    rows = _halved(base.withColumn("chunk", F.lit(True)).union(base.withColumn("chunk", F.lit(False))))
    found = []
    while True:
        rows = written(rows, "chunks")
        sizes = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max("size").alias("longest"))
        hot = written(sizes.where((F.col("rows") > dense) & (F.col("longest") > 1)).select("key"), "hot-chunks")
        found.append(written(_verified(rows.join(hot, "key", "left_anti")), "near-pairs"))
        if hot.isEmpty():
            break
        rows = _halved(rows.join(hot, "key", "left_semi"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["a", "b"])


def _verified(rows: DataFrame) -> DataFrame:
    short = rows.where("chunk").selectExpr("key", "word AS a", "n AS a_n")
    long = rows.where("NOT chunk").selectExpr("key", "word AS b", "n AS b_n")
    order = "char_length(a) < char_length(b) OR char_length(a) = char_length(b) AND a < b"
    return short.join(long, "key").where(order).where("levenshtein(a, b, 1) = 1").select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """The last word that each of (word, form) leads to, by doubling; forms hold no circle."""
    reach = written(forms.selectExpr("word", "form AS root"), "roots")
    while True:
        on = reach.selectExpr("word AS root", "root AS further")
        step = written(reach.join(on, "root", "left").select("word", "root", "further"), "roots")
        if step.where("further IS NOT NULL").isEmpty():
            return reach
        reach = step.selectExpr("word", "coalesce(further, root) AS root")


def variants(words: DataFrame, dense: int = DENSE) -> DataFrame:
    """Per word (word, n): n_near, its form and the form's n, and the root of its forms."""
    pairs = written(near_pairs(words, dense), "near-words")
    both = pairs.selectExpr("a AS word", "b AS other", "b_n AS m").union(pairs.selectExpr("b", "a", "a_n"))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best")
    )
    known = words.join(best, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0) AS n_near",
        "CASE WHEN -best.m >= 2 * n THEN best.other END AS form",
        "CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n",
    )
    known = written(known, "forms")
    ends = roots(known.where("form IS NOT NULL").select("word", "form"))
    out = known.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def groups(docs: DataFrame) -> DataFrame:
    """Spelling variants of all documents.

    Null and empty texts have no words; texts are read whole; repeated rows count again; a
    row without an id loses no code points; ties of forms go to the earlier word in
    code-point order; no words give no rows. Other columns are not read.
    """
    return variants(word_counts(docs))


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::UBIGINT], range(8)::UBIGINT[]),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), once AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
raw AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM once),
summed AS (
  SELECT doc_id, run, k, xor(4294967295::UBIGINT, list_reduce(
    list_concat([4294967295::UBIGINT],
      list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::INT]))) AS h
  FROM raw, bits
), results AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
         ELSE run END AS word, k
  FROM summed
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cuts AS (
  SELECT word, n, i, substr(word, 1, i::INT) AS pre, substr(word, i::INT + 2) AS post
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.pre = b.pre AND a.post = b.post
  WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.pre || a.post = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.pre || a.post = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), walk AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON w.next = f.word
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk w ON f.word = w.word AND w.next IS NULL
"""
