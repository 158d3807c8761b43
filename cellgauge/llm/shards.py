"""Proportional stratified interleaving of rows into shards, in DataFrame functions alone.

Rows of a stratum are shuffled by a seeded hash and ranked. The rank as a fraction of the
stratum places the row in the whole order, in which every stretch then has the mixture of
the whole; shards are equal stretches. Ranks are taken within buckets of the hash, whose
counts give the ranks before them, so no stratum meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.llm.store import written

#: Rows that a bucket of an ordering holds on average.
BUCKET_ROWS = 2_000
#: Buckets whose counts are added up in one window.
STRETCH = 1_000
HASH_BITS = 60


def seeded(seed: int, *parts: Column) -> Column:
    """60-bit hash of the parts as text, with a seed; null counts as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _rank(rows: DataFrame, keys: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Position from 1 within `keys`, by `bucket` and then `order`."""
    stretch = F.floor(F.col(bucket) / STRETCH).alias("_k")
    counts = written(rows.groupBy(*keys, bucket).agg(F.count("*").alias("_n")).select("*", stretch), "counts")
    # Two levels: stretches of buckets are added up first, then the buckets within each.
    whole = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_k")
    bases = counts.groupBy(*keys, "_k").agg(F.sum("_n").alias("_in"))
    bases = bases.withColumn("_base", F.sum("_in").over(whole) - F.col("_in")).drop("_in")
    before = Window.partitionBy(*keys, "_k").orderBy(bucket)
    starts = counts.withColumn("_at", F.sum("_n").over(before) - F.col("_n")).join(bases, [*keys, "_k"])
    starts = written(starts.select(*keys, bucket, (F.col("_at") + F.col("_base")).alias("_at")), "ranks")
    own = Window.partitionBy(*keys, bucket).orderBy(*order)
    return rows.join(starts, [*keys, bucket]).withColumn(name, F.col("_at") + F.row_number().over(own)).drop("_at")


def interleave(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
) -> DataFrame:
    """One row per row of `docs`: id, size, text_crc32, shard, slot.

    Shards differ by one row at most, and in each stratum's share by its rounding. A null
    stratum is a stratum; null texts have no bytes; null ids are shuffled by their text.
    Equal rows are interchangeable, so repeated rows keep a defined result. No rows give
    none. Other columns are not read.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        stratum.alias("_s"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = written(rows.withColumn("_h", seeded(seed, F.col("_id"), F.col("text_crc32"))), "rows")
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    width = -(-(1 << HASH_BITS) // buckets)
    rows = rows.withColumn("_b", F.floor(F.col("_h") / F.lit(width)).cast("long"))
    tie = ["_h", "_id", "text_crc32", "size"]
    ranked = written(_rank(rows, ["_s"], "_b", tie, "_r").drop("_b"), "ranked")
    sizes = written(ranked.groupBy("_s").agg(F.count("*").alias("_n")), "strata")
    # Each stratum begins at its own place, so that many small ones do not all fall together.
    shift = seeded(seed, F.col("_s")).cast("double") / float(1 << HASH_BITS)
    spread = ranked.join(sizes, "_s").withColumn("_f", (F.col("_r") - 1 + shift) / F.col("_n"))
    spread = spread.withColumn("_b", F.floor(F.col("_f") * buckets).cast("long"))
    spread = written(spread.select("_id", "size", "text_crc32", "_s", "_r", "_f", "_b"), "spread")
    placed = _rank(spread, [], "_b", ["_f", "_s", "_r"], "_g").withColumn("_g", F.col("_g") - 1)
    shard = F.expr(f"_g * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    cut = placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_g") - first)
    return cut.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def digests(docs: DataFrame) -> DataFrame:
    """The assignment under the law that shards' row counts differ by one at most."""
    return interleave(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
