"""Interleaving against a plain sort: every shard and slot."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cellgauge.llm import shards


def brute(rows, count):
    """rows: (id, size, crc, stratum, hash of the row, hash of the stratum); shard and slot of each."""
    strata = defaultdict(list)
    for row in rows:
        strata[row[3]].append(row)
    placed = []
    for name, held in strata.items():
        held.sort(key=lambda r: (r[4], r[0] is not None, r[0] or 0, r[2], r[1]))
        for rank, row in enumerate(held):
            place = (rank + row[5] / float(1 << shards.HASH_BITS)) / len(held)
            placed.append((place, name.encode(), rank, row))
    placed.sort(key=lambda x: x[:3])
    out, n = [], len(rows)
    for g, (*_, row) in enumerate(placed):
        shard = g * count // n
        out.append((row[0], row[1], row[2], shard, g - -(-shard * n // count)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_rows", [7, 2000])
def test_every_shard_and_slot_is_that_of_a_plain_sort(spark, monkeypatch, bucket_rows):
    """A source with a third of all rows, sources of one row, copies, null ids, texts and sources."""
    monkeypatch.setattr(shards, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(shards, "STRETCH", 5)
    draw = random.Random(9)
    docs = [(i, f"text {draw.randrange(40)} é", "hot" if i % 3 == 0 else f"s{draw.randrange(5)}") for i in range(500)]
    docs += [(None, "no id", "hot"), (None, None, None), (7, "text", None), (8, "", ""), (8, "", ""), (900, "x", "lone")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    stratum = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    keyed = df.select("doc_id", (F.octet_length(text) + 8).cast("long"), F.crc32(text).alias("c"), stratum.alias("s"))
    keyed = keyed.select("*", shards.seeded(42, F.col("doc_id"), F.col("c")), shards.seeded(42, F.col("s")))
    rows = [tuple(r) for r in keyed.collect()]
    for count in (24, 5):
        got = shards.interleave(df, count).select("doc_id", "size", "text_crc32", "shard", "slot")
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, count)
