"""Column split, row split by location, and train/test splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions import texts
from cellgauge.functions.columns import HASH_RANGE, hash32
from cellgauge.functions.joins import attach
from cellgauge.operators.ranks import kth_smallest
from cellgauge.sources import schema as S

SEGMENT, SPLIT = "segment", "split"
TRAIN, TEST = "train", "test"
#: Ranges of key hashes whose fingerprints are compared before keys are.
KEY_RANGES = 4_096


def vertical_split(
    df: DataFrame, include_target: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The infrastructure columns and the user columns, both with the key."""
    S.require_columns(df, [S.KEY, *S.INFRASTRUCTURE_FEATURES, *S.USER_FEATURES])
    target = [S.LATENCY] if include_target and S.LATENCY in df.columns else []
    return (
        df.select(S.KEY, *S.INFRASTRUCTURE_FEATURES, *target),
        df.select(S.KEY, *S.USER_FEATURES, *target),
    )


def vertical_check(
    infra: DataFrame, user: DataFrame, key: str = S.KEY, ranges: int = KEY_RANGES
) -> DataFrame:
    """Row counts, keys that differ as multisets, shared features; `is_valid` sums up.

    Keys are dealt into ranges of a hash. A range in which both sides have the same number
    of rows and the same sum of 64-bit key hashes holds the same keys (but for a chance of
    2^-64), so only keys of other ranges are shuffled and compared one by one.
    """
    shared = sorted((set(infra.columns) & set(user.columns)) - {key, S.LATENCY})
    missing = S.missing_columns(infra, S.INFRASTRUCTURE_FEATURES) + S.missing_columns(
        user, S.USER_FEATURES
    )
    sides = infra.select(key, F.lit(1).alias("_side")).unionAll(
        user.select(key, F.lit(-1).alias("_side"))
    )
    rows, differing = _differing_ranges(sides, key, ranges)
    if differing:
        own = sides.filter(_key_range(key, ranges).isin(differing))
        per_key = own.groupBy(key).agg(F.sum("_side").alias("_more"))
        keys = per_key.agg(F.count_if(F.col("_more") != 0).alias("keys_differing"))
    else:
        keys = infra.sparkSession.range(1).select(F.lit(0).cast("long").alias("keys_differing"))
    checked = keys.select(
        F.lit(rows[0]).cast("long").alias("rows_infra"),
        F.lit(rows[1]).cast("long").alias("rows_user"),
        "keys_differing",
        F.lit(len(shared)).alias("shared_features"),
    )
    valid = (
        (F.col("rows_infra") == F.col("rows_user"))
        & (F.col("keys_differing") == 0)
        & F.lit(not shared and not missing)
    )
    return checked.withColumn("is_valid", valid)


def _key_range(key: str, ranges: int) -> Column:
    return F.pmod(F.hash(key), F.lit(ranges))


def _differing_ranges(sides: DataFrame, key: str, ranges: int) -> tuple[tuple[int, int], list[int]]:
    """Rows of both sides, and the ranges whose fingerprints differ.

    One row per range reaches the driver. The hash is summed in halves, which no number
    of rows a cluster holds lets overflow.
    """
    whole, side = F.xxhash64(key), F.col("_side")
    low, high = whole.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(whole, 32)
    prints = sides.groupBy(_key_range(key, ranges).alias("range")).agg(
        F.count_if(side > 0).alias("a"),
        F.count_if(side < 0).alias("b"),
        F.sum(side * low).alias("low"),
        F.sum(side * high).alias("high"),
    )
    found = prints.collect()
    rows = sum(r["a"] for r in found), sum(r["b"] for r in found)
    return rows, [r["range"] for r in found if r["a"] != r["b"] or r["low"] or r["high"]]


def needs_location(location: str = S.LOCATION) -> Column:
    """Rows whose location is missing or neither Urban nor Rural."""
    return F.coalesce(~F.col(location).isin(texts.KNOWN_LOCATIONS), F.lit(True))


def horizontal_segment(location: str = S.LOCATION) -> Column:
    """Segment of a row: its location, else busy towers with good signal are urban."""
    busy = (F.col(S.USERS) > 50) & (F.col(S.SIGNAL) > -85)
    return (
        F.when(~needs_location(location), F.col(location))
        .when(busy, F.lit(texts.URBAN))
        .otherwise(F.lit(texts.RURAL))
    )


def horizontal_split(df: DataFrame) -> DataFrame:
    """Mark every row with its segment: one projection, filter on demand."""
    S.require_columns(df, [S.LOCATION])
    return df.withColumn(SEGMENT, horizontal_segment())


def segment_rows(df: DataFrame, segment: str) -> DataFrame:
    return df.filter(F.col(SEGMENT) == segment)


def segment_union(df: DataFrame) -> DataFrame:
    """Rows of both segments put back together, with the rows added by the rule marked."""
    return horizontal_split(df).withColumn("was_assigned", needs_location())


def location_score() -> Column:
    """Urban points of a tower: users, signal, traffic. A missing value gives none."""
    users, signal, traffic = F.col(S.USERS), F.col(S.SIGNAL), F.col(S.TRAFFIC)
    return (
        F.when(users > 40, 2).when(users > 25, 1).otherwise(0)
        + F.when(signal > -80, 2).when(signal > -90, 1).otherwise(0)
        + F.when(traffic > 200, 1).otherwise(0)
    )


def location_heuristic(df: DataFrame) -> DataFrame:
    """Settle unknown locations by score: three points or more are urban."""
    guess = F.when(location_score() >= 3, texts.URBAN).otherwise(texts.RURAL)
    return df.withColumn(
        S.LOCATION, F.when(needs_location(), guess).otherwise(F.col(S.LOCATION))
    )


def location_scores(df: DataFrame) -> DataFrame:
    """Rows that need a location, by score."""
    return (
        df.filter(needs_location())
        .groupBy(location_score().alias("score"))
        .agg(F.count("*").alias("n"))
    )


def heuristic_summary(df: DataFrame) -> DataFrame:
    """Rows that need a location and how the score assigns them."""
    needs, urban = needs_location(), location_score() >= 3
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(needs).alias("n_needed"),
        F.count_if(needs & urban).alias("assigned_urban"),
        F.count_if(needs & ~urban).alias("assigned_rural"),
    )


def horizontal_check(
    split: DataFrame, original: DataFrame, key: str = S.KEY, least: int = 5, by: Sequence[str] = ()
) -> DataFrame:
    """Rows add up, no key lies in two segments, none is lost; small segments warn.

    With `by` (the side of the split) every group is held against its own rows before.
    """
    def side(df: DataFrame, origin: int, urban: Column, rural: Column) -> DataFrame:
        return df.select(
            *by,
            key,
            F.lit(origin).alias("_o"),
            urban.cast("int").alias("_u"),
            rural.cast("int").alias("_r"),
        )

    none = F.lit(False)
    sides = side(original, 1, none, none).unionAll(
        side(
            split,
            0,
            F.col(SEGMENT) == texts.URBAN,
            F.col(SEGMENT) == texts.RURAL,
        )
    )
    per_key = sides.groupBy(*by, key).agg(*[F.sum(c).alias(c) for c in ("_o", "_u", "_r")])
    o, u, r = F.col("_o"), F.col("_u"), F.col("_r")
    checked = per_key.groupBy(*by).agg(
        F.coalesce(F.sum(o), F.lit(0)).alias("rows_original"),
        F.coalesce(F.sum(u), F.lit(0)).alias("rows_urban"),
        F.coalesce(F.sum(r), F.lit(0)).alias("rows_rural"),
        F.count_if((u > 0) & (r > 0)).alias("keys_in_both"),
        F.count_if((o > 0) & (u + r == 0)).alias("keys_lost"),
    )
    total = F.col("rows_urban") + F.col("rows_rural")
    return checked.withColumns(
        {
            "is_valid": (total == F.col("rows_original"))
            & (F.col("keys_in_both") == 0)
            & (F.col("keys_lost") == 0),
            "small_segment": (F.col("rows_urban") < least) | (F.col("rows_rural") < least),
        }
    )


def segment_overlap(split: DataFrame, key: str = S.KEY) -> DataFrame:
    """Keys that lie in more than one segment, with their rows in each."""
    urban = F.count_if(F.col(SEGMENT) == texts.URBAN)
    rural = F.count_if(F.col(SEGMENT) == texts.RURAL)
    return (
        split.groupBy(key)
        .agg(urban.alias("n_urban"), rural.alias("n_rural"))
        .filter((F.col("n_urban") > 0) & (F.col("n_rural") > 0))
    )


def train_test_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = S.KEY
) -> DataFrame:
    """Mark rows by a hash threshold on the key: no shuffle, equal on every rerun.

    Rows of one key stay on one side. The test share is `test_size` up to chance.
    """
    cut = math.floor(test_size * HASH_RANGE)
    side = F.when(hash32(key, seed) < cut, TEST).otherwise(TRAIN)
    return df.withColumn(SPLIT, side)


def stratified_split(
    df: DataFrame,
    by: str = S.LOCATION,
    test_size: float = 0.2,
    seed: int = 42,
    key: str = S.KEY,
) -> DataFrame:
    """Cut each stratum at its own ceil(test_size * n)-th smallest hash.

    With unique keys the test side has exactly that many rows per stratum; rows of
    one key in a stratum stay together.
    """
    hashed = df.withColumn("_h", hash32(key, seed))
    cuts = kth_smallest(hashed.select(by, "_h"), "_h", test_size, by, "_cut")
    side = F.when(F.col("_h") <= F.col("_cut"), TEST).otherwise(TRAIN)
    return attach(hashed, cuts, [by]).withColumn(SPLIT, side).drop("_h", "_cut")


def exact_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = S.KEY
) -> DataFrame:
    """As `stratified_split` with the whole table as one stratum."""
    whole = df.withColumn("_all", F.lit(0))
    return stratified_split(whole, "_all", test_size, seed, key).drop("_all")


def model_inputs(
    df: DataFrame, exclude: Sequence[str] = (S.KEY, S.LATENCY)
) -> DataFrame:
    return df.drop(*exclude)


def location_rows(df: DataFrame, location: str) -> DataFrame:
    return df.filter(F.col(S.LOCATION) == location)
