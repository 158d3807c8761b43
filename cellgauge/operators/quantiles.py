"""Exact quantiles without holding a large group in one task.

Spark's `percentile` keeps the distinct values of a group in one map. That is fine
for groups of a known moderate size, so these use it. Larger groups are narrowed, all
of them in the same two passes however many they are: one sketch pass gives bounds
around every wanted rank, one pass counts the rows below the bounds and the values
between them. What lies between is dealt into bins by value, and only the bin with the
wanted rank is put in order. The bounds are a table keyed by group, so the driver holds
none of it. Counts are exact, so the result is exact however good the sketch was.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.functions.joins import attach
from cellgauge.session import checkpointed

GROUP_LIMIT = 500_000
GRID = 1_000
ACCURACY = 10_000
BINS = 4_096
#: Rows that buckets may hold between the bounds, as a share of all; beyond it a sketch gives the bounds.
HELD_SHARE = 0.1


def quantile_name(column: str) -> str:
    return f"q_{column}"


def quantiles(
    df: DataFrame,
    probs: Mapping[str, Sequence[float]],
    by: Sequence[str] = (),
    group_limit: int = GROUP_LIMIT,
    rows: int | None = None,
    bins: int = BINS,
) -> DataFrame:
    """Quantiles with linear interpolation, one row per group.

    Column `q_<c>` is an array with one entry per probability of `probs[c]`, NULL
    when the group has no value. Nulls are ignored. A caller that knows the number of
    rows passes it, which saves counting the groups of a table within the limit. Groups
    of more than `group_limit` rows are narrowed; what is left of one is dealt into
    `bins` parts.
    """
    by = list(by)
    if rows is not None and rows <= group_limit:
        return _builtin(df, probs, by)
    if not by:
        rows = df.count() if rows is None else rows
        return _builtin(df, probs, by) if rows <= group_limit else _narrowed(df, probs, by, bins)
    if group_limit <= 0:
        return _narrowed(df, probs, by, bins)
    sizes = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    large = checkpointed(sizes.filter(F.col("_rows") > group_limit).select(*by))
    if large.isEmpty():
        return _builtin(df, probs, by)
    narrowed = _narrowed(attach(df, large, by, "left_semi"), probs, by, bins)
    return _builtin(attach(df, large, by, "left_anti"), probs, by).unionByName(narrowed)


def approximate_quantiles(
    df: DataFrame,
    probs: Mapping[str, Sequence[float]],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    rows: int | None = None,
) -> DataFrame:
    """Same shape as `quantiles` in one pass, within 1/accuracy of the rank."""
    return df.groupBy(*by).agg(
        *[
            F.percentile_approx(c, list(map(float, ps)), accuracy).alias(quantile_name(c))
            for c, ps in probs.items()
        ]
    )


def equal_shares(df: DataFrame, columns: Sequence[str], shares: int) -> dict[str, list[float]]:
    """The values between `shares` equal shares of each column, of all rows and exact.

    Many ranks are wanted at once, so a row is not compared with each: one pass counts the
    values in buckets, a second deals the values of the buckets that hold a wanted rank into
    bins, and only the bin with the rank is put in order. Nulls and NaN are left out; a column
    without values has no cuts. What reaches the driver is bounded by columns and shares.
    """
    x, spark = F.col("_x"), df.sparkSession
    entries = [F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns)]
    long = df.select(F.inline(F.array(*entries))).where(x.isNotNull() & ~F.isnan(x))
    long = long.withColumn("_b", _bucket(x))
    counts = checkpointed(
        long.groupBy("_c", "_b").agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    )
    sizes = {r["_c"]: r["_n"] for r in counts.groupBy("_c").agg(F.sum("_n").alias("_n")).collect()}
    probs = [i / shares for i in range(1, shares)]
    ranks = sorted({(c, rank) for c, n in sizes.items() for p in probs for rank in rank_pair(n, p)})
    if not ranks:
        return {c: [] for c in columns}
    wanted = F.broadcast(spark.createDataFrame(ranks, "_c int, _r long"))
    holds = (F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_start") + F.col("_n"))
    starts = F.sum("_n").over(Window.partitionBy("_c").orderBy("_b")) - F.col("_n")
    chosen = counts.withColumn("_start", starts).join(wanted, "_c").where(holds).collect()
    found = {(r["_c"], r["_r"]): r["_lo"] for r in chosen if r["_lo"] == r["_hi"]}
    wide = [r for r in chosen if r["_lo"] < r["_hi"]]
    if wide:
        bounds = sorted({(r["_c"], r["_b"], r["_lo"], r["_hi"]) for r in wide})
        table = F.broadcast(spark.createDataFrame(bounds, "_c int, _b int, _lo double, _hi double"))
        held = long.join(table, ["_c", "_b"]).groupBy("_c", "_b", _bin(BINS).alias("_d"), "_x").agg(F.count("*").alias("_n"))
        held = checkpointed(held)
        inside = sorted({(r["_c"], r["_b"], r["_r"], r["_start"]) for r in wide})
        inside = F.broadcast(spark.createDataFrame(inside, "_c int, _b int, _r long, _from long"))
        bins = held.groupBy("_c", "_b", "_d").agg(F.sum("_n").alias("_n"))
        starts = F.sum("_n").over(Window.partitionBy("_c", "_b").orderBy("_d")) - F.col("_n")
        bins = bins.withColumn("_start", starts).join(inside, ["_c", "_b"])
        bins = bins.withColumn("_start", F.col("_start") + F.col("_from")).where(holds).drop("_n", "_from")
        starts = F.sum("_n").over(Window.partitionBy("_c", "_b", "_d", "_r").orderBy("_x")) - F.col("_n")
        values = held.join(F.broadcast(bins), ["_c", "_b", "_d"]).withColumn("_start", F.col("_start") + starts)
        found |= {(r["_c"], r["_r"]): r["_x"] for r in values.where(holds).collect()}
    out = {}
    for i, c in enumerate(columns):
        n = sizes.get(i, 0)
        at = {rank: found[i, rank] for p in probs for rank in rank_pair(n, p)} if n else {}
        out[c] = [interpolated(at, n, p) for p in probs] if n else []
    return out


def _builtin(df: DataFrame, probs: Mapping[str, Sequence[float]], by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        *[
            F.percentile(F.col(c).cast("double"), F.array(*[F.lit(float(p)) for p in ps])).alias(
                quantile_name(c)
            )
            for c, ps in probs.items()
        ]
    )


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    """Zero-based neighbours of the wanted position and the weight of the upper one."""
    position = p * (n - 1)
    low = math.floor(position)
    return low, math.ceil(position), position - low


def rank_pair(n: int, p: float) -> tuple[int, int]:
    """The two ranks (from 0) among n values between which the quantile p lies."""
    return _ranks(n, p)[:2]


def rank_probability(rank: int, n: int) -> float:
    """The probability whose quantile among n values is the value at this rank, up to rounding."""
    return rank / (n - 1) if n > 1 else 0.0


def interpolated(values: Mapping[int, float], n: int, p: float) -> float:
    """The quantile p of n values of which those at its two ranks are given."""
    low, high, weight = _ranks(n, p)
    a, b = values[low], values[high]
    return a if a == b else (1 - weight) * a + weight * b


def _narrowed(
    df: DataFrame, probs: Mapping[str, Sequence[float]], by: list[str], bins: int
) -> DataFrame:
    """Every wanted rank of every group: bounds, counts, one bin in order."""
    targets = [(c, p) for c, ps in probs.items() for p in ps]
    values = df.select(*by, *[F.col(c).cast("double").alias(f"_x_{c}") for c in probs])
    bounds = checkpointed(_bucket_bounds(values, targets, by))
    counted = _within(bounds, targets)
    if not counted:
        bounds = checkpointed(_bounds(values, targets, by))
    bounded = _beside(values, bounds, by)

    between = [
        (F.col(f"_x_{c}") >= F.col(f"_lo{t}")) & (F.col(f"_x_{c}") <= F.col(f"_hi{t}"))
        for t, (c, _) in enumerate(targets)
    ]
    below = [
        F.count_if(F.col(f"_x_{c}") < F.col(f"_lo{t}")).alias(f"_below{t}")
        for t, (c, _) in enumerate(targets)
    ]
    inner = checkpointed(_dealt(_held(bounded, between, targets, by), bounds, targets, by, bins))

    found = bounds.select(*by, *[f"_{k}{t}" for k in ("r", "s") for t in range(len(targets))])
    if counted:
        under = bounds.select(*by, *[f"_below{t}" for t in range(len(targets))])
    else:
        under = bounded.groupBy(*by).agg(*below)
    wanted = [
        F.struct(F.lit(t).alias("_t"), *(F.col(f"_{k}{t}").alias(f"_{k}") for k in ("r", "s", "below")))
        for t in range(len(targets))
    ]
    found = _beside(found, under, by).select(*by, F.inline(F.array(*wanted)))
    picked = _ranked(inner, checkpointed(found), by)
    return _gathered(bounds, picked, probs, targets, by)


def _bucket(x: Column) -> Column:
    """Number of a value's bucket, 1/256 of a unit of its logarithm wide; it never falls where the value rises."""
    size = F.least(F.nanvl(F.log(F.abs(x)), F.lit(1_001.0)), F.when(F.isnan(x), 1_001.0).otherwise(1_000.0))
    place = (F.floor(size * 256) + 200_000).cast("int")
    return F.when(x > 0, place).when(x < 0, -place).when(x == 0, 0)


def _bucket_bounds(values: DataFrame, targets: list[tuple[str, float]], by: list[str]) -> DataFrame:
    """What `_bounds` gives, and the values below each lower bound, from counts of buckets in one pass.

    The bounds of a target are the least and the largest value of the buckets that its two
    ranks lie in. `_in<t>` are the rows of those that hold more than one value. A window spans
    the buckets of one column of one group, at most 400,000 however many rows there are.
    """
    columns = list(dict.fromkeys(c for c, _ in targets))
    each = [F.struct(F.lit(i).alias("_c"), F.col(f"_x_{c}").alias("_x")) for i, c in enumerate(columns)]
    long = values.select(*by, F.inline(F.array(*each)))
    counts = long.groupBy(*by, "_c", _bucket(F.col("_x")).alias("_b")).agg(
        F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")
    )
    column = Window.partitionBy(*by, "_c")
    below = F.sum("_n").over(column.orderBy("_b")) - F.col("_n")
    placed = counts.withColumns({"_all": F.sum("_n").over(column), "_below": below})
    out = [F.max(F.when(F.col("_c") == i, F.nullif("_all", F.lit(0)))).alias(f"_n_{c}") for i, c in enumerate(columns)]
    for t, (c, p) in enumerate(targets):
        place = F.lit(float(p)) * (F.col("_all") - 1)
        low, high, end = F.floor(place), F.ceil(place), F.col("_below") + F.col("_n")
        own = (F.col("_c") == columns.index(c)) & (F.col("_n") > 0)
        first = own & (low >= F.col("_below")) & (low < end)
        last = own & (high >= F.col("_below")) & (high < end)
        out += [
            F.max(F.when(own, low)).alias(f"_r{t}"),
            F.max(F.when(own, high)).alias(f"_s{t}"),
            F.max(F.when(first, F.col("_lo"))).alias(f"_lo{t}"),
            F.max(F.when(last, F.col("_hi"))).alias(f"_hi{t}"),
            F.coalesce(F.max(F.when(first, F.col("_below"))), F.lit(0)).alias(f"_below{t}"),
            F.coalesce(F.sum(F.when((first | last) & (F.col("_lo") < F.col("_hi")), F.col("_n"))), F.lit(0)).alias(f"_in{t}"),
        ]
    return placed.groupBy(*by).agg(*out)


def _within(bounds: DataFrame, targets: list[tuple[str, float]]) -> bool:
    """Whether the buckets narrow the rows far enough; values that lie close together leave it to the sketch."""
    held = reduce(lambda a, b: a + b, [F.col(f"_in{t}") for t in range(len(targets))])
    rows = reduce(lambda a, b: a + b, [F.coalesce(f"_n_{c}", F.lit(0)) for c, _ in targets])
    row = bounds.agg(F.sum(held).alias("held"), F.sum(rows).alias("rows")).first()
    return not row["rows"] or row["held"] <= HELD_SHARE * row["rows"]


def _bounds(values: DataFrame, targets: list[tuple[str, float]], by: list[str]) -> DataFrame:
    """Per group: how many values a column has, and for each target its two ranks and two bounds.

    A grid step is ten times the error of the sketch, so ranks lie between the grid
    points a step away; the outermost bounds are the least and the largest value.
    """
    columns = list(dict.fromkeys(c for c, _ in targets))
    steps = ",".join(str(g / GRID) for g in range(GRID + 1))
    grid = F.split(F.lit(steps), ",").cast("array<double>")
    sketched = values.groupBy(*by).agg(
        *[F.count(f"_x_{c}").alias(f"_n_{c}") for c in columns],
        *[f(f"_x_{c}").alias(f"_{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))],
        *[F.percentile_approx(f"_x_{c}", grid, ACCURACY).alias(f"_grid_{c}") for c in columns],
    )
    out = [f"_n_{c}" for c in columns]
    for t, (c, p) in enumerate(targets):
        n = F.col(f"_n_{c}")
        place = F.lit(float(p)) * (n - 1)
        low, high = F.floor(place), F.ceil(place)
        before, after = F.floor(low * GRID / n) - 1, F.floor(high * GRID / n) + 2
        points = F.col(f"_grid_{c}")
        out += [
            low.alias(f"_r{t}"),
            high.alias(f"_s{t}"),
            F.when(before <= 0, F.col(f"_min_{c}")).otherwise(F.get(points, before.cast("int"))).alias(f"_lo{t}"),
            F.when(after >= GRID, F.col(f"_max_{c}")).otherwise(F.get(points, after.cast("int"))).alias(f"_hi{t}"),
        ]
    # An all-null column divides by no rows; its bounds stay NULL and hold no row.
    counted = sketched.withColumns({f"_n_{c}": F.nullif(f"_n_{c}", F.lit(0)) for c in columns})
    return counted.select(*by, *out)


def _beside(df: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Values of a group next to its rows; without groups the one row becomes literals."""
    if by:
        return attach(df, table, by, "inner")
    row = table.first()
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in table.schema})


def _held(
    bounded: DataFrame, between: list[Column], targets: list[tuple[str, float]], by: list[str]
) -> DataFrame:
    """Values of each column that lie between the bounds of any target, with their counts.

    A value is held once a column however many targets want it, and rows without one
    leave before anything is built from them.
    """
    columns = list(dict.fromkeys(c for c, _ in targets))
    own = {c: [inside for (name, _), inside in zip(targets, between, strict=True) if name == c] for c in columns}
    marks = {c: f"_in{i}" for i, c in enumerate(columns)}
    marked = bounded.select(
        *by,
        *[f"_x_{c}" for c in columns],
        *[F.coalesce(reduce(or_, inside), F.lit(False)).alias(marks[c]) for c, inside in own.items()],
    ).where(reduce(or_, [F.col(mark) for mark in marks.values()]))
    held = [
        F.when(F.col(marks[c]), F.struct(F.lit(i).alias("_c"), F.col(f"_x_{c}").alias("_x")))
        for i, c in enumerate(columns)
    ]
    inner = marked.select(*by, F.explode(F.array_compact(F.array(*held))).alias("_v"))
    return inner.select(*by, "_v.*").groupBy(*by, "_c", "_x").agg(F.count("*").alias("_n"))


def _dealt(
    held: DataFrame, bounds: DataFrame, targets: list[tuple[str, float]], by: list[str], bins: int
) -> DataFrame:
    """The held values of each target, dealt into bins."""
    place = {c: i for i, c in enumerate(dict.fromkeys(c for c, _ in targets))}
    wanted = [
        F.struct(
            F.lit(t).alias("_t"),
            F.lit(place[c]).alias("_own"),
            F.col(f"_lo{t}").alias("_lo"),
            F.col(f"_hi{t}").alias("_hi"),
        )
        for t, (c, _) in enumerate(targets)
    ]
    parts = _beside(held, bounds, by).select(*by, "_c", "_x", "_n", F.inline(F.array(*wanted)))
    inside = (F.col("_c") == F.col("_own")) & (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    return parts.where(inside).select(*by, "_t", _bin(bins).alias("_b"), "_x", "_n")


def _bin(bins: int) -> Column:
    """Place of a value between its bounds; it never falls where the value rises."""
    x, low, high = F.col("_x"), F.col("_lo"), F.col("_hi")
    share = F.when(high > low, (x - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.0)
    return F.floor(F.least(F.nanvl(share, F.lit(1.0)), F.lit(1.0)) * (bins - 1)).cast("int")


def _ranked(inner: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Values at ranks `_r` and `_s` of each group and target."""
    target = [*by, "_t"]
    order = Window.partitionBy(*target).orderBy("_b")
    per_bin = inner.groupBy(*target, "_b").agg(F.sum("_n").alias("_n"))
    per_bin = per_bin.withColumn("_start", F.sum("_n").over(order) - F.col("_n"))
    per_bin = _on_target(per_bin, found, by).withColumn("_start", F.col("_start") + F.col("_below"))
    end = F.col("_start") + F.col("_n")
    holds = lambda rank: (F.col(rank) >= F.col("_start")) & (F.col(rank) < end)
    chosen = per_bin.filter(holds("_r") | holds("_s")).drop("_n", "_below")

    within = Window.partitionBy(*target, "_b").orderBy("_x")
    values = _on_target(inner, chosen, by, ["_b"])
    values = values.withColumn("_start", F.col("_start") + F.sum("_n").over(within) - F.col("_n"))
    return values.groupBy(*target).agg(
        F.max(F.when(holds("_r"), F.col("_x"))).alias("_low"),
        F.max(F.when(holds("_s"), F.col("_x"))).alias("_high"),
        F.count_if(holds("_r")).alias("_found"),
    )


def _on_target(left: DataFrame, right: DataFrame, by: list[str], more: Sequence[str] = ()) -> DataFrame:
    """Null-safe join on the group, the target and `more`."""
    keys = [*by, "_t", *more]
    right = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys]
    return left.join(right, same).drop(*[f"_k_{k}" for k in keys])


def _gathered(
    bounds: DataFrame,
    picked: DataFrame,
    probs: Mapping[str, Sequence[float]],
    targets: list[tuple[str, float]],
    by: list[str],
) -> DataFrame:
    """One row per group with its arrays; a rank that no bound held is an error, never a guess."""
    columns = list(probs)
    sized = [
        F.struct(F.lit(t).alias("_t"), F.lit(p).alias("_p"), F.col(f"_n_{c}").alias("_all"))
        for t, (c, p) in enumerate(targets)
    ]
    wanted = bounds.select(*by, F.inline(F.array(*sized)))
    keys = [*by, "_t"]
    right = picked.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    rows = wanted.join(right, [wanted[k].eqNullSafe(right[f"_k_{k}"]) for k in keys], "left")
    place = F.col("_p") * (F.col("_all") - 1)
    weight = place - F.floor(place)
    value = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(
        (1 - weight) * F.col("_low") + weight * F.col("_high")
    )
    missed = F.col("_low").isNull() | F.col("_high").isNull()
    value = F.when(F.col("_all").isNull(), F.lit(None)).when(
        missed, F.raise_error(F.lit("a rank lies outside its bounds"))
    ).otherwise(value)
    each = rows.select(*by, "_t", value.cast("double").alias("_q")).groupBy(*by)
    at = {t: F.max(F.when(F.col("_t") == t, F.col("_q"))) for t in range(len(targets))}
    arrays = []
    for c in columns:
        own = [at[t] for t, (name, _) in enumerate(targets) if name == c]
        arrays.append(F.when(own[0].isNotNull(), F.array(*own)).alias(quantile_name(c)))
    return each.agg(*arrays)
