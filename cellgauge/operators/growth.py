"""Forests whose splits lie between any two neighbouring values of a number.

Every tree sees a bootstrap sample of the rows, searches all features for the split of the
largest fall of the squared error, and takes the middle between two values that its node
holds. Nothing is binned or sampled, and what grows is the same however rows are partitioned.

All trees grow level by level. Rows lie in strips that are in order of a number, with the
node of each row in each tree. Numbers of few values and texts are counted value by value,
the counts of a node meet per tree. Of a number of many values each strip gives the sums of
its nodes; with the sums of the strips before it, it finds the best cut among its own values.
So tasks hold a few strips, and the driver holds nodes only.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from math import ceil, frexp, isfinite, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions import texts
from cellgauge.operators.features import FittedFeatures
from cellgauge.sources import schema as S

#: Values of a number that are counted one by one, at most; rows are put in order of wider ones.
FEW = 256
#: Rows of a strip, about, and strips at most: the driver holds the sums of the nodes of each.
STRIP = 1 << 16
STRIPS = 256
#: Trees that grow together over a strip.
CHUNK = 25
#: Bytes of strips and their nodes that grow at a time, about; further trees come after them.
HELD = 4 << 30
#: Bytes of strips in a task, about.
TASK = 1 << 27


@dataclass(frozen=True)
class Level:
    """The nodes of one level of a tree; a row goes right beyond `high` or below `low` of its feature.

    While trees grow, a counted number is the place of its value, and `behind` the place of
    the next value that the node holds.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    mean: np.ndarray
    behind: np.ndarray

    @property
    def split(self) -> np.ndarray:
        return self.feature >= 0

    def final(self, unit: float, counted: Mapping[int, np.ndarray]) -> Level:
        """The same node with values in place of places, and means of the target."""
        high = self.high.copy()
        for f, values in counted.items():
            own = self.feature == f
            high[own] = between(values[high[own].astype(np.int64)], values[self.behind[own]])
        return replace(self, high=high, mean=self.mean * unit)


@dataclass(frozen=True)
class Inputs:
    """The columns that trees read: numbers, and texts by the place of their category."""

    features: FittedFeatures

    @property
    def names(self) -> list[str]:
        return [*self.features.spec.numeric, *self.features.categories]

    def columns(self, medians: Mapping[str, float | None] | None = None) -> list[Column]:
        """Missing numbers take the median, unseen categories the first one."""
        fill = medians or self.features.medians
        out = []
        for c in self.features.spec.numeric:
            x = F.col(c).cast("double")
            out.append(F.coalesce(F.when(~F.isnan(x), x), F.lit(float(fill.get(c) or 0.0))))
        for c, values in self.features.categories.items():
            known = F.coalesce(F.col(c), F.lit(texts.UNKNOWN))
            out.append(F.coalesce(*(F.when(known == v, float(i)) for i, v in enumerate(values)), F.lit(0.0)))
        return out


@dataclass(frozen=True)
class GrownForest:
    """Trees as levels of nodes, and the share of each feature in their gains."""

    inputs: Inputs
    trees: Sequence[Sequence[Level]]
    importances: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        """Mean prediction of all trees; `x` has a row per input."""
        out, every = np.zeros(x.shape[1]), np.arange(x.shape[1])
        for levels in self.trees:
            at, rows = np.zeros(x.shape[1], np.int64), every
            for level in levels:
                split = level.split[at]
                if not split.all():
                    leaf = ~split
                    out[rows[leaf]] += level.mean[at[leaf]]
                    rows, at = rows[split], at[split]
                at = moved(level, at, x, rows)
        return out / len(self.trees)

    def predict(self, df: DataFrame, out: str, medians: Mapping[str, float | None] | None = None) -> DataFrame:
        """Add the prediction. The trees are broadcast: at most 2^depth leaves each."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def walked(*columns: pa.Array) -> pa.Array:
            return pa.array(shared.value.values(np.array([c.to_numpy(zero_copy_only=False) for c in columns])))

        return df.withColumn(out, walked(*self.inputs.columns(medians)))


def moved(level: Level, at: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Nodes of the next level that rows in split nodes go to."""
    v = x.ravel().take(level.feature.take(at) * x.shape[1] + rows)
    return level.child.take(at) + ((v > level.high.take(at)) | (v < level.low.take(at)))


def grow_forest(df: DataFrame, features: FittedFeatures, target: str, trees: int, depth: int, seed: int,
                bootstrap: bool = True, key: str = S.KEY) -> GrownForest:
    """A forest over all rows with a target. Sums of the target are exact: it is rounded to 2^-52 of the largest total."""
    inputs = Inputs(features)
    y = F.col(target).cast("double")
    df = df.where(y.isNotNull() & ~F.isnan(y))
    ids = [c for c in (key, target, *inputs.names) if c in df.columns]
    xs = [f"_x{i}" for i in range(len(inputs.names))]
    df = df.select(F.xxhash64(*ids).alias("_h"), y.alias("_y"), *(c.alias(x) for c, x in zip(inputs.columns(), xs, strict=True)))
    numbers = len(features.spec.numeric)
    row = df.agg(
        F.count("*").alias("n"), F.max(F.abs("_y")).alias("most"), *(F.approx_count_distinct(x).alias(x) for x in xs[:numbers])
    ).first()
    if not row["n"] or not isfinite(row["most"]):
        raise ValueError("a forest needs rows with a finite target")
    unit = 2.0 ** (frexp(row["most"] * 4 * row["n"])[1] - 52) if row["most"] else 1.0
    counted: dict[int, list[float]] = {}
    for i, x in enumerate(xs[:numbers]):
        few = df.select(x).distinct().limit(FEW + 1).collect() if row[x] <= 2 * FEW else ()
        if 0 < len(few) <= FEW:
            counted[i] = sorted(r[0] for r in few)
    counted = {i: np.array(v) for i, v in counted.items()}
    sizes = {i: len(v) for i, v in counted.items()}
    sizes |= {numbers + i: len(v) for i, v in enumerate(features.categories.values())}
    ordered = [i for i in range(numbers) if i not in counted]
    # Exact copies of a row count as one with a weight, so that many of them fill no strip.
    rows = df.withColumn("_y", F.rint(F.col("_y") / unit)).groupBy("_h", "_y", *xs).agg(F.count("*").alias("_c"))
    strips = {i: packed(rows, xs, i, row["n"], counted) for i in ordered or [None]}
    try:
        grown = []
        chunk_bytes = row["n"] * (8 * len(xs) + 8 + 3 * CHUNK) * len(strips)
        step = CHUNK * max(1, HELD // max(chunk_bytes, 1))
        for first in range(0, trees, step):
            some_trees = range(first, min(first + step, trees))
            grown += Growth(strips, sizes, ordered, len(xs), numbers, some_trees, seed if bootstrap else None, chunk_bytes).grow(depth)
    finally:
        for held in strips.values():
            held.unpersist()
    levels = [[level.final(unit, counted) for level in tree] for tree, _ in grown]
    shares = [g / g.sum() if g.sum() > 0 else g for _, g in grown]
    total = np.sum(shares, axis=0)
    return GrownForest(inputs, levels, total / total.sum() if total.sum() > 0 else total)


def packed(rows: DataFrame, xs: Sequence[str], by: int | None, n: int, counted: Mapping[int, np.ndarray]) -> RDD:
    """Rows in strips, in order of one input (None: any); equal values may lie in several strips."""
    parts = min(ceil(n / STRIP), STRIPS)
    if by is None:
        dealt = rows.repartition(parts, "_h")
    else:
        dealt = rows.repartitionByRange(parts, xs[by], "_h").sortWithinPartitions(xs[by])
    names = [*xs, "_y", "_h", "_c"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            x = [table[c].to_numpy() for c in xs]
            for i, values in counted.items():
                x[i] = np.searchsorted(values, x[i]).astype(float)
            blobs = [np.array(x), *(table[c].to_numpy() for c in names[-3:])]
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes()], pa.binary()) for b in blobs], list("xyhc"))

    def strip(at: int, packs: Iterator) -> Iterator[tuple]:
        for blobs in packs:
            x, y, h, c = (np.frombuffer(b, t) for b, t in zip(blobs, (float, float, np.int64, np.int64), strict=True))
            yield at, x.reshape(len(xs), -1), y, h, c

    made = dealt.select(*names).mapInArrow(pack, "x binary, y binary, h binary, c binary").rdd
    return made.mapPartitionsWithIndex(strip, True).persist(StorageLevel.MEMORY_AND_DISK)


def drawn(h: np.ndarray, c: np.ndarray, seed: int | None, tree: int) -> np.ndarray:
    """How often each row is in the bootstrap sample of a tree: Poisson, from the hash of the row."""
    if seed is None:
        return c
    with np.errstate(over="ignore"):
        z = h.view(np.uint64) ^ _mixed(np.array([seed], np.int64).view(np.uint64) * _ODD + np.uint64(tree + 1))
        u = _mixed(z)
    out = np.zeros(len(u), np.int64)
    for limit in _poisson(1):
        beyond = u >= limit
        if not beyond.any():
            break
        out += beyond
    for copies in np.unique(c[c > 1]):
        own = c == copies
        out[own] = np.searchsorted(_poisson(int(copies)), u[own], side="right")
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    z = z + _ODD
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _poisson(mean: int) -> np.ndarray:
    """Limits of 64-bit numbers between counts 0, 1, 2, ... of a Poisson distribution."""
    counts = range(int(mean + 12 * sqrt(mean) + 30))
    below = np.cumsum([np.exp(k * log(mean) - mean - lgamma(k + 1)) for k in counts])
    return (np.minimum(below, 1 - 2.0**-53) * 2.0**64).astype(np.uint64)


class Growth:
    """Some trees of a forest while they grow.

    A unit is a strip with the weights and nodes of its rows in a chunk of trees.
    """

    def __init__(self, strips: Mapping[int | None, RDD], sizes: Mapping[int, int], ordered: Sequence[int], inputs: int,
                 numbers: int, trees: range, seed: int | None, chunk_bytes: int) -> None:
        self.strips, self.sizes, self.ordered = strips, sizes, ordered
        self.inputs, self.numbers, self.trees, self.seed = inputs, numbers, trees, seed
        self.first = next(iter(strips))
        self.context = strips[self.first].context
        chunks = -(-len(trees) // CHUNK)
        self.parts = max(2 * self.context.defaultParallelism, ceil(chunk_bytes * chunks / len(strips) / TASK))
        #: Features of each input: one of a number, all categories but the first of a text.
        self.slots = {i: 1 if i < numbers else max(sizes[i] - 1, 0) for i in range(inputs)}

    def grow(self, depth: int) -> list[tuple[list[Level], np.ndarray]]:
        """Levels and gains of each tree."""
        grown: dict[int, list[Level]] = {t: [] for t in self.trees}
        gains = {t: np.zeros(sum(self.slots.values())) for t in self.trees}
        units, count = {by: self.units(strips) for by, strips in self.strips.items()}, dict.fromkeys(self.trees, 1)
        held: list[RDD] = []
        lent: list[Broadcast] = []
        last: dict[int, Level] = {}
        whole: frozenset[int] = frozenset()
        level = 0
        while count:
            shared = self.context.broadcast((count, last, whole))
            lent.append(shared)
            units = {by: self.advanced(units[by], by, shared, level < depth) for by in self.strips}
            sums, found = {}, {}
            for by, moving in units.items():
                sums[by], best = self.summed(moving, count)
                found = best if by == self.first else found
            total = {t: v[:, :2].sum(axis=0) for t, v in sums[self.first][1].items()}
            empty = frozenset(t for t in count if level == 0 and not total[t][0].any()) - whole
            if empty:
                # A bootstrap sample of very few rows can be empty: such a tree takes all rows.
                whole |= empty
                for rdd in units.values():
                    rdd.unpersist()
                units = {by: self.units(strips) for by, strips in self.strips.items()}
                continue
            for by in self.ordered if level < depth else ():
                self.cut(units[by], by, count, total, sums[by], found)
            for rdd in held:
                rdd.unpersist()
            held, last = list(units.values()), {}
            for t in count:
                last[t], best = self.chosen(total[t], found[t])
                grown[t].append(last[t])
                gains[t] += best
            last = {t: v for t, v in last.items() if v.split.any()}
            count = {t: 2 * int(v.split.sum()) for t, v in last.items()}
            level += 1
        for rdd in held:
            rdd.unpersist()
        for shared in lent:
            shared.destroy()
        return [(grown[t], gains[t]) for t in self.trees]

    def chosen(self, total: np.ndarray, found: Mapping[int, tuple]) -> tuple[Level, np.ndarray]:
        """The nodes of a level with their best splits, and the gain of each feature."""
        rows, totals = total
        mean = totals / np.where(rows > 0, rows, 1)
        best, feature = np.zeros(len(rows)), np.full(len(rows), -1)
        low, high = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
        slot, behind = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at = 0
        for f, width in self.slots.items():
            if f in found:
                gain, lows, highs, place = found[f]
                better = gain > best + 1e-9 * np.abs(totals * mean)
                best, feature = np.where(better, gain, best), np.where(better, f, feature)
                low, high = np.where(better, lows, low), np.where(better, highs, high)
                slot, behind = np.where(better, at + (0 if f < self.numbers else place), slot), np.where(better, place, behind)
            at += width
        split, gains = feature >= 0, np.zeros(at)
        np.add.at(gains, slot[split], best[split])
        return Level(feature, low, high, np.cumsum(split) * 2 - 2, mean, behind), gains

    def units(self, strips: RDD) -> RDD:
        """Every strip with every chunk of trees, dealt so that a task holds few chunks."""
        chunks, most, parts = self.trees[::CHUNK], strips.getNumPartitions(), self.parts

        def chunked(strip: tuple) -> Iterator[tuple]:
            for i, t in enumerate(chunks):
                yield i * most + strip[0], (t, *strip)

        def part(place: int) -> int:
            return place * parts // (len(chunks) * most)

        return strips.flatMap(chunked).partitionBy(parts, part).values()

    def advanced(self, units: RDD, by: int | None, shared: Broadcast, growing: bool) -> RDD:
        """Units whose rows moved to the nodes of the level, with the sums of its nodes; counts of values once a task."""
        sizes = {f: size for f, size in self.sizes.items() if size > 1} if growing and by == self.first else {}
        trees, seed = self.trees, self.seed

        def run(units: Iterator[tuple]) -> Iterator[tuple]:
            count, last, whole = shared.value
            values: dict[tuple[int, int], np.ndarray] = {}
            for tree, strip, x, y, weights, nodes, *_ in units:
                mine = range(tree, min(tree + CHUNK, trees.stop))
                if not last:
                    weights = np.array([drawn(weights, nodes, None if t in whole else seed, t) for t in mine])
                    weights = weights.astype(np.uint8 if weights.max() < 256 else np.int64)
                    nodes = np.where(weights > 0, 0, -1).astype(np.int16)
                else:
                    nodes = nodes.astype(np.int16 if max(count.values()) <= 1 << 15 else np.int32)
                codes = {f: x[f].astype(np.int64) for f in sizes}
                sums = {}
                for t, node_of, weight in zip(mine, nodes, weights, strict=True):
                    if t not in count:
                        continue
                    rows = np.flatnonzero(node_of >= 0)
                    node = node_of.take(rows)
                    if last:
                        split = last[t].split.take(node)
                        node_of[rows[~split]] = -1
                        rows = rows[split]
                        node = moved(last[t], node[split], x, rows)
                        node_of[rows] = node
                    n = weight.take(rows).astype(float)
                    s = n * y.take(rows)
                    least = np.full(count[t], np.nan)
                    if by is not None and growing:
                        least[node[::-1]] = x[by].take(rows[::-1])
                    sums[t] = np.array([np.bincount(node, n, count[t]), np.bincount(node, s, count[t]), least])
                    for f, code in codes.items():
                        place = node.astype(np.int64) * sizes[f] + code.take(rows)
                        both = values.setdefault((t, f), np.zeros((2, count[t] * sizes[f])))
                        both[0] += np.bincount(place, n, count[t] * sizes[f])
                        both[1] += np.bincount(place, s, count[t] * sizes[f])
                if sums:
                    yield tree, strip, x, y, weights, nodes, sums
            for (t, f), both in values.items():
                yield t, f, both.reshape(2, count[t], -1)

        return units.filter(lambda unit: len(unit) > 3).mapPartitions(run, True).persist(StorageLevel.MEMORY_AND_DISK)

    def summed(self, units: RDD, count: Mapping[int, int]) -> tuple[tuple[list[int], dict[int, np.ndarray]], dict[int, dict]]:
        """Strips in order, of each tree rows, total and least value by strip and node, and best splits by counted values."""
        numbers = self.numbers

        def parts(unit: tuple) -> tuple:
            return ((*unit[:2], False), unit[6]) if len(unit) > 3 else ((*unit[:2], True), unit[2])

        def best(key: tuple, value: object) -> tuple:
            return key, best_value(*value, key[1] < numbers) if key[2] else value

        found = units.map(parts).reduceByKey(np.add, self.parts).map(lambda kv: best(*kv)).collect()
        strips = sorted({strip for (_, strip, counts), _ in found if not counts})
        place = {s: i for i, s in enumerate(strips)}
        sums = {t: np.empty((len(strips), 3, n)) for t, n in count.items()}
        splits: dict[int, dict] = {t: {} for t in count}
        for (tree, at, counts), value in found:
            if counts:
                splits[tree][at] = value
                continue
            for t, own in value.items():
                sums[t][place[at]] = own
        return (strips, sums), splits

    def cut(self, units: RDD, by: int, count: Mapping[int, int], total: Mapping[int, np.ndarray],
            sums: tuple[list[int], Mapping[int, np.ndarray]], found: dict[int, dict]) -> None:
        """Best cut of each node through a number of many values: the first best of the strips."""
        strips, each = sums
        before, after = {}, {}
        for t, v in each.items():
            before[t] = v[:, :2].cumsum(axis=0) - v[:, :2]
            # The least value of the strips behind; NaN where none of them has a row of the node.
            after[t] = np.full((len(strips), count[t]), np.nan)
            for i in range(len(strips) - 2, -1, -1):
                after[t][i] = np.where(np.isnan(v[i + 1, 2]), after[t][i + 1], v[i + 1, 2])
        shared = self.context.broadcast((total, {s: i for i, s in enumerate(strips)}, before, after))

        def run(unit: tuple) -> Iterator[tuple]:
            total, place, before, after = shared.value
            if len(unit) > 3:
                tree, strip, x, y, weights, nodes, sums = unit
                for t in sums:
                    rows = np.flatnonzero(nodes[t - tree] >= 0)
                    n, i = weights[t - tree].take(rows).astype(float), place[strip]
                    node, v = nodes[t - tree].take(rows), x[by].take(rows)
                    yield t, strip, best_cut(node, v, n, n * y.take(rows), *before[t][i], *total[t], after[t][i])

        for t, _, (gain, a, b) in sorted(units.flatMap(run).collect(), key=lambda r: r[:2]):
            have = found[t].get(by, (np.zeros(len(a)), np.full(len(a), -np.inf), np.full(len(a), np.inf), np.zeros(len(a), np.int64)))
            better = gain > have[0]
            found[t][by] = np.where(better, gain, have[0]), have[1], np.where(better, between(a, b), have[2]), have[3]
        shared.destroy()


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The middle of two values; the smaller one where rounding or infinity leaves none below the larger."""
    with np.errstate(invalid="ignore", over="ignore"):
        middle = a / 2 + b / 2
        return np.where((middle >= a) & (middle < b), middle, a)


def best_value(n: np.ndarray, s: np.ndarray, number: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best split of each node from its counts by value: gain, ends, and the next value (number) or the category's slot (text)."""
    if number:
        left_n, left_s = n.cumsum(axis=1)[:, :-1], s.cumsum(axis=1)[:, :-1]
    else:
        left_n, left_s = n[:, 1:], s[:, 1:]
    gain = gains_of(left_n, left_s, n.sum(axis=1, keepdims=True), s.sum(axis=1, keepdims=True))
    at = gain.argmax(axis=1)
    top = gain[np.arange(len(n)), at]
    if not number:
        return top, at + 1.0, at + 1.0, at
    # The first of equal gains is behind a value that the node holds; the cut lies before the next such value.
    places = np.arange(n.shape[1])
    behind = np.where((n > 0) & (places > at[:, None]), places, n.shape[1] - 1).min(axis=1)
    return top, np.full(len(n), -np.inf), at.astype(float), behind


def gains_of(left_n: np.ndarray, left_s: np.ndarray, rows: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Fall of the squared error by splits off the left; 0 where a side is empty."""
    right_n, right_s = rows - left_n, totals - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s * left_s / left_n + right_s * right_s / right_n - totals * totals / rows
    return np.where((left_n > 0) & (right_n > 0), gain, 0)


def best_cut(node: np.ndarray, x: np.ndarray, n: np.ndarray, s: np.ndarray, n_before: np.ndarray, s_before: np.ndarray,
             rows: np.ndarray, totals: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain and the two values at the best cut of each node behind one of these rows, which are in order."""
    best, a, b = np.zeros(len(rows)), np.full(len(rows), np.nan), np.full(len(rows), np.nan)
    if not len(node):
        return best, a, b
    order = np.argsort(node, kind="stable")
    node, x = node[order], x[order]
    left_n, left_s = n[order].cumsum(), s[order].cumsum()
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    ends = np.append(starts[1:], len(node)) - 1
    held = node[starts]
    base_n, base_s = np.append(0, left_n[ends[:-1]]), np.append(0, left_s[ends[:-1]])
    behind = np.append(x[1:], np.nan)
    behind[ends] = after[held]
    here = np.flatnonzero(x < behind)
    if not len(here):
        return best, a, b
    sizes = ends - starts + 1
    left_n += np.repeat(n_before[held] - base_n, sizes)
    left_s += np.repeat(s_before[held] - base_s, sizes)
    own = node[here]
    gain = gains_of(left_n[here], left_s[here], rows[own], totals[own])
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    held = own[starts]
    best[held] = np.maximum.reduceat(gain, starts)
    top = np.flatnonzero(gain == best[own])[::-1]
    a[own[top]], b[own[top]] = x[here[top]], behind[here[top]]
    return best, a, b
