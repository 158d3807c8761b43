"""Forests grown from one aggregate of the training rows.

A forest with binned features sees of a row only its cell: the bin of each number and the
category of each text. One grouped pass therefore gives all that trees of any column group,
segment or union of folds need: rows, sum and sum of squares of the target per cell and
fold. Rows of a cell are dealt by the hash of their key into blocks, and every tree draws a
Poisson weight per block, so it sees a bootstrap sample.

Trees of all fits are grown side by side as tasks of one job. What a forest predicts is a
table over the grid of cells, so scoring is a join with a table of bounded size, and errors
on a fold follow from the aggregate without another pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions import texts
from cellgauge.functions.columns import hash32
from cellgauge.operators.features import FeatureSpec, FittedFeatures
from cellgauge.operators.quantiles import GROUP_LIMIT, equal_shares
from cellgauge.sources import schema as S

#: Cells of a grid, at most: a prediction table of 16 MB. Wider ones are left to MLlib.
MAX_CELLS = 1_000_000
#: Blocks that reach the driver, at most, in all cells and folds.
MAX_BLOCKS = 2_000_000
#: Blocks of a cell and fold, at most.
BLOCKS = 64
#: Cells of one piece of a prediction table when trees are added up.
PIECE = 1 << 16
#: Seed of the deal of rows to blocks, apart from those of splits and folds.
DEAL_SEED = 1009


@dataclass(frozen=True)
class Grid:
    """Bins of numbers (cuts between them) and categories of texts, in the order of the features."""

    cuts: Mapping[str, Sequence[float]]
    categories: Mapping[str, Sequence[str]]
    medians: Mapping[str, float | None] = field(default_factory=dict)

    @property
    def sizes(self) -> dict[str, int]:
        """Bins per feature; a text without known categories has one."""
        return {c: len(v) + 1 for c, v in self.cuts.items()} | {c: max(len(v), 1) for c, v in self.categories.items()}

    @property
    def cells(self) -> int:
        return prod(self.sizes.values())

    @property
    def names(self) -> list[str]:
        return [*self.cuts, *(f"{c}_{v}" for c, vs in self.categories.items() for v in vs[1:])]

    def placed(self, df: DataFrame, out: str, medians: Mapping[str, float | None] | None = None) -> DataFrame:
        """Add the number of a row's cell. Missing numbers take the median, unseen categories the first one.

        Bins are found by bisection in one call a number: a condition per cut makes the
        generated method longer than the JVM compiles.
        """
        return place_all(df, {out: self}, medians)

    def codes(self, cell: np.ndarray) -> np.ndarray:
        """Bin of every feature (rows) in every cell (columns)."""
        out = []
        for size in reversed(self.sizes.values()):
            cell, code = np.divmod(cell, size)
            out.append(code)
        return np.array(out[::-1], dtype=np.int32).reshape(len(self.sizes), -1)

    def part(self, spec: FeatureSpec) -> Grid:
        """The grid of some of the features."""
        return Grid(
            {c: self.cuts[c] for c in spec.numeric}, {c: self.categories[c] for c in spec.categorical}, self.medians
        )

    def project(self, cell: np.ndarray, part: Grid) -> np.ndarray:
        """Cells of a part of the grid that cells of this grid lie in."""
        codes = dict(zip(self.sizes, self.codes(cell), strict=True))
        out = np.zeros(len(cell), dtype=np.int64)
        for name, size in part.sizes.items():
            out = out * size + codes[name]
        return out


def place_all(df: DataFrame, grids: Mapping[str, Grid], medians: Mapping[str, float | None] | None = None) -> DataFrame:
    """Add the number of a row's cell in each grid, by column name; a bin that grids share is found once."""
    prefix = f"_{next(iter(grids))}_x"
    bins: dict[tuple, str] = {}
    filled, splits = {}, {}
    for grid in grids.values():
        fill = medians or grid.medians
        for c, cuts in grid.cuts.items():
            # A number beyond a cut is at or beyond the next number; nothing lies beyond infinity.
            ends = tuple(float(np.nextafter(cut, np.inf)) for cut in cuts if cut < np.inf)
            missing = float(fill.get(c) or 0.0)
            if not ends or (c, ends, missing) in bins:
                continue
            name = f"{prefix}{len(bins)}"
            bins[c, ends, missing] = f"{name}b"
            x = F.col(c).cast("double")
            filled[name] = F.coalesce(F.when(~F.isnan(x), x), F.lit(missing))
            splits[name] = [-float("inf"), *ends, float("inf")]
    placed = df.withColumns(filled) if filled else df
    if splits:
        placed = Bucketizer(
            splitsArray=list(splits.values()), inputCols=list(splits), outputCols=[f"{c}b" for c in splits]
        ).transform(placed)
    codes = {}
    for out, grid in grids.items():
        fill = medians or grid.medians
        code = F.lit(0)
        for c, cuts in grid.cuts.items():
            ends = tuple(float(np.nextafter(cut, np.inf)) for cut in cuts if cut < np.inf)
            found = bins.get((c, ends, float(fill.get(c) or 0.0)))
            code = code * (len(cuts) + 1) + (F.col(found).cast("int") if found else F.lit(0))
        for c, values in grid.categories.items():
            known = F.coalesce(F.col(c), F.lit(texts.UNKNOWN))
            place = F.coalesce(*(F.when(known == v, i) for i, v in enumerate(values)), F.lit(0))
            code = code * max(len(values), 1) + place
        codes[out] = code.cast("int")
    return placed.withColumns(codes).drop(*filled, *bins.values())


def fit_grid(df: DataFrame, features: FittedFeatures, bins: int = 32, rows: int | None = None) -> Grid:
    """Cuts at equal shares of the rows; equal cuts fall together."""
    if features.spec.numeric and rows is None:
        rows = df.count()
    return fit_grids(df, [(features, rows or 0, None)], bins)[0]


def fit_grids(df: DataFrame, wanted: Sequence[tuple[FittedFeatures, int, Column | None]], bins: int = 32) -> list[Grid]:
    """Grids of several sets of rows as `fit_grid` gives each, from passes that all share.

    A set is given by its features, its number of rows and the condition that they meet. The
    shares are those of all its rows: up to GROUP_LIMIT values one pass gives them, beyond
    it they are narrowed (`equal_shares`), since that pass would hold every value.
    """
    held = {}
    for i, (features, _, mine) in enumerate(wanted):
        for c in features.spec.numeric:
            v = F.col(c).cast("double")
            known = ~F.isnan(v) if mine is None else mine & ~F.isnan(v)
            held[f"_{i}_{c}"] = F.when(known, v)
    if sum(rows * len(features.spec.numeric) for features, rows, _ in wanted) > GROUP_LIMIT:
        cuts = equal_shares(df.select(*(v.alias(name) for name, v in held.items())), list(held), bins)
    else:
        shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
        cuts = df.agg(*(F.percentile(v, shares).alias(name) for name, v in held.items())).first() if held else {}
    return [
        Grid(
            {c: sorted(set(cuts[f"_{i}_{c}"] or ())) for c in features.spec.numeric},
            dict(features.categories),
            dict(features.medians),
        )
        for i, (features, _, _) in enumerate(wanted)
    ]


@dataclass(frozen=True)
class Blocks:
    """The aggregate: cell and fold of each block, rows, sum and sum of squares of the target."""

    grid: Grid
    cell: np.ndarray
    fold: np.ndarray
    n: np.ndarray
    total: np.ndarray
    squares: np.ndarray

    def errors(self, table: np.ndarray, part: Grid, folds: Sequence[int]) -> np.ndarray:
        """Mean squared error of a prediction table on each fold."""
        p = table[self.grid.project(self.cell, part)]
        sse = self.squares - 2 * p * self.total + self.n * p * p
        with np.errstate(invalid="ignore"):
            return np.array([sse[self.fold == f].sum() / self.n[self.fold == f].sum() for f in folds])


@dataclass(frozen=True)
class Part:
    """One aggregate of several: its grid, the rows it takes (None: all) and their folds."""

    grid: Grid
    mine: Column | None = None
    fold: Column | None = None
    folds: int = 1


def fit_blocks(df: DataFrame, grid: Grid, target: str = S.LATENCY, fold: Column | None = None, folds: int = 1,
               key: str = S.KEY) -> Blocks:
    """One grouped pass with partial sums; what reaches the driver is bounded by cells, folds and blocks.

    Rows without a target are left out. Sums are rounded far below the target's digits, so
    that the order of addition does not choose between equal splits.
    """
    return next(fit_all_blocks(df, [Part(grid, None, fold, folds)], target, key))


def fit_all_blocks(df: DataFrame, parts: Sequence[Part], target: str = S.LATENCY, key: str = S.KEY) -> Iterator[Blocks]:
    """The blocks of each part as `fit_blocks` gives them, from one pass over the rows.

    A row is counted once for each part that takes it. The sums are cached and reach the
    driver part by part, so it holds no more than one part's blocks at a time.
    """
    y = F.col(target).cast("double")
    dealt = hash32(key, DEAL_SEED) if key in df.columns else F.lit(0)
    placed = place_all(df.where(y.isNotNull() & ~F.isnan(y)), {f"_cell{i}": part.grid for i, part in enumerate(parts)})
    # Columns first: a hash that parts share is worked out once a row here, but not inside `inline`.
    columns = [y.alias("y")]
    for i, part in enumerate(parts):
        deal = max(1, min(BLOCKS, MAX_BLOCKS // (part.grid.cells * part.folds)))
        cell, fold = F.col(f"_cell{i}"), F.lit(0) if part.fold is None else part.fold
        columns += [
            (cell if part.mine is None else F.when(part.mine, cell)).alias(f"_cell{i}"),
            fold.cast("int").alias(f"_fold{i}"),
            (dealt % deal).cast("int").alias(f"_block{i}"),
        ]
    entries = [
        F.struct(F.lit(i).alias("part"), *(F.col(f"_{c}{i}").alias(c) for c in ("cell", "fold", "block")))
        for i in range(len(parts))
    ]
    rows = placed.select(*columns).select("y", F.inline(F.array(*entries)))
    rows = rows.where("cell IS NOT NULL AND fold IS NOT NULL")
    sums = rows.groupBy("part", "cell", "fold", "block").agg(
        F.count("*").alias("n"), F.round(F.sum("y"), 6).alias("s"), F.round(F.sum(F.col("y") * F.col("y")), 6).alias("q")
    )
    if len(parts) > 1:
        sums = sums.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for i, part in enumerate(parts):
            table = sums.where(F.col("part") == i).drop("part").toArrow()
            table = table.sort_by([("cell", "ascending"), ("fold", "ascending"), ("block", "ascending")])
            cell, fold, n, s, q = (table[c].to_numpy() for c in ("cell", "fold", "n", "s", "q"))
            yield Blocks(part.grid, cell.astype(np.int64), fold, n.astype(float), s, q)
    finally:
        if len(parts) > 1:
            sums.unpersist()


@dataclass(frozen=True)
class Fit:
    """One forest: its columns, the folds it must not see, and the category it is restricted to."""

    name: str
    spec: FeatureSpec
    without: frozenset[int] = frozenset()
    only: tuple[str, str] | None = None


@dataclass(frozen=True)
class CellForest:
    """What a forest predicts in every cell, and the share of each feature in its gains."""

    grid: Grid
    table: np.ndarray
    importances: np.ndarray

    def predict(self, df: DataFrame, out: str, medians: Mapping[str, float | None] | None = None) -> DataFrame:
        """Add the prediction by a join with the table, whose size is bounded by MAX_CELLS."""
        cell = f"_cell_{out}"
        rows = pa.table({cell: pa.array(np.arange(len(self.table)), pa.int32()), out: pa.array(self.table)})
        lookup = F.broadcast(df.sparkSession.createDataFrame(rows))
        return self.grid.placed(df, cell, medians).join(lookup, cell, "left").drop(cell)


def grow_tree(codes: np.ndarray, kinds: Sequence[tuple[int, bool]], n: np.ndarray, total: np.ndarray, cells: np.ndarray,
              depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Prediction of one tree in every column of `cells`, and the gain of each feature.

    `codes` holds a bin per feature and block, `kinds` the bins of a feature and whether it
    is a number (split between bins) or a text (split off one category, not the first).
    A split takes the largest fall of the squared error; a level is split at once.
    """
    node, held = np.zeros(codes.shape[1], np.int64), np.zeros(cells.shape[1], np.int64)
    here, there = np.arange(codes.shape[1]), np.arange(cells.shape[1])
    out = np.zeros(cells.shape[1])
    gains = np.zeros(sum(1 if number else size - 1 for size, number in kinds))
    count = 1
    for level in range(depth + 1):
        rows = np.bincount(node, n[here], count)
        sums = np.bincount(node, total[here], count)
        mean = sums / np.where(rows > 0, rows, 1)
        best, feature, point, slot = np.zeros(count), np.full(count, -1), np.zeros(count, np.int64), np.zeros(count, np.int64)
        first = 0
        for f, (size, number) in enumerate(kinds if level < depth else ()):
            width = size - 1
            if width:
                key = node * size + codes[f, here]
                left_n = np.bincount(key, n[here], count * size).reshape(count, size)
                left_s = np.bincount(key, total[here], count * size).reshape(count, size)
                if number:
                    left_n, left_s = left_n.cumsum(axis=1)[:, :-1], left_s.cumsum(axis=1)[:, :-1]
                else:
                    left_n, left_s = left_n[:, 1:], left_s[:, 1:]
                right_n, right_s = rows[:, None] - left_n, sums[:, None] - left_s
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = left_s**2 / left_n + right_s**2 / right_n - (sums**2 / rows)[:, None]
                gain = np.where((left_n > 0) & (right_n > 0), gain, 0)
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                better = top > best + 1e-9 * np.abs(sums * mean)
                best, feature, point = np.where(better, top, best), np.where(better, f, feature), np.where(better, at, point)
                slot = np.where(better, first + (0 if number else at), slot)
            first += 1 if number else width
        split = feature >= 0
        np.add.at(gains, slot[split], best[split])
        leaf = ~split[held]
        out[there[leaf]] = mean[held[leaf]]
        if not split.any():
            break
        child = np.cumsum(split) * 2 - 2
        numbers = np.array([number for _, number in kinds])

        def moved(which: np.ndarray, table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keep = split[at]
            which, at = which[keep], at[keep]
            code = table[feature[at], which]
            right = np.where(numbers[feature[at]], code > point[at], code != point[at] + 1)
            return which, child[at] + right

        here, node = moved(here, codes, node)
        there, held = moved(there, cells, held)
        count = 2 * int(split.sum())
    return out, gains


def fit_forests(df: DataFrame, blocks: Blocks, fits: Sequence[Fit], trees: int, depth: int, seed: int,
                bootstrap: bool = True) -> list[CellForest]:
    """All forests in one job: a task grows some trees of one fit. `df` lends its session only.

    The blocks are broadcast, bounded by MAX_BLOCKS. Predictions of the trees of a fit are
    added up piece by piece of the grid. A fit without rows predicts 0 and has no importances.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(blocks)
    slots = max(spark.sparkContext.defaultParallelism, 1)
    chunk = max(1, -(-trees * len(fits) // (4 * slots)))
    work = [(i, a, min(a + chunk, trees)) for i in range(len(fits)) for a in range(0, trees, chunk)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table, gains = _trees(shared.value, fits[i], range(a, b), depth, seed if bootstrap else None)
                for at in range(0, len(table), PIECE):
                    held = table[at : at + PIECE].tobytes(), gains.tobytes() if at == 0 else None
                    yield pa.RecordBatch.from_pylist([{"fit": i, "at": at, "sums": held[0], "gains": held[1]}], _SUMS)

    def added(table: pa.Table) -> pa.Table:
        def whole(name: str) -> bytes | None:
            parts = [np.frombuffer(x) for x in table[name].to_pylist() if x is not None]
            return np.sum(parts, axis=0).tobytes() if parts else None

        row = {"fit": table["fit"][0].as_py(), "at": table["at"][0].as_py(), "sums": whole("sums"), "gains": whole("gains")}
        return pa.Table.from_pylist([row], _SUMS)

    tasks = spark.createDataFrame(work, "fit int, a int, b int").repartition(min(len(work), 4 * slots))
    schema = "fit int, at int, sums binary, gains binary"
    grown = tasks.mapInArrow(run, schema).groupBy("fit", "at").applyInArrow(added, schema)
    rows = grown.toArrow().sort_by([("fit", "ascending"), ("at", "ascending")]).to_pylist()
    shared.destroy()
    out = []
    for i, fit in enumerate(fits):
        mine = [r for r in rows if r["fit"] == i]
        table = np.concatenate([np.frombuffer(r["sums"]) for r in mine]) / trees
        gains = np.frombuffer(mine[0]["gains"])
        out.append(CellForest(blocks.grid.part(fit.spec), table, gains / gains.sum() if gains.sum() > 0 else gains))
    return out


_SUMS = pa.schema([("fit", pa.int32()), ("at", pa.int32()), ("sums", pa.binary()), ("gains", pa.binary())])


def _trees(blocks: Blocks, fit: Fit, trees: range, depth: int, seed: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the predictions of some trees over the grid, and of their shares of gains; no seed, no bootstrap."""
    grid = blocks.grid.part(fit.spec)
    seen = ~np.isin(blocks.fold, list(fit.without))
    if fit.only:
        column, value = fit.only
        place = list(blocks.grid.sizes).index(column)
        values = list(blocks.grid.categories[column])
        code = values.index(value) if value in values else -1
        seen &= blocks.grid.codes(blocks.cell)[place] == code
    cell = blocks.grid.project(blocks.cell, grid)
    kinds = [(size, name in grid.cuts) for name, size in grid.sizes.items()]
    every = grid.codes(np.arange(grid.cells))
    table, gains = np.zeros(grid.cells), 0
    for tree in trees:
        draw = seen if seed is None else np.random.default_rng([seed, tree]).poisson(1.0, len(blocks.cell)) * seen
        n = np.bincount(cell, draw * blocks.n, grid.cells)
        if not n.any():  # a bootstrap sample of very few rows can be empty
            n = np.bincount(cell, seen * blocks.n, grid.cells)
            draw = seen
        total = np.bincount(cell, draw * blocks.total, grid.cells)
        used = np.flatnonzero(n)
        values, gain = grow_tree(every[:, used], kinds, n[used], total[used], every, depth)
        table += values
        gains = gains + (gain / gain.sum() if gain.sum() > 0 else gain)
    return table, gains
