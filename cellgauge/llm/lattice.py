"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected to eight dimensions in several tables and decoded to points of
the E8 lattice. A vector is stored under its own cell and probes the nearest of the 240
neighbouring cells; what meets in a cell is verified by its cosine. Equal vectors are one
class before that, so copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.components import connected_components
from cellgauge.llm.store import shuffle_partitions, written
from cellgauge.llm.text import one_array

#: Pairs whose cosines are computed at once.
PAIR_BLOCK = 1 << 17
#: Links of a task that wait to be counted.
WAITING = 1 << 20
SHORT_CELL = 32


@dataclass(frozen=True)
class Lattice:
    """Parameters: tables, probed neighbours, size of a cell, seed of the projections.

    The size of a cell is in units of the usual distance that a pair at the threshold
    `least` keeps in a projection, which depends on the vectors' width. Up to `cell_rows`
    rows of a cell meet in one block; a larger cell is cut into parts of about that size.
    """

    tables: int = 4
    probes: int = 6
    cell: float = 1.2
    seed: int = 42
    least: float = 0.93
    cell_rows: int = 1 << 14


@cache
def projection(lattice: Lattice, table: int, width: int) -> np.ndarray:
    """Eight random directions of one table, orthonormal where the width allows."""
    drawn = np.random.default_rng([lattice.seed, table, width]).standard_normal((max(width, 8), 8))
    distance = np.sqrt(max(2 - 2 * lattice.least, 1e-4) * min(1.0, 8 / width))
    return np.linalg.qr(drawn)[0][:width] / (lattice.cell * distance)


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    halves = (np.array(v) for v in product((0.5, -0.5), repeat=8))
    return np.array([*out, *(v for v in halves if (v < 0).sum() % 2 == 0)])


def nearest_even(z: np.ndarray) -> np.ndarray:
    """Nearest whole-number points with an even sum."""
    near = np.rint(z)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    rest = z - near
    worst = np.abs(rest).argmax(axis=1)[odd]
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def decode(z: np.ndarray) -> np.ndarray:
    """Nearest point of E8: that of the even whole points or of those moved by one half."""
    whole, half = nearest_even(z), nearest_even(z - 0.5) + 0.5
    closer = ((z - whole) ** 2).sum(axis=1) <= ((z - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def cell_key(points: np.ndarray) -> np.ndarray:
    """64-bit key of lattice points."""
    key = np.zeros(points.shape[:-1], dtype=np.uint64)
    for c in np.moveaxis((2 * points).astype(np.int64).astype(np.uint64), -1, 0):
        key = (key ^ c) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def cells(unit: np.ndarray, lattice: Lattice, table: int) -> np.ndarray:
    """Keys per vector: its own cell, then the nearest neighbours of its projection."""
    z = unit @ projection(lattice, table, unit.shape[1])
    own = decode(z)
    out = np.empty((len(z), lattice.probes + 1), dtype=np.int64)
    out[:, 0] = cell_key(own)
    for begin in range(0, len(z), 4096):
        part = slice(begin, begin + 4096)
        # |r - m|^2 is smallest where r.m - |m|^2 / 2 is largest; all m are equally long.
        gain = (z[part] - own[part]) @ neighbours().T
        near = np.argsort(-gain, axis=1, kind="stable")[:, : lattice.probes]
        out[part, 1:] = cell_key(own[part][:, None, :] + neighbours()[near])
    return out


def units(column: pa.Array) -> np.ndarray:
    """Vectors of one width as double-precision unit vectors, a row each."""
    flat = one_array(column).flatten().to_numpy().astype(np.float64)
    held = flat.reshape(len(column), -1)
    return held / np.linalg.norm(held, axis=1)[:, None]


def eligible(vector: str) -> F.Column:
    """Not null, without null or non-finite components, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


CELL = ["tab", "cell", "label"]
HELD = ["label", "rep", "copies", "vec"]


def _cell_rows(lattice: Lattice, width: int, carried: list[str] = HELD):
    """Rows of every cell that a vector is stored in or probes, with the `carried` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = units(batch["vec"])
            for table in range(lattice.tables):
                keys = cells(unit, lattice, table)
                for k in range(keys.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(batch), table), pa.int32()),
                            pa.array(keys[:, k]),
                            pa.array(np.full(len(batch), k == 0)),
                            *(batch[c] for c in carried),
                        ],
                        ["tab", "cell", "own", *carried],
                    )

    return run


def _blocks(classes: DataFrame, lattice: Lattice, width: int) -> DataFrame:
    """Rows of all cells, dealt to tasks by cell and block.

    A cell of more than `cell_rows` rows has several parts. Any two parts meet in a block
    (low, high) of their own, and each part with itself, so that no task takes more than
    two parts of a cell and every pair of the cell meets in one block.
    """
    keyed = classes.mapInArrow(_cell_rows(lattice, width, ["label"]), "tab int, cell long, own boolean, label long")
    large = keyed.groupBy(*CELL).count().where(F.col("count") > lattice.cell_rows)
    large = large.select(*CELL, F.ceil(F.col("count") / lattice.cell_rows).alias("parts"))
    schema = "tab int, cell long, own boolean, label long, rep long, copies long, vec array<float>"
    rows = classes.select(*HELD).mapInArrow(_cell_rows(lattice, width), schema)
    rows = rows.join(written(large, "large-cells"), CELL, "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    rows = rows.withColumns({"low": low, "high": high}).drop("parts", "other")
    tasks = 4 * shuffle_partitions(classes.sparkSession)
    return rows.repartition(tasks, *CELL, "low", "high")


def _candidates(group: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within equal values of a sorted column, blockwise; of two probes none."""
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, int)
    size = np.diff(np.append(begin, len(group)))
    short = np.repeat(size <= SHORT_CELL, size)
    for d in range(1, int(min(size.max(initial=0), SHORT_CELL))):
        i = np.flatnonzero((group[:-d] == group[d:]) & short[:-d] & (own[:-d] | own[d:]))
        yield i, i + d
    for k in np.flatnonzero(size > SHORT_CELL):
        rows = np.arange(begin[k], begin[k] + size[k])
        stored = rows[own[rows]]
        step = max(1, PAIR_BLOCK // len(rows))
        for at in range(0, len(stored), step):
            a = np.repeat(stored[at : at + step], len(rows))
            b = np.tile(rows, len(stored[at : at + step]))
            keep = (a < b) | ((a > b) & ~own[b])
            yield a[keep], b[keep]


def _first_meeting(keys: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the first meeting of each pair: table, and which of its cells.

    In a table a pair meets in its common own cell, else in the cell of the smaller
    vector if the larger probes it, else the other way round.
    """
    first = np.full(len(a), 1 << 30)
    for table in reversed(range(len(keys))):
        x, y = keys[table][a], keys[table][b]
        to_x = (y == x[:, :1]).any(axis=1)
        to_y = (x == y[:, :1]).any(axis=1)
        first = np.where(to_x, 2 * table, np.where(to_y, 2 * table + 1, first))
    return first


class _Links:
    """Links of one task, added up as they come: what is held follows the vectors, not their links."""

    def __init__(self, unit: np.ndarray, weight: np.ndarray, lattice: Lattice):
        self.unit, self.weight, self.lattice = unit, weight, lattice
        self.known = np.zeros(len(unit), dtype=bool)
        self.keys = [np.empty((len(unit), lattice.probes + 1), dtype=np.int64) for _ in range(lattice.tables)]
        self.n = np.zeros(len(unit), dtype=np.int64)
        self.root = np.arange(len(unit))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray, met: np.ndarray) -> None:
        """Pairs of vectors, and the number of the meeting at which each was found."""
        self.waiting.append((a, b, met))
        self.size += len(a)
        if self.size >= WAITING:
            self.count()

    def count(self) -> None:
        """Count the waiting links at their first meeting, and join what they connect."""
        if not self.size:
            return
        a, b, met = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting, self.size = [], 0
        fresh = np.unique(np.concatenate([a, b]))
        fresh = fresh[~self.known[fresh]]
        self.known[fresh] = True
        for table, keys in enumerate(self.keys):
            keys[fresh] = cells(self.unit[fresh], self.lattice, table)
        for begin in range(0, len(a), PAIR_BLOCK):
            part = slice(begin, begin + PAIR_BLOCK)
            first = _first_meeting(self.keys, a[part], b[part]) == met[part]
            x, y = a[part][first], b[part][first]
            np.add.at(self.n, x, self.weight[y])
            np.add.at(self.n, y, self.weight[x])
        every = np.arange(len(self.root))
        self.root = _roots(np.append(a, every), np.append(b, self.root), len(self.root))


def _verify(lattice: Lattice, least: float):
    """Links of one task's cells: per vector a share of its links, and what connects it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        tab, cell, label, low, high, rep, copies, side = (
            rows[c].to_numpy().astype(np.int64) for c in (*CELL, "low", "high", "rep", "copies", "part")
        )
        own = rows["own"].to_numpy()
        order = np.lexsort((rep, high, low, cell, label, tab))
        group = np.zeros(len(order), dtype=np.int64)
        fresh = np.zeros(len(order) - 1, dtype=bool)
        for c in (tab, label, cell, low, high):
            fresh |= c[order][1:] != c[order][:-1]
        group[1:] = np.cumsum(fresh)
        tab, rep, copies, own, side = tab[order], rep[order], copies[order], own[order], side[order]
        # Where two parts meet, the pairs within one of them belong to another block.
        mixed = (low != high)[order]
        # A vector may have several rows here; its components are held once.
        names, at = np.unique(rep, return_inverse=True)
        one = np.empty(len(names), dtype=np.int64)
        one[at] = order
        unit = units(one_array(rows["vec"]).take(pa.array(one)))
        weight = np.empty(len(names), dtype=np.int64)
        weight[at] = copies
        links = _Links(unit, weight, lattice)
        for i, j in _candidates(group, own):
            for begin in range(0, len(i), PAIR_BLOCK):
                x, y = i[begin : begin + PAIR_BLOCK], j[begin : begin + PAIR_BLOCK]
                swap = rep[x] > rep[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                here = ~mixed[x] | (side[x] != side[y])
                x, y = x[here], y[here]
                ok = np.einsum("ij,ij->i", unit[at[x]], unit[at[y]]) >= least
                x, y = x[ok], y[ok]
                links.add(at[x], at[y], tab[x] * 2 + ~own[x])
        links.count()
        linked = np.flatnonzero(links.known)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[linked]), pa.array(links.n[linked]), pa.array(names[links.root[linked]])],
            ["rep", "n", "head"],
        )

    return run


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable within one task's links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(
    vectors: DataFrame,
    least: float = 0.93,
    lattice: Lattice = Lattice(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of one label link if their cosine, in double precision, is `least` or more.
    Null labels, null, zero, or non-finite vectors link with nothing and are components
    of their own. Vectors of different widths never link. Equal vectors of a label are
    copies that share all links. An id may have several vectors; a null id stays null,
    links as any other and names no component: one that only such rows are in has none.
    Repeated rows are copies; no rows give none; other columns are not read.
    """
    lattice = replace(lattice, least=least)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<float>").alias("vec"),
        F.col(label_col).cast("long").alias("label"),
    )
    usable = F.col("label").isNotNull() & eligible("vec")
    able = rows.where(usable)
    # A class of equal vectors has a number of its own, fixed by writing it; its ids only name it.
    classes = able.groupBy("label", "vec").agg(F.min("id").alias("name"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    # Vectors of one width at a time: a width is a matrix shape, and there are few.
    widths = [r[0] for r in classes.select(F.size("vec").alias("w")).distinct().collect()]
    parts = None
    for width in widths:
        met = _blocks(classes.where(F.size("vec") == width), lattice, width)
        part = met.mapInArrow(_verify(lattice, least), "rep long, n long, head long")
        parts = part if parts is None else parts.union(part)
    if parts is None:
        lone = F.col("id").alias("component_id")
        return _named(rows.select("id", F.lit(0).cast("long").alias("n_links"), lone), id_col)
    links = written(parts, "vector-links")
    degree = links.groupBy("rep").agg(F.sum("n").alias("n"))
    linked = connected_components(links.select(F.col("rep").alias("a"), F.col("head").alias("b")))
    joined = classes.join(degree, "rep", "left").join(
        linked.select(F.col("node").alias("rep"), "component"), "rep", "left"
    )
    named = written(
        joined.select(
            "label",
            "vec",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
            "name",
        ),
        "vector-classes",
    )
    names = named.groupBy("component").agg(F.min("name").alias("component_id"))
    named = named.drop("name").join(names, "component")
    some = able.join(named, ["label", "vec"]).select("id", "n_links", "component_id")
    none = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return _named(some.union(none), id_col)


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return rows.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
