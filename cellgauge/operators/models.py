"""Forest regressors over the features of one column group or one location."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions import texts
from cellgauge.functions.columns import hash32, is_missing
from cellgauge.operators import cells as C
from cellgauge.operators import features as X
from cellgauge.operators import growth as G
from cellgauge.operators.clean import fit_group_medians, fit_medians
from cellgauge.operators.evaluate import fold_mse, model_metrics, require_samples
from cellgauge.operators.partition import SEGMENT
from cellgauge.operators.validate import MIN_MODEL_ROWS, check_counts, check_model_input
from cellgauge.sources import schema as S
from cellgauge.sources.tables import cached

log = logging.getLogger(__name__)

FOLD_SEED = 7
CELLS, EXACT, MLLIB = "cells", "exact", "mllib"


@dataclass(frozen=True)
class ForestSettings:
    """Which forest, and how large.

    The engine `exact` splits between any two values of all rows (see `growth`). The engine
    `cells` grows trees from one aggregate over binned features (see `cells`); a grid wider
    than it takes is left to `mllib`. There depth is bounded (30) and each level
    doubles the cost; `layout` fixes the number and order of its training partitions, so
    that the same seed gives the same forest on any cluster, at the price of one shuffle.
    `memory_mb` is what its tasks use each; `bins` is not for `exact`, `bootstrap` not for `mllib`.
    """

    trees: int = 100
    depth: int = 10
    seed: int = 42
    bins: int = 32
    layout: int | None = None
    memory_mb: int = 256
    engine: str = CELLS
    bootstrap: bool = True


class ForestModel:
    """Train, predict, evaluate. Features are fitted on the training rows."""

    def __init__(
        self,
        name: str,
        spec: X.FeatureSpec,
        settings: ForestSettings = ForestSettings(),
        location: str | None = None,
        min_rows: int = 1,
        target: str = S.LATENCY,
    ) -> None:
        self.name = name
        self.spec = spec
        self.settings = settings
        self.location = location
        self.min_rows = min_rows
        self.target = target
        self.features: X.FittedFeatures | None = None
        self.forest = None
        self.learned: Learned | None = None

    @property
    def is_trained(self) -> bool:
        return self.forest is not None

    def train(self, df: DataFrame) -> ForestModel:
        train_all(df, [self])
        return self

    def rows_of(self, df: DataFrame) -> DataFrame:
        """The rows that the model trains on."""
        return df if self.location is None else df.filter(F.col(S.LOCATION) == self.location)

    def learn(self, df: DataFrame) -> Learned:
        """What a model of its own learns of its rows before trees are grown."""
        df = self.rows_of(df)
        n = check_model_input(df, [], self.target, self.min_rows)
        features = X.fit_features(df, self.spec, n)
        cells = self.settings.engine == CELLS
        return Learned(features, C.fit_grid(df, features, self.settings.bins, n) if cells else None)

    def train_exact(self, df: DataFrame) -> None:
        """Grow a forest without bins on the features that are fitted."""
        s = self.settings
        self.forest = G.grow_forest(self.rows_of(df), self.features, self.target, s.trees, s.depth, s.seed, s.bootstrap)

    def train_mllib(self, df: DataFrame) -> None:
        """Train a forest of MLlib on the features that are fitted."""
        df = self.rows_of(df)
        if self.settings.layout:
            order = [hash32(S.KEY, self.settings.seed).alias("_h"), self.target]
            inputs = [*self.spec.numeric, *self.spec.categorical]
            df = df.select(*order, *inputs).repartition(self.settings.layout, "_h")
            df = df.sortWithinPartitions("_h", self.target, *inputs)
        rows = df.select(
            self.features.vector().alias("features"),
            F.col(self.target).cast("double").alias("label"),
        )
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.forest = RandomForestRegressor(
                numTrees=self.settings.trees,
                maxDepth=self.settings.depth,
                maxBins=self.settings.bins,
                featureSubsetStrategy="all",
                seed=self.settings.seed,
                maxMemoryInMB=self.settings.memory_mb,
            ).fit(rows)
        finally:
            rows.unpersist()

    def predict(
        self, df: DataFrame, out: str = "prediction", fill: str = "train"
    ) -> DataFrame:
        """Add the prediction. `fill='batch'` fills nulls with the medians of `df` itself."""
        features, forest = self._fitted()
        S.require_columns(df, [*self.spec.numeric, *self.spec.categorical])
        medians = fit_medians(df, self.spec.numeric) if fill == "batch" else None
        if isinstance(forest, (C.CellForest, G.GrownForest)):
            return forest.predict(df, out, medians)
        vector = f"_features_{out}"
        forest = forest.copy().setFeaturesCol(vector).setPredictionCol(out)
        return forest.transform(df.withColumn(vector, features.vector(medians))).drop(vector)

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Metrics of the model on `df`; no usable row is an error."""
        scored = self.predict(df, "_p")
        return require_samples(model_metrics(scored, {self.name: "_p"}, self.target))

    def feature_importance(self, df: DataFrame, top: int | None = None) -> DataFrame:
        """Importance by feature name, largest first. `df` lends its session only."""
        features, forest = self._fitted()
        own = isinstance(forest, (C.CellForest, G.GrownForest))
        values = (forest.importances if own else forest.featureImportances.toArray()).tolist()
        rows = sorted(zip(features.names, values), key=lambda nv: (-nv[1], nv[0]))[:top]
        return df.sparkSession.createDataFrame(
            [(self.name, i + 1, n, float(v)) for i, (n, v) in enumerate(rows)],
            "model_name string, position int, feature string, importance double",
        )

    def info(self, df: DataFrame) -> DataFrame:
        """One row that describes the model."""
        names = self.features.names if self.features else []
        row = (
            self.name,
            type(self).__name__,
            self.location,
            self.is_trained,
            self.settings.trees,
            self.settings.depth,
            self.settings.seed,
            names,
        )
        return df.sparkSession.createDataFrame(
            [row],
            "model_name string, model_type string, location string, is_trained boolean, "
            "trees int, depth int, seed int, features array<string>",
        )

    def _fitted(self):
        if self.features is None or self.forest is None:
            raise ValueError(f"{self.name} must be trained first")
        return self.features, self.forest


def grow(df: DataFrame, blocks: C.Blocks, fits: Sequence[C.Fit], settings: ForestSettings) -> list[C.CellForest]:
    return C.fit_forests(df, blocks, fits, settings.trees, settings.depth, settings.seed, settings.bootstrap)


@dataclass(frozen=True)
class Learned:
    """Medians, categories and cuts of some columns of the training rows."""

    features: X.FittedFeatures
    grid: C.Grid | None

    def part(self, spec: X.FeatureSpec) -> Learned:
        """The same of fewer columns."""
        medians = {c: self.features.medians[c] for c in spec.numeric}
        categories = {c: self.features.categories[c] for c in spec.categorical}
        grid = C.Grid({c: self.grid.cuts[c] for c in spec.numeric}, categories, medians)
        return Learned(X.FittedFeatures(spec, medians, categories), grid)

    def covers(self, spec: X.FeatureSpec) -> bool:
        return self.grid is not None and {*spec.numeric, *spec.categorical} <= {
            *self.features.spec.numeric,
            *self.features.spec.categorical,
        }


@dataclass(frozen=True)
class Cross:
    """Models to fit without each of k folds, those of `pairs` also without each two (see `cross_fit`)."""

    models: Mapping[str, ForestModel]
    k: int
    seed: int = FOLD_SEED
    pairs: Sequence[str] = ()

    @property
    def shares(self) -> bool:
        """Whether one aggregate can serve all models."""
        made = list(self.models.values())
        plain = all(
            m.settings == made[0].settings and m.location is None and m.target == made[0].target for m in made
        )
        return made[0].settings.engine == CELLS and plain

    @property
    def spec(self) -> X.FeatureSpec:
        return united([m.spec for m in self.models.values()])


def united(specs: Sequence[X.FeatureSpec]) -> X.FeatureSpec:
    """All columns of some models, each once."""
    return X.FeatureSpec(
        tuple(dict.fromkeys(c for s in specs for c in s.numeric)),
        tuple(dict.fromkeys(c for s in specs for c in s.categorical)),
    )


def learn_all(
    df: DataFrame, models: Sequence[ForestModel], crosses: Sequence[Cross] = ()
) -> dict[str | None, Learned] | None:
    """What the models of each location (None: of all rows) learn, from passes that all share.

    One pass counts rows by category, one narrowing gives medians of all rows, one of the
    locations, and one pass the cuts. None where the categories have too many combinations
    to be counted together.
    """
    specs: dict[str | None, list[X.FeatureSpec]] = {}
    for m in models:
        specs.setdefault(m.location, []).append(m.spec)
    for cross in crosses:
        specs.setdefault(None, []).append(cross.spec)
    wide = {place: united(s) for place, s in specs.items()}
    first = models[0] if models else next(iter(crosses[0].models.values()))
    every = united(list(wide.values()))
    S.require_columns(df, [*every.numeric, *every.categorical])
    places = [place for place in wide if place is not None]
    groups = list(dict.fromkeys([*([S.LOCATION] if places else []), *every.categorical]))
    counted = df.groupBy(*groups).agg(
        F.count("*").alias("_n"), F.count_if(is_missing(F.col(first.target).cast("double"))).alias("_missing")
    )
    found = counted.limit(X.MAX_CATEGORIES + 1).collect()
    if len(found) > X.MAX_CATEGORIES:
        return None
    sizes, categories = {}, {}
    for place, spec in wide.items():
        own = [r for r in found if place is None or r[S.LOCATION] == place]
        sizes[place] = sum(r["_n"] for r in own)
        missing = sum(r["_missing"] for r in own)
        for m in models:
            if m.location == place:
                check_counts(sizes[place], {m.target: missing}, m.min_rows)
        categories[place] = {
            c: sorted({texts.UNKNOWN if r[c] is None else r[c] for r in own if r["_n"]}) for c in spec.categorical
        }
    medians: dict[str | None, Mapping[str, float | None]] = {}
    if None in wide:
        numeric = wide[None].numeric
        medians[None] = fit_medians(df, numeric, rows=sizes[None]) if numeric else {}
    if places:
        numeric = united([wide[place] for place in places]).numeric
        own = df.filter(F.col(S.LOCATION).isin(places))
        medians |= fit_group_medians(own, S.LOCATION, numeric, max(sizes[p] for p in places)) if numeric else {}
    fitted = {
        place: X.FittedFeatures(spec, {c: medians[place][c] for c in spec.numeric}, categories[place])
        for place, spec in wide.items()
    }
    wanted = [
        (features, sizes[place], None if place is None else F.col(S.LOCATION) == place)
        for place, features in fitted.items()
    ]
    grids = C.fit_grids(df, wanted, first.settings.bins)
    return {place: Learned(fitted[place], grid) for place, grid in zip(fitted, grids, strict=True)}


def train_all(
    df: DataFrame,
    models: Sequence[ForestModel],
    crosses: Sequence[Cross] = (),
    learned: Learned | None = None,
) -> list[CrossFits | None]:
    """Train several models on the same rows, and fit others without folds.

    Every model is the one that its own `train` gives, but the passes over the rows are
    shared: those that learn (`learn_all`, none where `learned` of an earlier call covers
    the columns) and the one that counts the cells of all grids. Then the forests are grown
    model by model. None for a cross that has no common grid that is narrow enough.
    """
    able = [cross if cross.shares else None for cross in crosses]
    sharing = [c for c in able if c is not None]
    alike = {(m.settings.engine, m.settings.bins, m.target) for m in models}
    alike |= {(m.settings.engine, m.settings.bins, m.target) for c in sharing for m in c.models.values()}
    specs = [m.spec for m in models] + [c.spec for c in sharing]
    if learned is not None and all(m.location is None for m in models) and all(map(learned.covers, specs)):
        places = {None: learned}
    else:
        same = len(alike) == 1 and next(iter(alike))[0] == CELLS
        places = learn_all(df, models, sharing) if same else None
    if places is None and len(models) + len(sharing) > 1:
        for m in models:
            train_all(df, [m])
        return [None if c is None else train_all(df, [], [c])[0] for c in able]
    parts, todo = [], []
    for m in models:
        own = places[m.location].part(m.spec) if places else m.learn(df)
        m.features, m.learned = own.features, own
        if own.grid is not None and own.grid.cells <= C.MAX_CELLS:
            mine = None if m.location is None else F.col(S.LOCATION) == m.location
            parts.append(C.Part(own.grid, mine))
            todo.append(m)
            continue
        if own.grid is not None:
            log.warning("%s: %d cells, trained by MLlib", m.name, own.grid.cells)
        m.train_exact(df) if m.settings.engine == EXACT else m.train_mllib(df)
    for c in sharing:
        made = next(iter(c.models.values()))
        if places:
            grid = places[None].part(c.spec).grid
        else:
            grid = C.fit_grid(df, X.fit_features(df, c.spec), made.settings.bins)
        if grid.cells <= C.MAX_CELLS:
            parts.append(C.Part(grid, None, fold_of(c.k, c.seed), c.k))
            todo.append(c)
    target = models[0].target if models else next(iter(sharing[0].models.values())).target if sharing else S.LATENCY
    done: dict[int, CrossFits] = {}
    for item, blocks in zip(todo, C.fit_all_blocks(df, parts, target) if parts else (), strict=True):
        if isinstance(item, ForestModel):
            item.forest = grow(df, blocks, [C.Fit(item.name, item.spec)], item.settings)[0]
        else:
            done[id(item)] = grow_without(df, blocks, item)
    return [done.get(id(c)) if c is not None else None for c in able]


def grow_without(df: DataFrame, blocks: C.Blocks, cross: Cross) -> CrossFits:
    """All forests of a cross in one job."""
    models, k = cross.models, cross.k
    fits = [C.Fit(n, m.spec, frozenset({i})) for n, m in models.items() for i in range(k)]
    fits += [C.Fit(n, models[n].spec, frozenset(two)) for n in cross.pairs for two in combinations(range(k), 2)]
    forests = grow(df, blocks, fits, next(iter(models.values())).settings)
    return CrossFits(blocks, {(f.name, f.without): forest for f, forest in zip(fits, forests, strict=True)})


def infrastructure_model(settings: ForestSettings = ForestSettings()) -> ForestModel:
    return ForestModel("infrastructure_model", X.INFRASTRUCTURE, settings)


def user_behavior_model(settings: ForestSettings = ForestSettings()) -> ForestModel:
    return ForestModel("user_behavior_model", X.USER_BEHAVIOR, settings)


def monolithic_model(settings: ForestSettings = ForestSettings()) -> ForestModel:
    return ForestModel("monolithic_model", X.MONOLITHIC, settings)


def geographic_model(
    location: str,
    settings: ForestSettings = ForestSettings(),
    min_rows: int = MIN_MODEL_ROWS,
) -> ForestModel:
    """A model of one location; it trains on the rows of that location only."""
    name = f"{location.lower()}_model"
    return ForestModel(name, X.SEGMENT_MODEL, settings, location, min_rows)


def urban_model(settings: ForestSettings = ForestSettings()) -> ForestModel:
    return geographic_model(texts.URBAN, settings)


def rural_model(settings: ForestSettings = ForestSettings()) -> ForestModel:
    return geographic_model(texts.RURAL, settings)


def train_segments(
    df: DataFrame,
    settings: ForestSettings = ForestSettings(),
    segments: Sequence[str] = tuple(texts.KNOWN_LOCATIONS),
    min_rows: int = MIN_MODEL_ROWS,
) -> dict[str, ForestModel]:
    """One model per segment with enough rows; small segments are skipped with a warning."""
    models = segment_models(df, settings, segments, min_rows)
    train_all(df, list(models.values()))
    return models


def segment_models(
    df: DataFrame,
    settings: ForestSettings = ForestSettings(),
    segments: Sequence[str] = tuple(texts.KNOWN_LOCATIONS),
    min_rows: int = MIN_MODEL_ROWS,
) -> dict[str, ForestModel]:
    """The models of `train_segments`, not yet trained."""
    wanted = df.filter(F.col(S.LOCATION).isin(list(segments)))
    counts = {r[S.LOCATION]: r["count"] for r in wanted.groupBy(S.LOCATION).count().collect()}
    models = {}
    for segment in segments:
        if counts.get(segment, 0) < min_rows:
            log.warning("%s has %d rows, model skipped", segment, counts.get(segment, 0))
            continue
        models[segment] = geographic_model(segment, settings, min_rows)
    if not models:
        raise ValueError("no segment has enough rows for a model")
    return models


def route(
    df: DataFrame, models: Mapping[str, ForestModel], by: str = S.LOCATION
) -> DataFrame:
    """Add one prediction column per segment model, NULL outside its segment.

    The prediction sits inside the condition, so a row runs through its own forest only.
    """
    for segment, model in models.items():
        scored = model.predict(df, "_p")
        mine = F.when(F.col(by) == segment, F.col("_p"))
        df = scored.withColumn(model.name, mine).drop("_p")
    return df


def score_horizontal(
    df: DataFrame,
    global_model: ForestModel,
    models: Mapping[str, ForestModel],
    by: str = S.LOCATION,
) -> DataFrame:
    """The global prediction on all rows and the segment predictions on theirs."""
    return route(global_model.predict(df, "global_model"), models, by)


def score_vertical(df: DataFrame, models: Mapping[str, ForestModel]) -> DataFrame:
    """Predictions of all models side by side in the row of the observation."""
    return reduce(lambda scored, m: m[1].predict(scored, m[0]), models.items(), df)


def with_folds(
    df: DataFrame, k: int, seed: int = FOLD_SEED, key: str = S.KEY, out: str = "fold"
) -> DataFrame:
    """Fold of a row from the hash of its key."""
    return df.withColumn(out, fold_of(k, seed, key))


def fold_of(k: int, seed: int = FOLD_SEED, key: str = S.KEY) -> Column:
    if k < 2:
        raise ValueError("Cross-validation needs at least two folds")
    return (hash32(key, seed) % k).cast("int")


def cross_predict(
    df: DataFrame,
    factories: Mapping[str, Callable[[], ForestModel]],
    k: int,
    seed: int = FOLD_SEED,
) -> DataFrame:
    """Out-of-fold predictions: each fold is scored by models that never saw it.

    Rows with their folds are cached: every fold reads them in several passes.
    """
    folded = cached(with_folds(df, k, seed))
    parts = []
    for fold in range(k):
        train = folded.filter(F.col("fold") != fold)
        fitted = {name: make().train(train) for name, make in factories.items()}
        parts.append(score_vertical(folded.filter(F.col("fold") == fold), fitted))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class CrossFits:
    """Forests of several models without some folds, over one aggregate of the rows."""

    blocks: C.Blocks
    forests: Mapping[tuple[str, frozenset[int]], C.CellForest]

    def table(self, name: str, without: Iterable[int], whole: bool = False) -> np.ndarray:
        """Predictions by cell of the model's own grid, or of the whole grid."""
        forest = self.forests[name, frozenset(without)]
        if not whole:
            return forest.table
        return forest.table[self.blocks.grid.project(np.arange(self.blocks.grid.cells), forest.grid)]

    def errors(self, name: str, without: Iterable[int], folds: Sequence[int]) -> np.ndarray:
        """Mean squared error on each of some folds."""
        forest = self.forests[name, frozenset(without)]
        return self.blocks.errors(forest.table, forest.grid, folds)


def cross_fit(
    df: DataFrame,
    models: Mapping[str, ForestModel],
    k: int,
    seed: int = FOLD_SEED,
    pairs: Sequence[str] = (),
) -> CrossFits | None:
    """Each model without each fold, those of `pairs` also without each two folds.

    A forest without folds i and j serves the inner folds of both, so scores of a model that
    is itself tuned on folds cost k (k - 1) / 2 more forests, all grown in one job from one
    pass over the rows. Medians, categories and cuts come from the features of all rows.
    None when the models have no common grid that is narrow enough.
    """
    return train_all(df, [], [Cross(models, k, seed, pairs)])[0]


def cross_validate(
    df: DataFrame,
    factories: Mapping[str, Callable[[], ForestModel]],
    k: int = 5,
    seed: int = FOLD_SEED,
    target: str = S.LATENCY,
    fused: tuple[str, str, str] | None = None,
    learned: Learned | None = None,
    fits: CrossFits | None = None,
) -> DataFrame:
    """Mean squared error of every model on every fold.

    `fused` names a weighted fusion and its two members: on each outer fold its weights come
    from the other folds, each predicted by members that saw neither. That needs a common
    aggregate of the models (see `cross_fit`); without one it is an error. What an earlier
    training learned of the same rows (`learned`), or the fits themselves, save the passes.
    """
    made = {name: make() for name, make in factories.items()}
    if fits is None:
        fits = train_all(df, [], [Cross(made, k, seed, fused[1:] if fused else ())], learned)[0]
    if fits is None:
        if fused:
            raise ValueError("scores of a fusion need models on one narrow grid")
        scored = cross_predict(df, factories, k, seed)
        return fold_mse(scored, {n: n for n in factories}, "fold", target)
    rows = [(i, name, fits.errors(name, {i}, [i])[0]) for name in made for i in range(k)]
    if fused:
        rows += [(i, fused[0], error) for i, error in enumerate(fused_errors(fits, fused[1], fused[2], k))]
    # A fold without rows has no error.
    rows = [(i, name, None if np.isnan(error) else float(error)) for i, name, error in rows]
    return df.sparkSession.createDataFrame(rows, "fold int, model_name string, mse double")


def fused_errors(fits: CrossFits, a: str, b: str, k: int) -> list[float]:
    """Error on each fold of the weighted fusion that never saw it."""
    out = []
    for i in range(k):
        others = [j for j in range(k) if j != i]
        inner = [np.nanmean([fits.errors(name, {i, j}, [j])[0] for j in others]) for name in (a, b)]
        share = 0.5 if sum(inner) == 0 else inner[1] / sum(inner)
        table = share * fits.table(a, {i}, True) + (1 - share) * fits.table(b, {i}, True)
        out.append(fits.blocks.errors(table, fits.blocks.grid, [i])[0])
    return out
