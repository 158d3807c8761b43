"""Fusing the predictions of two models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.operators.evaluate import model_metrics
from cellgauge.operators.models import (
    Cross,
    CrossFits,
    ForestModel,
    ForestSettings,
    cross_predict,
    cross_validate,
    infrastructure_model,
    score_vertical,
    train_all,
    user_behavior_model,
)
from cellgauge.sources import schema as S

WEIGHTED, META = "weighted_average", "meta_learner"
CV_FOLDS = 3


def weight_columns(mse_a: Column, mse_b: Column) -> tuple[Column, Column]:
    """Weights in proportion to 1 / error; two perfect models share equally."""
    total = mse_a + mse_b
    first = F.when(total == 0, 0.5).otherwise(mse_b / total)
    return first, 1 - first


def fusion_weights(fold_scores: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mean fold error of both models and their weights."""
    def mean(name: str) -> Column:
        return F.avg(F.when(F.col("model_name") == name, F.col("mse")))

    errors = fold_scores.agg(mean(a).alias("mse_a"), mean(b).alias("mse_b"))
    first, second = weight_columns(F.col("mse_a"), F.col("mse_b"))
    return errors.withColumns({"weight_a": first, "weight_b": second})


def weight_share(weights: DataFrame, a: str, b: str) -> DataFrame:
    """Weights in percent and the model that dominates."""
    total = F.col("weight_a") + F.col("weight_b")
    return weights.select(
        (F.col("weight_a") / total * 100).alias("share_a"),
        (F.col("weight_b") / total * 100).alias("share_b"),
        F.when(F.col("weight_a") > F.col("weight_b"), a).otherwise(b).alias("dominant"),
    )


def weighted(p_a: Column, p_b: Column, weight_a: float, weight_b: float) -> Column:
    return F.lit(weight_a) * p_a + F.lit(weight_b) * p_b


def meta_moments(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Means, variances and covariances that the least-squares fit needs, one pass."""
    usable = df.filter(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    return usable.agg(
        F.avg(y).alias("my"),
        F.avg(a).alias("ma"),
        F.avg(b).alias("mb"),
        F.var_pop(a).alias("va"),
        F.var_pop(b).alias("vb"),
        F.covar_pop(a, b).alias("cab"),
        F.covar_pop(y, a).alias("cya"),
        F.covar_pop(y, b).alias("cyb"),
    )


def meta_coefficients(moments: DataFrame) -> DataFrame:
    """Weights and intercept of y on both predictions.

    Predictions on one line have no unique fit: they get the one of least norm.
    """
    va, vb, cab = F.col("va"), F.col("vb"), F.col("cab")
    cya, cyb = F.col("cya"), F.col("cyb")
    det = va * vb - cab * cab
    trace = (va + vb) * (va + vb)
    regular = det > 1e-12 * va * vb
    fallback_a = F.when(trace > 0, (va * cya + cab * cyb) / trace).otherwise(0.0)
    fallback_b = F.when(trace > 0, (cab * cya + vb * cyb) / trace).otherwise(0.0)
    weights = moments.withColumns(
        {
            "weight_a": F.when(regular, (cya * vb - cyb * cab) / det).otherwise(fallback_a),
            "weight_b": F.when(regular, (cyb * va - cya * cab) / det).otherwise(fallback_b),
        }
    )
    intercept = (
        F.col("my") - F.col("weight_a") * F.col("ma") - F.col("weight_b") * F.col("mb")
    )
    return weights.select("weight_a", "weight_b", intercept.alias("intercept"))


def fusion_comparison(df: DataFrame, models: Mapping[str, str], y: str = "y") -> DataFrame:
    """Metrics of the components and the fused model."""
    return model_metrics(df, models, y)


class FusionModel:
    """Infrastructure and user model with a weighted average or a linear meta-learner."""

    def __init__(
        self,
        strategy: str = WEIGHTED,
        settings: ForestSettings = ForestSettings(),
        oof: bool = False,
        target: str = S.LATENCY,
    ) -> None:
        if strategy not in (WEIGHTED, META):
            raise ValueError(f"strategy must be '{WEIGHTED}' or '{META}'")
        self.name = "fusion_model"
        self.strategy = strategy
        self.settings = settings
        self.oof = oof
        self.target = target
        self.infrastructure = infrastructure_model(settings)
        self.user = user_behavior_model(settings)
        self.weights: tuple[float, float] | None = None
        self.intercept = 0.0

    @property
    def is_trained(self) -> bool:
        return self.weights is not None

    def train(self, df: DataFrame, beside: Sequence[ForestModel] = ()) -> FusionModel:
        """Train what is not trained yet, then the fusion; models `beside` it share the passes."""
        S.require_columns(df, [*S.INFRASTRUCTURE_FEATURES, *S.USER_FEATURES, self.target])
        models = [m for m in (self.infrastructure, self.user, *beside) if not m.is_trained]
        if self.strategy == WEIGHTED:
            made = {name: make() for name, make in self._makers("a", "b").items()}
            fits = train_all(df, models, [Cross(made, CV_FOLDS)])[0]
            self._train_weights(df, fits)
        else:
            train_all(df, models)
            self._train_meta(df)
        return self

    def _makers(self, a: str, b: str) -> dict[str, Callable[[], ForestModel]]:
        return {a: lambda: infrastructure_model(self.settings), b: lambda: user_behavior_model(self.settings)}

    def _out_of_fold(self, df: DataFrame) -> DataFrame:
        return cross_predict(df, self._makers("_a", "_b"), CV_FOLDS)

    def _train_weights(self, df: DataFrame, fits: CrossFits | None) -> None:
        scores = cross_validate(df, self._makers("a", "b"), CV_FOLDS, target=self.target, fits=fits)
        row = fusion_weights(scores, "a", "b").first()
        self.weights = (row["weight_a"], row["weight_b"])

    def _train_meta(self, df: DataFrame) -> None:
        scored = self._out_of_fold(df) if self.oof else self.components(df, "_a", "_b")
        row = meta_coefficients(meta_moments(scored, self.target, "_a", "_b")).first()
        self.weights = (row["weight_a"], row["weight_b"])
        self.intercept = row["intercept"]

    def components(
        self, df: DataFrame, a: str = "infrastructure_model", b: str = "user_behavior_model"
    ) -> DataFrame:
        """Both predictions side by side."""
        return score_vertical(df, {a: self.infrastructure, b: self.user})

    def fused(self, a: str, b: str) -> Column:
        if self.weights is None:
            raise ValueError(f"{self.name} must be trained first")
        return weighted(F.col(a), F.col(b), *self.weights) + F.lit(self.intercept)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        fused = self.fused("_a", "_b")
        return self.components(df, "_a", "_b").withColumn(out, fused).drop("_a", "_b")

    def compare(self, df: DataFrame) -> DataFrame:
        """Metrics of both components and of the fusion."""
        scored = self.components(df)
        scored = scored.withColumn(
            self.name, self.fused("infrastructure_model", "user_behavior_model")
        )
        names = ["infrastructure_model", "user_behavior_model", self.name]
        return fusion_comparison(scored, {n: n for n in names}, self.target)

    def parameters(self, df: DataFrame) -> DataFrame:
        """Strategy, weights and intercept as a row."""
        if self.weights is None:
            raise ValueError(f"{self.name} must be trained first")
        return df.sparkSession.createDataFrame(
            [(self.strategy, *self.weights, float(self.intercept))],
            "strategy string, weight_a double, weight_b double, intercept double",
        )
