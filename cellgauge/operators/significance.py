"""Paired tests on the absolute residuals of two models."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cellgauge.functions import texts
from cellgauge.functions.pvalues import (
    normal_two_sided,
    signed_rank_two_sided,
    student_two_sided,
    with_p_values,
)
from cellgauge.operators.ranks import rows_before

T_TEST, WILCOXON = "paired_t_test", "wilcoxon"
UNIT = 1_000_000
#: Rows up to which the signed-rank test is exact.
EXACT_ROWS = 50


def _pair_stats(y: Column, p1: Column, p2: Column) -> Column:
    r1, r2 = F.abs(y - p1), F.abs(y - p2)
    both = r1.isNotNull() & r2.isNotNull()
    d = r1 - r2
    return F.struct(
        F.avg(F.when(both, r1)).alias("mae_model1"),
        F.avg(F.when(both, r2)).alias("mae_model2"),
        F.avg(d).alias("_mean"),
        F.stddev_samp(d).alias("_samp"),
        F.stddev_pop(d).alias("_pop"),
        F.count(d).alias("sample_size"),
    )


def paired_t_tests(
    df: DataFrame, models: Mapping[str, str], y: str = "y", alpha: float = 0.05
) -> DataFrame:
    """Paired t-test of every unordered pair of models, all pairs in one aggregate.

    The statistic is undefined (NULL) when the differences do not vary.
    """
    pairs = list(combinations(models, 2))
    aggregated = df.agg(
        *[
            _pair_stats(F.col(y), F.col(models[a]), F.col(models[b])).alias(f"_p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    rows = []
    for i, (a, b) in enumerate(pairs):
        s = F.col(f"_p{i}")
        n, mean, samp, pop = s["sample_size"], s["_mean"], s["_samp"], s["_pop"]
        rows.append(
            F.struct(
                F.lit(a).alias("model1"),
                F.lit(b).alias("model2"),
                F.lit("Paired t-test").alias("test_name"),
                F.when(samp > 0, mean / (samp / F.sqrt(n))).alias("statistic"),
                F.when(pop > 0, mean / pop).otherwise(0.0).alias("effect_size"),
                s["mae_model1"].alias("mae_model1"),
                s["mae_model2"].alias("mae_model2"),
                (s["mae_model1"] - s["mae_model2"]).alias("mae_difference"),
                n.alias("sample_size"),
            )
        )
    out = aggregated.select(F.inline(F.array(*rows)))

    def p_value(row: Row) -> float | None:
        t = row["statistic"]
        return None if t is None else student_two_sided(t, row["sample_size"] - 1)

    return _judged(with_p_values(out, p_value), alpha)


def wilcoxon(
    df: DataFrame,
    p1: str,
    p2: str,
    y: str = "y",
    alpha: float = 0.05,
    unit: int = UNIT,
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """Signed-rank test, zeros split between both sides.

    Up to `exact_rows` rows without ties and zeros the p-value comes from the exact
    distribution of rank sums, else from the normal approximation with ties.

    Differences are rounded to 1 / `unit` and counted by size first, so ties of any
    size cost one row; ranks come from `rows_before`, never from one sorted partition.
    """
    r1, r2 = F.abs(F.col(y) - F.col(p1)), F.abs(F.col(y) - F.col(p2))
    units = F.round((r1 - r2) * unit).cast("bigint")
    counted = (
        df.select(units.alias("_u"))
        .filter(F.col("_u").isNotNull())
        .groupBy(F.abs("_u").alias("size"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("_u") > 0).alias("plus"),
            F.count_if(F.col("_u") < 0).alias("minus"),
        )
    )
    ranked = rows_before(counted, "size", "n")
    rank = F.col("before") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    zero = F.sum(F.when(F.col("size") == 0, rank * F.col("n")).otherwise(0.0)) / 2
    sums = ranked.agg(
        (F.sum(rank * F.col("plus")) + zero).alias("rank_plus"),
        (F.sum(rank * F.col("minus")) + zero).alias("rank_minus"),
        F.sum(n * n * n - n).alias("_ties"),
        zero.alias("_zeros"),
        F.sum("n").alias("sample_size"),
    )
    size = F.col("sample_size").cast("double")
    spread = F.sqrt(size * (size + 1) * (2 * size + 1) / 24 - F.col("_ties") / 48)
    statistic = F.least("rank_plus", "rank_minus")
    z = F.when(spread > 0, (statistic - size * (size + 1) / 4) / spread)
    out = sums.select(
        F.lit("Wilcoxon signed-rank test").alias("test_name"),
        "rank_plus",
        "rank_minus",
        statistic.alias("statistic"),
        z.alias("z"),
        "sample_size",
        "_ties",
        "_zeros",
    )

    def p_value(row: Row) -> float | None:
        if row["z"] is None:
            return None
        if row["sample_size"] <= exact_rows and not row["_ties"] and not row["_zeros"]:
            return signed_rank_two_sided(row["statistic"], row["sample_size"])
        return normal_two_sided(row["z"])

    return _judged(with_p_values(out, p_value).drop("_ties", "_zeros"), alpha)


def significance_test(
    df: DataFrame,
    p1: str,
    p2: str,
    y: str = "y",
    test_type: str = T_TEST,
    alpha: float = 0.05,
) -> DataFrame:
    if test_type == T_TEST:
        return paired_t_tests(df, {p1: p1, p2: p2}, y, alpha)
    if test_type == WILCOXON:
        return wilcoxon(df, p1, p2, y, alpha)
    raise ValueError(f"Unsupported test type: {test_type}")


def _judged(tests: DataFrame, alpha: float) -> DataFrame:
    significant = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    return tests.withColumn("alpha", F.lit(float(alpha))).withColumn(
        "is_significant", significant
    )


def verdicts(tests: DataFrame) -> DataFrame:
    """Add the sentence that says which model is better."""
    first = F.col("mae_model1") < F.col("mae_model2")
    names = [F.lit("Model 1"), F.lit("Model 2")]
    better = F.when(first, names[0]).otherwise(names[1])
    worse = F.when(first, names[1]).otherwise(names[0])
    alpha = F.col("alpha").cast("string")
    text = F.when(
        F.col("is_significant"),
        F.format_string(texts.VERDICT_SIGNIFICANT, F.col("p_value"), alpha, better, worse),
    ).otherwise(F.format_string(texts.VERDICT_NOT_SIGNIFICANT, F.col("p_value"), alpha))
    return tests.withColumn("interpretation", text)
