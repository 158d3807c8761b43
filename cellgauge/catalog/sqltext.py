"""Common table expressions that the SQL twins share."""

from __future__ import annotations

NETWORK = """network AS (
  SELECT
    concat('T', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS tower_id,
    CASE WHEN l_partkey % 211 = 0 THEN 5.0E0
         WHEN l_quantity = 13 THEN NULL ELSE -50.0E0 - l_quantity END AS signal_strength,
    CASE WHEN l_partkey % 223 = 0 THEN -1.0E0
         WHEN l_partkey % 37 = 0 THEN NULL ELSE l_extendedprice / 250.0E0 END AS network_traffic,
    CASE WHEN l_suppkey = 41 THEN NULL
         ELSE (5.0E0 + l_extendedprice / 2000.0E0 + p_size * 0.5E0 + l_quantity * 0.5E0
               + l_tax * 100.0E0)
              * (CASE WHEN l_orderkey % 97 = 0 THEN 3.0E0 ELSE 1.0E0 END) END AS latency,
    CASE WHEN p_size = 7 THEN NULL WHEN l_orderkey % 499 = 0 THEN -3
         ELSE p_size + 10 END AS user_count,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Mobile' WHEN '2-HIGH' THEN 'Laptop'
         WHEN '3-MEDIUM' THEN 'Smartphone' WHEN '5-LOW' THEN 'Tablet'
         ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'Satellite' ELSE NULL END END AS device_type,
    CASE l_returnflag WHEN 'A' THEN 'Urban' WHEN 'R' THEN 'Rural'
         ELSE CASE WHEN l_linestatus = 'O' THEN 'Suburban' ELSE NULL END END AS location_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

NEEDS = "(location_type IS NULL OR location_type NOT IN ('Urban', 'Rural'))"

SCORE = """(CASE WHEN user_count > 40 THEN 2 WHEN user_count > 25 THEN 1 ELSE 0 END
  + CASE WHEN signal_strength > -80 THEN 2 WHEN signal_strength > -90 THEN 1 ELSE 0 END
  + CASE WHEN network_traffic > 200 THEN 1 ELSE 0 END)"""

LOCATED = f"""CASE WHEN NOT {NEEDS} THEN location_type
  WHEN {SCORE} >= 3 THEN 'Urban' ELSE 'Rural' END"""

SEGMENT = f"""CASE WHEN NOT {NEEDS} THEN location_type
  WHEN user_count > 50 AND signal_strength > -85 THEN 'Urban' ELSE 'Rural' END"""

CUT = 858993459  # floor(0.2 * 2^32)


def hash32(seed: int, key: str = "tower_id") -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || coalesce({key}, '')), 1, 8)) AS BIGINT)"


SPLIT = f"CASE WHEN {hash32(42)} < {CUT} THEN 'test' ELSE 'train' END"

CLEAN = f"""medians AS (
  SELECT median(signal_strength) AS m1, median(network_traffic) AS m2,
         median(CAST(user_count AS DOUBLE)) AS m3 FROM network
), device_mode AS (
  SELECT device_type AS m4 FROM network WHERE device_type IS NOT NULL
  GROUP BY device_type ORDER BY count(*) DESC, device_type LIMIT 1
), imputed AS (
  SELECT tower_id, coalesce(signal_strength, m1) AS signal_strength,
         coalesce(network_traffic, m2) AS network_traffic, latency,
         coalesce(CAST(user_count AS DOUBLE), m3) AS user_count,
         coalesce(device_type, (SELECT m4 FROM device_mode), 'Unknown') AS device_type,
         coalesce(location_type, 'Unknown') AS location_type
  FROM network, medians
), quartiles AS (
  SELECT quantile_cont(signal_strength, 0.25) AS a1, quantile_cont(signal_strength, 0.75) AS b1,
         quantile_cont(network_traffic, 0.25) AS a2, quantile_cont(network_traffic, 0.75) AS b2,
         quantile_cont(latency, 0.25) AS a3, quantile_cont(latency, 0.75) AS b3,
         quantile_cont(user_count, 0.25) AS a4, quantile_cont(user_count, 0.75) AS b4
  FROM imputed
), fences AS (
  SELECT a1 - 1.5 * (b1 - a1) AS lo1, b1 + 1.5 * (b1 - a1) AS hi1,
         a2 - 1.5 * (b2 - a2) AS lo2, b2 + 1.5 * (b2 - a2) AS hi2,
         a3 - 1.5 * (b3 - a3) AS lo3, b3 + 1.5 * (b3 - a3) AS hi3,
         a4 - 1.5 * (b4 - a4) AS lo4, b4 + 1.5 * (b4 - a4) AS hi4
  FROM quartiles
), capped AS (
  SELECT tower_id,
         CASE WHEN signal_strength < lo1 THEN lo1 WHEN signal_strength > hi1 THEN hi1
              ELSE signal_strength END AS signal_strength,
         CASE WHEN network_traffic < lo2 THEN lo2 WHEN network_traffic > hi2 THEN hi2
              ELSE network_traffic END AS network_traffic,
         CASE WHEN latency < lo3 THEN lo3 WHEN latency > hi3 THEN hi3
              ELSE latency END AS latency,
         CASE WHEN user_count < lo4 THEN lo4 WHEN user_count > hi4 THEN hi4
              ELSE user_count END AS user_count,
         device_type, location_type
  FROM imputed, fences
), cleaned AS (
  SELECT tower_id, signal_strength, network_traffic, latency,
         CAST(round_even(user_count, 0) AS INTEGER) AS user_count, device_type, location_type
  FROM capped WHERE latency IS NOT NULL
)"""

LOCATED_CLEAN = f"""located AS (
  SELECT * REPLACE ({LOCATED} AS location_type) FROM cleaned
)"""

STRATIFIED = f"""hashed AS (SELECT *, {hash32(42)} AS h FROM located),
numbered AS (
  SELECT location_type, h, row_number() OVER (PARTITION BY location_type ORDER BY h) AS rn,
         count(*) OVER (PARTITION BY location_type) AS n FROM hashed
), cuts AS (
  SELECT location_type AS cut_location, max(h) AS cut FROM numbered
  WHERE rn <= ceil(0.2 * n) GROUP BY location_type
), stratified AS (
  SELECT hashed.* EXCLUDE (h), CASE WHEN h <= cut THEN 'test' ELSE 'train' END AS split
  FROM hashed JOIN cuts ON location_type IS NOT DISTINCT FROM cut_location
)"""

FOLDS = 3


def _fold_case(model: str, x: str) -> str:
    arms = " ".join(
        f"WHEN {f} THEN {model}_s{f} * {x} + {model}_i{f}" for f in range(FOLDS)
    )
    return f"CASE fold {arms} END"


def _regression(name: str, x: str, where: str) -> str:
    condition = f"FILTER (WHERE split = 'train' AND {where})"
    return (
        f"regr_slope(y, {x}) {condition} AS {name}_s, "
        f"regr_intercept(y, {x}) {condition} AS {name}_i"
    )


def _fold_regressions() -> str:
    parts = []
    for model, x in (("a", "x1"), ("b", "x2")):
        for f in range(FOLDS):
            condition = f"FILTER (WHERE split = 'train' AND fold <> {f})"
            parts.append(
                f"regr_slope(y, {x}) {condition} AS {model}_s{f}, "
                f"regr_intercept(y, {x}) {condition} AS {model}_i{f}"
            )
    return ", ".join(parts)


BASE = f"""base AS (
  SELECT tower_id, latency AS y, network_traffic AS x1, CAST(user_count AS DOUBLE) AS x2,
         device_type, location_type, {LOCATED} AS segment, {SPLIT} AS split,
         CAST({hash32(7)} % {FOLDS} AS INTEGER) AS fold
  FROM cleaned
), fits AS (
  SELECT {_regression("a", "x1", "TRUE")}, {_regression("b", "x2", "TRUE")},
         {_regression("u", "x1", "segment = 'Urban'")},
         {_regression("r", "x1", "segment = 'Rural'")},
         {_fold_regressions()}
  FROM base
), group_means AS (
  SELECT device_type, location_type, avg(y) AS m FROM base WHERE split = 'train' GROUP BY ALL
), single AS (
  SELECT base.*, a_s * x1 + a_i AS infrastructure_model, b_s * x2 + b_i AS user_behavior_model,
         m AS monolithic_model, {_fold_case("a", "x1")} AS oof_a, {_fold_case("b", "x2")} AS oof_b,
         CASE WHEN segment = 'Urban' THEN u_s * x1 + u_i END AS urban_model,
         CASE WHEN segment = 'Rural' THEN r_s * x1 + r_i END AS rural_model
  FROM base CROSS JOIN fits LEFT JOIN group_means USING (device_type, location_type)
)"""

FOLD_MSE = """fold_mse AS (
  SELECT fold, 'infrastructure_model' AS model_name, avg((y - oof_a) * (y - oof_a)) AS mse
  FROM single WHERE split = 'train' GROUP BY fold
  UNION ALL
  SELECT fold, 'user_behavior_model', avg((y - oof_b) * (y - oof_b))
  FROM single WHERE split = 'train' GROUP BY fold
)"""

WEIGHTS = """weights AS (
  SELECT mse_a, mse_b,
         CASE WHEN mse_a + mse_b = 0 THEN 0.5 ELSE mse_b / (mse_a + mse_b) END AS weight_a,
         CASE WHEN mse_a + mse_b = 0 THEN 0.5 ELSE 1 - mse_b / (mse_a + mse_b) END AS weight_b
  FROM (SELECT avg(mse) FILTER (WHERE model_name = 'infrastructure_model') AS mse_a,
               avg(mse) FILTER (WHERE model_name = 'user_behavior_model') AS mse_b FROM fold_mse)
)"""

META = """moments AS (
  SELECT avg(y) AS my, avg(infrastructure_model) AS ma, avg(user_behavior_model) AS mb,
         var_pop(infrastructure_model) AS va, var_pop(user_behavior_model) AS vb,
         covar_pop(infrastructure_model, user_behavior_model) AS cab,
         covar_pop(y, infrastructure_model) AS cya, covar_pop(y, user_behavior_model) AS cyb
  FROM single WHERE split = 'train'
), meta AS (
  SELECT wa AS meta_a, wb AS meta_b, my - wa * ma - wb * mb AS meta_c
  FROM (SELECT *, (cya * vb - cyb * cab) / (va * vb - cab * cab) AS wa,
               (cyb * va - cya * cab) / (va * vb - cab * cab) AS wb FROM moments)
)"""

SCORED = """scored AS (
  SELECT single.*,
         weight_a * infrastructure_model + weight_b * user_behavior_model AS fusion_weighted,
         meta_a * infrastructure_model + meta_b * user_behavior_model + meta_c AS fusion_meta,
         coalesce(urban_model, rural_model) AS specialised
  FROM single, weights, meta
)"""

MODELS = [
    "infrastructure_model",
    "user_behavior_model",
    "monolithic_model",
    "fusion_weighted",
    "fusion_meta",
]
TYPES = {
    "infrastructure_model": "InfrastructureModel",
    "user_behavior_model": "UserBehaviorModel",
    "monolithic_model": "MonolithicModel",
    "fusion_weighted": "FusionModel",
    "fusion_meta": "FusionModel",
}


def metric_columns(p: str) -> str:
    """Metric expressions of one prediction column against y."""
    u = f"FILTER (WHERE y IS NOT NULL AND {p} IS NOT NULL)"
    e = f"(y - {p})"
    return f"""avg(abs{e}) {u} AS mae, sqrt(avg({e} * {e}) {u}) AS rmse,
      1 - sum({e} * {e}) {u} / (var_pop(y) {u} * count(*) {u}) AS r2,
      avg(CASE WHEN y <> 0 THEN abs({e} / y) END) {u} * 100 AS mape,
      avg({e}) {u} AS mean_residual, stddev_pop({e}) {u} AS std_residual,
      count(*) {u} AS sample_size"""


def metrics_select(models: list[str], source: str, by: str = "", group: str = "") -> str:
    """Metrics of several prediction columns, one row per group and model."""
    prefix = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {prefix}'{m}' AS model_name, {metric_columns(m)} FROM {source} {group}"
        for m in models
    )


METRIC_NAMES = ["mae", "rmse", "r2", "mape", "mean_residual", "std_residual"]

TYPE_CASE = (
    "CASE model_name "
    + " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in TYPES.items())
    + " END AS model_type"
)

METRICS = f"""metrics AS (
  SELECT *, {TYPE_CASE} FROM ({metrics_select(MODELS, "scored", group="WHERE split = 'test'")})
)"""

SUBSETS = """subsets AS (
  {} UNION ALL {}
), horizontal AS (
  SELECT * REPLACE (CASE WHEN scope = 'specialised' THEN lower(segment) || '_model'
                         WHEN segment IS NULL THEN 'global_model'
                         ELSE 'global_model_' || lower(segment) END AS model_name)
  FROM (SELECT *, model_name AS scope FROM subsets)
  WHERE NOT (scope = 'specialised' AND segment IS NULL)
)""".format(
    *[
        f"SELECT segment, '{name}' AS model_name, {metric_columns(p)} FROM single "
        "WHERE split = 'test' GROUP BY ROLLUP (segment)"
        for name, p in (
            ("global", "infrastructure_model"),
            ("specialised", "coalesce(urban_model, rural_model)"),
        )
    ]
)


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


RAW = (NETWORK,)
CLEANED = (NETWORK, CLEAN)
LOCATED_ROWS = (NETWORK, CLEAN, LOCATED_CLEAN)
STRATIFIED_ROWS = (NETWORK, CLEAN, LOCATED_CLEAN, STRATIFIED)
SINGLE = (NETWORK, CLEAN, BASE)
FOLD_SCORES = (NETWORK, CLEAN, BASE, FOLD_MSE)
FUSED = (NETWORK, CLEAN, BASE, FOLD_MSE, WEIGHTS, META, SCORED)
TESTED = (*FUSED, METRICS)
HORIZONTAL = (NETWORK, CLEAN, BASE, SUBSETS)
