"""Queries on the observation table: validation, profile, cleaning, partitioning, features."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.catalog import sqltext as Q
from cellgauge.catalog.registry import query, rounded, sql_rounded
from cellgauge.functions import texts
from cellgauge.functions.columns import hash32
from cellgauge.operators import clean, features, partition, profile, validate
from cellgauge.operators.quantiles import quantile_name, quantiles
from cellgauge.sources import schema as S
from cellgauge.session import shared_folder
from cellgauge.sources.network import network, observations
from cellgauge.sources.tables import load_observations, read_table

COLUMNS = ", ".join(S.REQUIRED)
NUMBERS = S.NUMERIC_COLUMNS


def sql(*ctes: str, select: str) -> str:
    return Q.with_ctes(*ctes, select=select)


def located(spark, sf_dir) -> DataFrame:
    return partition.location_heuristic(clean.preprocess(observations(spark, sf_dir)))


# --- sources and validation ---------------------------------------------------------


@query("scan_network", sql(*Q.RAW, select=f"SELECT {COLUMNS} FROM network"))
def scan_network(spark, sf_dir):
    return S.apply_contract(network(spark, sf_dir))


@query(
    "null_counts",
    sql(
        *Q.RAW,
        select=" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null "
            "FROM network"
            for c in S.REQUIRED
        ),
    ),
)
def null_counts(spark, sf_dir):
    return validate.null_counts(network(spark, sf_dir))


def _bad(seed: int) -> str:
    return f"{Q.hash32(seed)} < {Q.CUT // 10}"


@query(
    "cast_report",
    sql(
        *Q.RAW,
        select=" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {rule}) AS n_failed FROM network"
            for c, rule in {
                **dict.fromkeys(S.REQUIRED, "FALSE"),
                S.LATENCY: _bad(3),
                S.USERS: _bad(4),
            }.items()
        ),
    ),
)
def cast_report(spark, sf_dir):
    """What a text copy of the table loses in parsing, with bad values by a key rule."""
    df = network(spark, sf_dir)
    bad = {S.LATENCY: (3, "n/a"), S.USERS: (4, "99999999999")}
    text = {c: F.col(c).cast("string") for c in S.REQUIRED}
    for c, (seed, value) in bad.items():
        text[c] = F.when(hash32(S.KEY, seed) < Q.CUT // 10, value).otherwise(text[c])
    return S.cast_failures(df.select(*[v.alias(c) for c, v in text.items()]))


def _written_lines(spark, sf_dir) -> str:
    """A JSON copy of the table in the shared folder, lines cut off by a key rule."""
    df = network(spark, sf_dir).select(*S.REQUIRED)
    line = F.to_json(F.struct(*S.REQUIRED))
    line = F.when(hash32(S.KEY, 5) < Q.CUT // 10, F.substring(line, 1, 25)).otherwise(line)
    path = f"{shared_folder(spark)}/lines-{uuid4().hex}"
    df.select(line.alias("value")).write.text(path)
    return path


@query("read_lines", sql(*Q.RAW, select=f"SELECT {COLUMNS} FROM network WHERE NOT {_bad(5)}"))
def read_lines(spark, sf_dir):
    """The table from a written copy with broken lines, under the contract."""
    return load_observations(spark, _written_lines(spark, sf_dir), "json")


@query(
    "broken_lines",
    sql(
        *Q.RAW,
        select=" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {rule}) AS n_failed FROM network"
            for c, rule in {**dict.fromkeys(S.REQUIRED, "FALSE"), S.CORRUPT: _bad(5)}.items()
        ),
    ),
)
def broken_lines(spark, sf_dir):
    """What the copy loses: broken lines are counted as lines, not as missing values."""
    return S.cast_failures(read_table(spark, _written_lines(spark, sf_dir), "json"))


def _sql_quote(text: str) -> str:
    return text.replace("'", "''")


def _report_sql() -> str:
    devices = ", ".join(f"'{d}'" for d in texts.KNOWN_DEVICES)
    rules = [
        (f"{c}_missing", c, "warning", f"{c} IS NULL", texts.MSG_NULLS.format(name=shown))
        for c, shown in S.DISPLAY_NAMES.items()
    ]
    rules += [
        (
            "signal_range",
            S.SIGNAL,
            "error",
            "signal_strength > 0 OR signal_strength < -150",
            texts.MSG_SIGNAL,
        ),
        ("traffic_range", S.TRAFFIC, "error", "network_traffic < 0", texts.MSG_TRAFFIC),
        ("latency_range", S.LATENCY, "error", "latency <= 0", texts.MSG_LATENCY),
        ("users_range", S.USERS, "error", "user_count < 0", texts.MSG_USERS),
        ("device_domain", S.DEVICE, "warning", f"device_type NOT IN ({devices})", texts.MSG_DEVICE),
        (
            "location_domain",
            S.LOCATION,
            "error",
            "location_type NOT IN ('Urban', 'Rural')",
            texts.MSG_LOCATION,
        ),
    ]
    parts = [
        f"SELECT '{n}' AS rule, '{c}' AS column_name, '{s}' AS severity, "
        f"count(*) FILTER (WHERE {p}) AS n_bad, '{_sql_quote(m)}' AS template FROM network"
        for n, c, s, p, m in rules
    ]
    parts.append(
        "SELECT 'duplicate_key', 'tower_id', 'error', "
        "CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM network GROUP BY tower_id)) "
        f"AS BIGINT), '{texts.MSG_DUPLICATES}'"
    )
    return " UNION ALL ".join(parts)


REPORT = f"report AS ({_report_sql()})"


@query(
    "validation_report",
    sql(
        *Q.RAW,
        REPORT,
        select="SELECT rule, column_name, severity, n_bad, CASE WHEN n_bad > 0 THEN "
        "replace(template, '%d', CAST(n_bad AS VARCHAR)) END AS message FROM report",
    ),
)
def validation_report(spark, sf_dir):
    return validate.validation_report(network(spark, sf_dir))


@query(
    "validation_verdict",
    sql(
        *Q.RAW,
        REPORT,
        select="SELECT bool_and(NOT (n_bad > 0 AND severity = 'error')) AS is_valid, "
        "count(*) FILTER (WHERE n_bad > 0 AND severity = 'error') AS n_errors, "
        "count(*) FILTER (WHERE n_bad > 0 AND severity = 'warning') AS n_warnings FROM report",
    ),
)
def validation_verdict(spark, sf_dir):
    return validate.validation_verdict(validate.validation_report(network(spark, sf_dir)))


@query(
    "invalid_categories",
    sql(
        *Q.RAW,
        select="SELECT 'device_type' AS column_name, device_type AS value, count(*) AS n "
        "FROM network WHERE device_type NOT IN ("
        + ", ".join(f"'{d}'" for d in texts.KNOWN_DEVICES)
        + ") GROUP BY device_type",
    ),
)
def invalid_categories(spark, sf_dir):
    return validate.invalid_categories(network(spark, sf_dir))


@query(
    "duplicate_keys",
    sql(
        *Q.RAW,
        select="SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, "
        "count(*) FILTER (WHERE n > 1) AS n_repeated_keys "
        "FROM (SELECT count(*) AS n FROM network GROUP BY tower_id)",
    ),
)
def duplicate_keys(spark, sf_dir):
    return validate.duplicate_keys(network(spark, sf_dir))


_BROKEN = [
    ("signal_range", "(signal_strength > 0 OR signal_strength < -150)"),
    ("traffic_range", "network_traffic < 0"),
    ("latency_range", "latency <= 0"),
    ("users_range", "user_count < 0"),
    ("location_domain", "location_type NOT IN ('Urban', 'Rural')"),
]


@query(
    "violating_rows",
    sql(
        *Q.RAW,
        select=f"SELECT {COLUMNS}, concat_ws(',', "
        + ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in _BROKEN)
        + ") AS violations FROM network WHERE "
        + " OR ".join(f"coalesce({p}, FALSE)" for _, p in _BROKEN),
    ),
)
def violating_rows(spark, sf_dir):
    rows = validate.violating_rows(network(spark, sf_dir))
    return rows.withColumn("violations", F.array_join("violations", ","))


@query(
    "sample_sufficiency",
    sql(
        *Q.STRATIFIED_ROWS,
        select="SELECT location_type AS segment, split, count(*) AS n, "
        "CASE WHEN count(*) >= 3 THEN 'sufficient' ELSE 'limited' END AS status "
        "FROM stratified GROUP BY location_type, split",
    ),
)
def sample_sufficiency(spark, sf_dir):
    split = partition.stratified_split(located(spark, sf_dir))
    return validate.sample_sufficiency(split.withColumnRenamed(S.LOCATION, "segment"))


# --- profile -----------------------------------------------------------------------


@query(
    "table_shape",
    sql(
        *Q.RAW,
        select="SELECT count(*) AS total_rows, 7 AS total_columns, "
        "'string,double,double,double,int,string,string' AS data_types FROM network",
    ),
)
def table_shape(spark, sf_dir):
    shape = profile.table_shape(network(spark, sf_dir))
    return shape.withColumn("data_types", F.array_join("data_types.type", ","))


_DESCRIBED = ["mean", "std"]


_SPREAD = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}


@query(
    "describe_numeric",
    sql(
        *Q.RAW,
        select=sql_rounded(
            sql_rounded(
                " UNION ALL ".join(
                    f"SELECT '{c}' AS column_name, count({c}) AS n, "
                    f"avg(CAST({c} AS DOUBLE)) AS mean, "
                    f"stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, "
                    f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, "
                    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, "
                    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, "
                    f"CAST(max({c}) AS DOUBLE) AS max FROM network"
                    for c in NUMBERS
                ),
                _DESCRIBED,
            ),
            ["min", "q25", "q50", "q75", "max"],
            9,
        ),
    ),
)
def describe_numeric(spark, sf_dir):
    out = profile.describe_numeric(observations(spark, sf_dir))
    return rounded(rounded(out, 6, _DESCRIBED), 9, ["min", "q25", "q50", "q75", "max"])


@query(
    "large_group_quantiles",
    sql(
        *Q.RAW,
        select=" UNION ALL ".join(
            f"SELECT device_type, '{c}' AS column_name, "
            + ", ".join(f"round(quantile_cont({c}, {p}), 9) AS {n}" for n, p in _SPREAD.items())
            + " FROM network GROUP BY device_type"
            for c in (S.LATENCY, S.TRAFFIC)
        ),
    ),
)
def large_group_quantiles(spark, sf_dir):
    """The way of large groups at every size of table: no group is sorted as a whole."""
    columns = [S.LATENCY, S.TRAFFIC]
    wanted = dict.fromkeys(columns, list(_SPREAD.values()))
    found = quantiles(observations(spark, sf_dir), wanted, [S.DEVICE], group_limit=0)
    long = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    *[F.get(quantile_name(c), F.lit(i)).alias(n) for i, n in enumerate(_SPREAD)],
                )
                for c in columns
            ]
        )
    )
    return rounded(found.select(S.DEVICE, long), 9)


@query(
    "value_counts",
    sql(
        *Q.RAW,
        select=" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM network "
            f"WHERE {c} IS NOT NULL GROUP BY {c}"
            for c in (S.DEVICE, S.LOCATION)
        ),
    ),
)
def value_counts(spark, sf_dir):
    return profile.value_counts(network(spark, sf_dir), [S.DEVICE, S.LOCATION])


@query(
    "location_distribution",
    sql(
        *Q.LOCATED_ROWS,
        select="SELECT location_type, count(*) AS n, "
        "round(count(*) / (SELECT count(*) FROM located) * 100, 2) AS percentage "
        "FROM located GROUP BY location_type",
    ),
)
def location_distribution(spark, sf_dir):
    return profile.distribution(located(spark, sf_dir), [S.LOCATION])


@query(
    "correlation_matrix",
    sql(
        *Q.RAW,
        select=" UNION ALL ".join(
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr "
            "FROM network"
            for a in NUMBERS
            for b in NUMBERS
        ),
    ),
)
def correlation_matrix(spark, sf_dir):
    return rounded(profile.correlation_matrix(network(spark, sf_dir)))


@query(
    "target_correlation",
    sql(
        *Q.CLEANED,
        select=" UNION ALL ".join(
            f"SELECT '{c}' AS feature, '{g}' AS feature_group, round(corr({c}, latency), 6) "
            "AS corr FROM cleaned"
            for c, g in (
                (S.SIGNAL, "infrastructure"),
                (S.TRAFFIC, "infrastructure"),
                (S.USERS, "user_behavior"),
            )
        ),
    ),
)
def target_correlation(spark, sf_dir):
    return rounded(profile.target_correlation(clean.preprocess(observations(spark, sf_dir))))


@query(
    "latency_by_location",
    sql(
        *Q.LOCATED_ROWS,
        select="SELECT location_type, count(latency) AS n, round(avg(latency), 3) AS mean, "
        "round(stddev_samp(latency), 3) AS std, round(min(latency), 3) AS min, "
        "round(max(latency), 3) AS max, round(median(latency), 3) AS median "
        "FROM located GROUP BY location_type",
    ),
)
def latency_by_location(spark, sf_dir):
    return profile.grouped_target_stats(located(spark, sf_dir))


_FEATURE_STATS = [f"{c}_{s}" for c in S.NUMERIC_FEATURES for s in ("mean", "std")]


@query(
    "features_by_location",
    sql(
        *Q.LOCATED_ROWS,
        select=sql_rounded(
            "SELECT location_type, "
            + ", ".join(
                f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in S.NUMERIC_FEATURES
            )
            + ", avg(latency) AS latency_mean FROM located GROUP BY location_type",
            [*_FEATURE_STATS, "latency_mean"],
        ),
    ),
)
def features_by_location(spark, sf_dir):
    return rounded(profile.grouped_feature_stats(located(spark, sf_dir)))


@query(
    "latency_difference",
    sql(
        *Q.LOCATED_ROWS,
        select="SELECT round(u, 6) AS first_mean, round(r, 6) AS second_mean, "
        "round(u - r, 6) AS difference FROM ("
        "SELECT avg(latency) FILTER (WHERE location_type = 'Urban') AS u, "
        "avg(latency) FILTER (WHERE location_type = 'Rural') AS r FROM located)",
    ),
)
def latency_difference(spark, sf_dir):
    return rounded(
        profile.target_mean_difference(located(spark, sf_dir), texts.URBAN, texts.RURAL)
    )


@query(
    "correlation_by_location",
    sql(
        *Q.LOCATED_ROWS,
        select=" UNION ALL ".join(
            f"SELECT '{c}' AS feature, "
            + ", ".join(
                f"round(corr({c}, latency) FILTER (WHERE location_type = '{g}'), 6) AS \"{g}\""
                for g in texts.KNOWN_LOCATIONS
            )
            + " FROM located"
            for c in S.NUMERIC_FEATURES
        ),
    ),
)
def correlation_by_location(spark, sf_dir):
    return rounded(
        profile.correlation_by_group(located(spark, sf_dir), texts.KNOWN_LOCATIONS)
    )


def _histogram_sql(source: str, bins: int, by: str | None = None) -> str:
    key = f"{by}, " if by else ""
    frame = (
        f"(SELECT DISTINCT {by} FROM {source} WHERE latency IS NOT NULL), range({bins}) AS b(bin)"
        if by
        else f"range({bins}) AS b(bin)"
    )
    using = f"USING ({key}bin)"
    return sql_rounded(
        f"""SELECT {key}CAST(bin AS INTEGER) AS bin,
          (SELECT lo FROM span) + bin * ((SELECT hi - lo FROM span) / {bins}) AS low,
          (SELECT lo FROM span) + (bin + 1) * ((SELECT hi - lo FROM span) / {bins}) AS high,
          coalesce(n, 0) AS n
        FROM (SELECT * FROM {frame}) LEFT JOIN (
          SELECT {key}least(floor((latency - lo) / ((hi - lo) / {bins})), {bins - 1}) AS bin,
                 count(*) AS n
          FROM {source}, span WHERE latency IS NOT NULL GROUP BY ALL
        ) {using}""",
        ["low", "high"],
        9,
    )


def _span(source: str) -> str:
    return f"span AS (SELECT min(latency) AS lo, max(latency) AS hi FROM {source})"


@query("latency_histogram", sql(*Q.RAW, _span("network"), select=_histogram_sql("network", 30)))
def latency_histogram(spark, sf_dir):
    return rounded(profile.histogram(observations(spark, sf_dir)), 9)


@query(
    "latency_histogram_by_location",
    sql(
        *Q.LOCATED_ROWS,
        _span("located"),
        select=_histogram_sql("located", 15, "location_type"),
    ),
)
def latency_histogram_by_location(spark, sf_dir):
    return rounded(profile.histogram(located(spark, sf_dir), bins=15, by=S.LOCATION), 9)


def _box_sql(source: str, by: str, column: str = "latency") -> str:
    return sql_rounded(
        f"""SELECT r.{by}, q1, median, q3,
          min({column}) FILTER (WHERE {column} BETWEEN lo AND hi) AS whisker_low,
          max({column}) FILTER (WHERE {column} BETWEEN lo AND hi) AS whisker_high,
          count(*) FILTER (WHERE NOT {column} BETWEEN lo AND hi) AS n_outliers, count(*) AS n
        FROM {source} AS r JOIN (
          SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
            SELECT {by}, quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median,
                   quantile_cont({column}, 0.75) AS q3 FROM {source} GROUP BY {by})
        ) AS b ON r.{by} IS NOT DISTINCT FROM b.{by}
        WHERE {column} IS NOT NULL GROUP BY r.{by}, q1, median, q3""",
        ["q1", "median", "q3", "whisker_low", "whisker_high"],
        9,
    )


@query("boxplot_by_device", sql(*Q.RAW, select=_box_sql("network", "device_type")))
def boxplot_by_device(spark, sf_dir):
    return rounded(profile.box_stats(observations(spark, sf_dir), S.DEVICE), 9)


@query("boxplot_by_location", sql(*Q.LOCATED_ROWS, select=_box_sql("located", "location_type")))
def boxplot_by_location(spark, sf_dir):
    return rounded(profile.box_stats(located(spark, sf_dir), S.LOCATION), 9)


@query("boxplot_of_events", _box_sql("events", "event_type", "value"))
def boxplot_of_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(profile.box_stats(events, "event_type", "value"), 9)


@query(
    "scatter_points",
    sql(
        *Q.RAW,
        select="SELECT signal_strength AS x, latency AS y, location_type FROM network "
        "WHERE signal_strength IS NOT NULL AND latency IS NOT NULL",
    ),
)
def scatter_points(spark, sf_dir):
    return profile.points(network(spark, sf_dir), S.SIGNAL, S.LATENCY, S.LOCATION)


@query(
    "scatter_cells",
    sql(
        *Q.RAW,
        "p AS (SELECT location_type, CAST(signal_strength AS DOUBLE) AS x, CAST(latency AS DOUBLE) AS y "
        "FROM network WHERE signal_strength IS NOT NULL AND latency IS NOT NULL)",
        "s AS (SELECT min(x) AS xl, max(x) - min(x) AS xw, min(y) AS yl, max(y) - min(y) AS yw FROM p)",
        "node AS (SELECT location_type, CAST(l AS INTEGER) AS level, "
        "CAST(least(floor((x - xl) / (xw / 128)), 127) AS BIGINT) >> (7 - l) AS x_cell, "
        "CAST(least(floor((y - yl) / (yw / 128)), 127) AS BIGINT) >> (7 - l) AS y_cell, "
        "count(*) AS n FROM p, s, range(8) AS t(l) GROUP BY ALL)",
        "sized AS (SELECT *, n * 256 > max(n) OVER (PARTITION BY location_type) AS dense FROM node)",
        select=sql_rounded(
            "SELECT c.location_type, c.level, c.x_cell, c.y_cell, c.n, "
            "xl + c.x_cell * (xw / (1 << c.level)) AS x_low, xl + (c.x_cell + 1) * (xw / (1 << c.level)) AS x_high, "
            "yl + c.y_cell * (yw / (1 << c.level)) AS y_low, yl + (c.y_cell + 1) * (yw / (1 << c.level)) AS y_high "
            "FROM s, sized AS c LEFT JOIN sized AS up ON up.level = c.level - 1 AND up.x_cell = c.x_cell >> 1 "
            "AND up.y_cell = c.y_cell >> 1 AND up.location_type IS NOT DISTINCT FROM c.location_type "
            "WHERE (NOT c.dense OR c.level = 7) AND coalesce(up.dense, true)",
            ["x_low", "x_high", "y_low", "y_high"],
        ),
    ),
)
def scatter_cells(spark, sf_dir):
    return rounded(profile.point_cells(network(spark, sf_dir), S.SIGNAL, S.LATENCY, S.LOCATION))


@query(
    "scatter_sample",
    sql(
        *Q.RAW,
        select="SELECT tower_id, signal_strength AS x, latency AS y FROM network "
        "WHERE signal_strength IS NOT NULL AND latency IS NOT NULL "
        f"ORDER BY {Q.hash32(42)}, tower_id, signal_strength, latency LIMIT 1000",
    ),
)
def scatter_sample(spark, sf_dir):
    return profile.sample_points(network(spark, sf_dir), S.SIGNAL, S.LATENCY)


@query(
    "head_rows",
    sql(
        *Q.RAW,
        select=f"SELECT {COLUMNS} FROM network ORDER BY "
        + ", ".join(f"{c} NULLS FIRST" for c in S.REQUIRED)
        + " LIMIT 5",
    ),
)
def head_rows(spark, sf_dir):
    return profile.head_rows(network(spark, sf_dir))


@query(
    "latency_by_split",
    sql(
        *Q.STRATIFIED_ROWS,
        select=sql_rounded(
            "SELECT location_type AS segment, split, count(latency) AS n, avg(latency) AS mean, "
            "stddev_samp(latency) AS std, min(latency) AS min, max(latency) AS max "
            "FROM stratified GROUP BY location_type, split",
            ["mean", "std", "min", "max"],
        ),
    ),
)
def latency_by_split(spark, sf_dir):
    split = partition.stratified_split(located(spark, sf_dir))
    return rounded(profile.split_stats(split.withColumnRenamed(S.LOCATION, "segment")))


# --- cleaning -----------------------------------------------------------------------


@query(
    "impute_median",
    sql(
        *Q.CLEANED,
        select="SELECT tower_id, signal_strength, network_traffic, user_count FROM imputed",
    ),
)
def impute_median(spark, sf_dir):
    df = observations(spark, sf_dir)
    filled = clean.impute(df, clean.fit_medians(df))
    return filled.select(S.KEY, *S.NUMERIC_FEATURES)


@query("impute_mode", sql(*Q.CLEANED, select="SELECT tower_id, device_type FROM imputed"))
def impute_mode(spark, sf_dir):
    df = observations(spark, sf_dir)
    return clean.impute(df, fills={S.DEVICE: clean.fit_mode(df)}).select(S.KEY, S.DEVICE)


@query(
    "fill_constant",
    sql(
        *Q.RAW,
        select="SELECT tower_id, coalesce(location_type, 'Unknown') AS location_type FROM network",
    ),
)
def fill_constant(spark, sf_dir):
    df = clean.impute(network(spark, sf_dir), fills={S.LOCATION: texts.UNKNOWN})
    return df.select(S.KEY, S.LOCATION)


_FENCED = [(S.SIGNAL, 1), (S.TRAFFIC, 2), (S.LATENCY, 3), (S.USERS, 4)]


@query(
    "iqr_bounds",
    sql(
        *Q.CLEANED,
        select=sql_rounded(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, a{i} AS q1, b{i} AS q3, b{i} - a{i} AS iqr, "
                f"lo{i} AS lower, hi{i} AS upper FROM quartiles, fences"
                for c, i in _FENCED
            ),
            ["q1", "q3", "iqr", "lower", "upper"],
            9,
        ),
    ),
)
def iqr_bounds(spark, sf_dir):
    fences = clean.fit_cleaning(observations(spark, sf_dir)).fences
    rows = [(c, f.q1, f.q3, f.iqr, f.lower, f.upper) for c, f in fences.items()]
    out = spark.createDataFrame(
        rows,
        "column_name string, q1 double, q3 double, iqr double, lower double, upper double",
    )
    return rounded(out, 9)


@query(
    "outlier_counts",
    sql(
        *Q.CLEANED,
        select=" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, "
            f"count(*) FILTER (WHERE {c} < lo{i} OR {c} > hi{i}) AS n_outliers "
            "FROM imputed, fences"
            for c, i in _FENCED
        ),
    ),
)
def outlier_counts(spark, sf_dir):
    df = observations(spark, sf_dir)
    stats = clean.fit_cleaning(df)
    return clean.outlier_counts(clean.imputed(df, stats), stats.fences)


@query(
    "cap_outliers",
    sql(
        *Q.CLEANED,
        select=sql_rounded(
            f"SELECT tower_id, {', '.join(NUMBERS)} FROM capped", NUMBERS, 9
        ),
    ),
)
def cap_outliers(spark, sf_dir):
    df = observations(spark, sf_dir)
    stats = clean.fit_cleaning(df)
    capped = clean.cap_outliers(clean.imputed(df, stats), stats.fences)
    return rounded(capped.select(S.KEY, *NUMBERS), 9)


@query(
    "round_counts",
    sql(
        *Q.RAW,
        select="SELECT tower_id, CAST(round_even(network_traffic, 0) AS INTEGER) AS whole "
        "FROM network",
    ),
)
def round_counts(spark, sf_dir):
    df = network(spark, sf_dir).select(S.KEY, F.col(S.TRAFFIC).alias(S.USERS))
    return clean.convert_types(df).withColumnRenamed(S.USERS, "whole")


@query(
    "drop_null_target",
    sql(*Q.RAW, select=f"SELECT {COLUMNS} FROM network WHERE latency IS NOT NULL"),
)
def drop_null_target(spark, sf_dir):
    return clean.drop_null_target(network(spark, sf_dir))


@query(
    "preprocess",
    sql(
        *Q.CLEANED,
        select=sql_rounded(
            f"SELECT {COLUMNS} FROM cleaned", [S.SIGNAL, S.TRAFFIC, S.LATENCY], 9
        ),
    ),
)
def preprocess(spark, sf_dir):
    return rounded(clean.preprocess(observations(spark, sf_dir)), 9)


@query(
    "batch_fill",
    sql(
        *Q.CLEANED,
        select="SELECT tower_id, coalesce(signal_strength, m1) AS signal_strength, "
        "coalesce(network_traffic, m2) AS network_traffic, "
        "coalesce(CAST(user_count AS DOUBLE), m3) AS user_count, "
        "coalesce(device_type, 'Unknown') AS device_type FROM network, medians",
    ),
)
def batch_fill(spark, sf_dir):
    filled = clean.batch_fill(observations(spark, sf_dir))
    return filled.select(S.KEY, *S.NUMERIC_FEATURES, S.DEVICE)


@query(
    "row_loss",
    sql(
        *Q.RAW,
        select="SELECT count(*) AS rows_before, count(latency) AS rows_after, "
        "count(*) - count(latency) AS rows_removed FROM network",
    ),
)
def row_loss(spark, sf_dir):
    return clean.row_loss(network(spark, sf_dir))


# --- partitioning -------------------------------------------------------------------


@query(
    "vertical_infra",
    sql(
        *Q.RAW, select="SELECT tower_id, signal_strength, network_traffic, latency FROM network"
    ),
)
def vertical_infra(spark, sf_dir):
    return partition.vertical_split(network(spark, sf_dir))[0]


@query(
    "vertical_user",
    sql(*Q.RAW, select="SELECT tower_id, user_count, device_type, latency FROM network"),
)
def vertical_user(spark, sf_dir):
    return partition.vertical_split(network(spark, sf_dir))[1]


@query(
    "vertical_check",
    sql(
        *Q.RAW,
        select="SELECT (SELECT count(*) FROM network) AS rows_infra, "
        "(SELECT count(*) FROM network) AS rows_user, "
        "(SELECT count(*) FROM (SELECT tower_id FROM network EXCEPT ALL "
        "SELECT tower_id FROM network)) AS keys_differing, "
        "0 AS shared_features, TRUE AS is_valid",
    ),
)
def vertical_check(spark, sf_dir):
    return partition.vertical_check(*partition.vertical_split(network(spark, sf_dir)))


@query(
    "vertical_check_broken",
    sql(
        *Q.RAW,
        """user_side AS (
          SELECT tower_id FROM network WHERE device_type IS NOT NULL
          UNION ALL SELECT tower_id FROM network WHERE user_count > 50
        ), per_key AS (
          SELECT tower_id, sum(a) AS a, sum(b) AS b FROM (
            SELECT tower_id, 1 AS a, 0 AS b FROM network
            UNION ALL SELECT tower_id, 0, 1 FROM user_side
          ) GROUP BY tower_id
        )""",
        select="SELECT CAST(sum(a) AS BIGINT) AS rows_infra, CAST(sum(b) AS BIGINT) AS rows_user, "
        "count(*) FILTER (WHERE a <> b) AS keys_differing, 0 AS shared_features, "
        "FALSE AS is_valid FROM per_key",
    ),
)
def vertical_check_broken(spark, sf_dir):
    """Both sides differ: towers without a device are lost, busy ones are there twice."""
    infra, user = partition.vertical_split(network(spark, sf_dir))
    broken = user.filter(F.col(S.DEVICE).isNotNull()).unionByName(user.filter(F.col(S.USERS) > 50))
    return partition.vertical_check(infra, broken)


@query(
    "horizontal_split",
    sql(*Q.RAW, select=f"SELECT {COLUMNS}, {Q.SEGMENT} AS segment FROM network"),
)
def horizontal_split(spark, sf_dir):
    return partition.horizontal_split(network(spark, sf_dir))


@query(
    "location_heuristic",
    sql(*Q.RAW, select=f"SELECT * REPLACE ({Q.LOCATED} AS location_type) FROM network"),
)
def location_heuristic(spark, sf_dir):
    return partition.location_heuristic(network(spark, sf_dir))


@query(
    "location_scores",
    sql(
        *Q.RAW,
        select=f"SELECT {Q.SCORE} AS score, count(*) AS n FROM network "
        f"WHERE {Q.NEEDS} GROUP BY 1",
    ),
)
def location_scores(spark, sf_dir):
    return partition.location_scores(network(spark, sf_dir))


@query(
    "heuristic_summary",
    sql(
        *Q.RAW,
        select="SELECT count(*) AS total_rows, "
        f"count(*) FILTER (WHERE {Q.NEEDS}) AS n_needed, "
        f"count(*) FILTER (WHERE {Q.NEEDS} AND {Q.SCORE} >= 3) AS assigned_urban, "
        f"count(*) FILTER (WHERE {Q.NEEDS} AND {Q.SCORE} < 3) AS assigned_rural FROM network",
    ),
)
def heuristic_summary(spark, sf_dir):
    return partition.heuristic_summary(network(spark, sf_dir))


_SPLIT = f"split_rows AS (SELECT *, {Q.SEGMENT} AS segment FROM network)"
_SIDES = """sides AS (
  SELECT tower_id, count(*) FILTER (WHERE segment = 'Urban') AS n_urban,
         count(*) FILTER (WHERE segment = 'Rural') AS n_rural
  FROM split_rows GROUP BY tower_id
)"""


@query(
    "horizontal_check",
    sql(
        *Q.RAW,
        _SPLIT,
        _SIDES,
        select="""SELECT *, rows_urban + rows_rural = rows_original AND keys_in_both = 0
            AND keys_lost = 0 AS is_valid, rows_urban < 5 OR rows_rural < 5 AS small_segment
          FROM (SELECT (SELECT count(*) FROM network) AS rows_original,
            CAST(sum(n_urban) AS BIGINT) AS rows_urban, CAST(sum(n_rural) AS BIGINT) AS rows_rural,
            count(*) FILTER (WHERE n_urban > 0 AND n_rural > 0) AS keys_in_both,
            (SELECT count(*) FROM (SELECT tower_id FROM network EXCEPT
              SELECT tower_id FROM split_rows)) AS keys_lost FROM sides)""",
    ),
)
def horizontal_check(spark, sf_dir):
    df = network(spark, sf_dir)
    return partition.horizontal_check(partition.horizontal_split(df), df)


@query(
    "horizontal_check_sides",
    sql(
        *Q.RAW,
        f"sided AS (SELECT *, {Q.SPLIT} AS split FROM network)",
        """keyed AS (
          SELECT split, tower_id, count(*) AS o, count(*) FILTER (WHERE location_type = 'Urban') AS u,
                 count(*) FILTER (WHERE location_type = 'Rural') AS r
          FROM sided GROUP BY split, tower_id
        )""",
        select="""SELECT *, rows_urban + rows_rural = rows_original AND keys_in_both = 0
            AND keys_lost = 0 AS is_valid, rows_urban < 5 OR rows_rural < 5 AS small_segment
          FROM (SELECT split, CAST(sum(o) AS BIGINT) AS rows_original, CAST(sum(u) AS BIGINT) AS rows_urban,
            CAST(sum(r) AS BIGINT) AS rows_rural, count(*) FILTER (WHERE u > 0 AND r > 0) AS keys_in_both,
            count(*) FILTER (WHERE u + r = 0) AS keys_lost FROM keyed GROUP BY split)""",
    ),
)
def horizontal_check_sides(spark, sf_dir):
    """Both sides of the split against their own rows; the segments lack the rows of unknown location."""
    df = partition.train_test_split(network(spark, sf_dir))
    known = df.filter(F.col(S.LOCATION).isin(texts.KNOWN_LOCATIONS))
    return partition.horizontal_check(partition.horizontal_split(known), df, by=[partition.SPLIT])


@query(
    "segment_overlap",
    sql(*Q.RAW, _SPLIT, _SIDES, select="SELECT * FROM sides WHERE n_urban > 0 AND n_rural > 0"),
)
def segment_overlap(spark, sf_dir):
    return partition.segment_overlap(partition.horizontal_split(network(spark, sf_dir)))


@query(
    "segment_union",
    sql(
        *Q.RAW,
        select=f"""SELECT {COLUMNS}, 'Urban' AS segment, {Q.NEEDS} AS was_assigned FROM network
          WHERE {Q.SEGMENT} = 'Urban'
          UNION ALL
          SELECT {COLUMNS}, 'Rural' AS segment, {Q.NEEDS} AS was_assigned FROM network
          WHERE {Q.SEGMENT} = 'Rural'""",
    ),
)
def segment_union(spark, sf_dir):
    return partition.segment_union(network(spark, sf_dir))


@query(
    "train_test_split",
    sql(*Q.RAW, select=f"SELECT tower_id, latency, {Q.SPLIT} AS split FROM network"),
)
def train_test_split(spark, sf_dir):
    return partition.train_test_split(network(spark, sf_dir)).select(
        S.KEY, S.LATENCY, "split"
    )


@query(
    "stratified_split",
    sql(*Q.STRATIFIED_ROWS, select="SELECT tower_id, location_type, split FROM stratified"),
)
def stratified_split(spark, sf_dir):
    return partition.stratified_split(located(spark, sf_dir)).select(
        S.KEY, S.LOCATION, "split"
    )


@query(
    "exact_split",
    sql(
        *Q.RAW,
        f"hashed AS (SELECT tower_id, {Q.hash32(42)} AS h FROM network)",
        "ranked AS (SELECT h, row_number() OVER (ORDER BY h) AS rn FROM hashed)",
        select="SELECT tower_id, CASE WHEN h <= (SELECT max(h) FROM ranked "
        "WHERE rn <= ceil(0.2 * (SELECT count(*) FROM network))) "
        "THEN 'test' ELSE 'train' END AS split FROM hashed",
    ),
)
def exact_split(spark, sf_dir):
    return partition.exact_split(observations(spark, sf_dir)).select(S.KEY, "split")


@query(
    "split_distribution",
    sql(
        *Q.STRATIFIED_ROWS,
        select="SELECT split, location_type, count(*) AS n, "
        "round(count(*) / sum(count(*)) OVER (PARTITION BY split) * 100, 2) AS percentage "
        "FROM stratified GROUP BY split, location_type",
    ),
)
def split_distribution(spark, sf_dir):
    split = partition.stratified_split(located(spark, sf_dir))
    return profile.distribution(split, ["split", S.LOCATION], ["split"])


@query(
    "model_inputs",
    sql(
        *Q.RAW,
        select="SELECT signal_strength, network_traffic, user_count, device_type, location_type "
        "FROM network",
    ),
)
def model_inputs(spark, sf_dir):
    return partition.model_inputs(network(spark, sf_dir))


@query(
    "urban_rows",
    sql(*Q.RAW, select=f"SELECT {COLUMNS} FROM network WHERE location_type = 'Urban'"),
)
def urban_rows(spark, sf_dir):
    return partition.location_rows(network(spark, sf_dir), texts.URBAN)


# --- features -----------------------------------------------------------------------

_FILLED = """filled AS (
  SELECT tower_id, coalesce(signal_strength, m1) AS signal_strength,
         coalesce(network_traffic, m2) AS network_traffic FROM network, medians
)"""
_SCALED = ["signal_strength_scaled", "network_traffic_scaled"]


@query(
    "standard_scale",
    sql(
        *Q.CLEANED,
        _FILLED,
        select=sql_rounded(
            "SELECT tower_id, (signal_strength - (SELECT avg(signal_strength) FROM filled)) "
            "/ (SELECT stddev_pop(signal_strength) FROM filled) AS signal_strength_scaled, "
            "(network_traffic - (SELECT avg(network_traffic) FROM filled)) "
            "/ (SELECT stddev_pop(network_traffic) FROM filled) AS network_traffic_scaled "
            "FROM filled",
            _SCALED,
        ),
    ),
)
def standard_scale(spark, sf_dir):
    df = observations(spark, sf_dir)
    filled = clean.impute(df, clean.fit_medians(df, S.INFRASTRUCTURE_FEATURES))
    scaler = features.fit_scaler(filled, S.INFRASTRUCTURE_FEATURES)
    return rounded(features.standard_scale(filled, scaler).select(S.KEY, *_SCALED))


@query(
    "scale_train_test",
    sql(
        *Q.CLEANED,
        f"sided AS (SELECT *, {Q.SPLIT} AS split FROM cleaned)",
        "fit AS (SELECT avg(signal_strength) AS ma, stddev_pop(signal_strength) AS sa, "
        "avg(network_traffic) AS mb, stddev_pop(network_traffic) AS sb "
        "FROM sided WHERE split = 'train')",
        select=sql_rounded(
            "SELECT tower_id, split, (signal_strength - ma) / sa AS signal_strength_scaled, "
            "(network_traffic - mb) / sb AS network_traffic_scaled FROM sided, fit",
            _SCALED,
        ),
    ),
)
def scale_train_test(spark, sf_dir):
    df = partition.train_test_split(clean.preprocess(observations(spark, sf_dir)))
    scaler = features.fit_scaler(
        df.filter(F.col("split") == "train"), S.INFRASTRUCTURE_FEATURES
    )
    return rounded(features.standard_scale(df, scaler).select(S.KEY, "split", *_SCALED))


def _indicators(column: str, values: list[str]) -> str:
    return ", ".join(
        f"CASE WHEN {column} = '{v}' THEN 1.0E0 ELSE 0.0E0 END AS \"{column}_{v}\""
        for v in values
    )


# Device and location values that `network` produces, first one left out.
_DEVICES = ["Mobile", "Satellite", "Smartphone", "Tablet"]
_PLACES = ["Suburban", "Urban"]


@query(
    "one_hot",
    sql(
        *Q.RAW,
        "filled AS (SELECT tower_id, coalesce(device_type, 'Unknown') AS device_type "
        "FROM network)",
        select="SELECT tower_id, device_type, "
        + _indicators("device_type", [*_DEVICES, "Unknown"])
        + " FROM filled",
    ),
)
def one_hot(spark, sf_dir):
    df = clean.impute(observations(spark, sf_dir), fills={S.DEVICE: texts.UNKNOWN})
    df = df.select(S.KEY, S.DEVICE)
    return features.one_hot(df, S.DEVICE, features.fit_categories(df))


@query(
    "prepare_features",
    sql(
        *Q.RAW,
        select="SELECT signal_strength, network_traffic, user_count, "
        + _indicators("device_type", _DEVICES)
        + ", "
        + _indicators("location_type", _PLACES)
        + ", latency FROM network",
    ),
)
def prepare_features(spark, sf_dir):
    return features.prepare_features(observations(spark, sf_dir))


@query(
    "feature_names",
    sql(
        *Q.CLEANED,
        "cats AS (SELECT DISTINCT device_type FROM cleaned)",
        select="SELECT 'infrastructure' AS model, 0 AS position, 'signal_strength' AS feature "
        "UNION ALL SELECT 'infrastructure', 1, 'network_traffic' "
        "UNION ALL SELECT 'user_behavior', 0, 'user_count' "
        "UNION ALL SELECT 'user_behavior', CAST(rn - 1 AS INTEGER), 'device_type_' || device_type "
        "FROM (SELECT device_type, row_number() OVER (ORDER BY device_type) AS rn FROM cats) "
        "WHERE rn > 1",
    ),
)
def feature_names(spark, sf_dir):
    specs = {
        "infrastructure": features.INFRASTRUCTURE,
        "user_behavior": features.USER_BEHAVIOR,
    }
    return features.feature_names(clean.preprocess(observations(spark, sf_dir)), specs)


@query(
    "categories_seen",
    sql(
        *Q.RAW,
        select="SELECT DISTINCT device_type FROM network WHERE device_type IS NOT NULL",
    ),
)
def categories_seen(spark, sf_dir):
    return features.categories_seen(network(spark, sf_dir))


@query(
    "user_features",
    sql(
        *Q.RAW,
        f"sided AS (SELECT tower_id, user_count, coalesce(device_type, 'Unknown') AS device_type, "
        f"{Q.SPLIT} AS split FROM network)",
        "med AS (SELECT median(CAST(user_count AS DOUBLE)) AS m FROM sided "
        "WHERE split = 'train')",
        "full_rows AS (SELECT tower_id, coalesce(CAST(user_count AS DOUBLE), m) AS user_count, "
        "device_type, split FROM sided, med)",
        "fit AS (SELECT avg(user_count) AS mu, stddev_pop(user_count) AS sd FROM full_rows "
        "WHERE split = 'train')",
        select=sql_rounded(
            "SELECT tower_id, split, (user_count - mu) / sd AS user_count_scaled, "
            + _indicators("device_type", [*_DEVICES, "Unknown"])
            + " FROM full_rows, fit",
            ["user_count_scaled"],
        ),
    ),
)
def user_features(spark, sf_dir):
    df = partition.train_test_split(observations(spark, sf_dir))
    built = features.user_features(df.filter(F.col("split") == "train"), df)
    names = [f"{S.DEVICE}_{v}" for v in [*_DEVICES, texts.UNKNOWN]]
    return rounded(built.select(S.KEY, "split", f"{S.USERS}_scaled", *names))
