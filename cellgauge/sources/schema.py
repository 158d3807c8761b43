"""Column contract of the observation table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "tower_id"
SIGNAL = "signal_strength"
TRAFFIC = "network_traffic"
LATENCY = "latency"
USERS = "user_count"
DEVICE = "device_type"
LOCATION = "location_type"

# Display name of each column in input files.
DISPLAY_NAMES = {
    KEY: "Tower ID",
    SIGNAL: "Signal Strength (dBm)",
    TRAFFIC: "Network Traffic (MB)",
    LATENCY: "Latency (ms)",
    USERS: "User Count",
    DEVICE: "Device Type",
    LOCATION: "Location Type",
}

CONTRACT = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField(SIGNAL, T.DoubleType()),
        T.StructField(TRAFFIC, T.DoubleType()),
        T.StructField(LATENCY, T.DoubleType()),
        T.StructField(USERS, T.IntegerType()),
        T.StructField(DEVICE, T.StringType()),
        T.StructField(LOCATION, T.StringType()),
    ]
)
REQUIRED = CONTRACT.names

INFRASTRUCTURE_FEATURES = [SIGNAL, TRAFFIC]
USER_FEATURES = [USERS, DEVICE]
NUMERIC_FEATURES = [SIGNAL, TRAFFIC, USERS]
NUMERIC_COLUMNS = [SIGNAL, TRAFFIC, LATENCY, USERS]
#: Where a reader puts lines that do not fit the table.
CORRUPT = "_corrupt_record"


class MissingColumnsError(ValueError):
    """The only validation failure that stops a job."""


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> list[str]:
    """Required columns the table lacks; reads the schema only, runs no job."""
    present = set(df.columns)
    return [c for c in required if c not in present]


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise MissingColumnsError(f"Missing required columns: {missing}")
    return df


def canonical_names(df: DataFrame, display: Mapping[str, str] = DISPLAY_NAMES) -> DataFrame:
    """Rename display names to the short names, other columns keep theirs."""
    return df.withColumnsRenamed({shown: name for name, shown in display.items()})


def apply_contract(df: DataFrame, schema: T.StructType = CONTRACT) -> DataFrame:
    """Select the contract columns in order with their types; NaN becomes NULL.

    A value that does not parse becomes NULL, and a broken line is no row of the table.
    `cast_failures` counts both.
    """
    require_columns(df, schema.names)
    if CORRUPT in df.columns:
        df = df.filter(F.col(CORRUPT).isNull())
    columns = []
    for field in schema:
        value = _parsed(df, field)
        if isinstance(field.dataType, T.DoubleType):
            value = F.when(~F.isnan(value), value)
        columns.append(value.alias(field.name))
    return df.select(columns)


def _parsed(df: DataFrame, field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if df.schema[field.name].dataType == field.dataType:
        return value
    if isinstance(field.dataType, T.IntegerType):
        return F.bround(value.try_cast("double")).try_cast("int")
    return value.try_cast(field.dataType)


def cast_failures(df: DataFrame, schema: T.StructType = CONTRACT) -> DataFrame:
    """Per column: values that are present but do not parse as the contract type.

    A whole number out of range does not parse; NaN parses, as a missing value. Where the
    reader kept broken lines, a row `_corrupt_record` counts them; their values are not
    counted a second time.
    """
    counters = []
    whole = F.col(CORRUPT).isNull() if CORRUPT in df.columns else F.lit(True)
    for field in schema:
        value = F.col(f"`{field.name}`")
        failed = value.isNotNull() & _parsed(df, field).isNull()
        if isinstance(field.dataType, T.IntegerType):
            failed = failed & ~F.isnan(value.try_cast("double"))
        failed = F.count_if(whole & F.coalesce(failed, F.lit(True)))
        counters.append(
            F.struct(F.lit(field.name).alias("column_name"), failed.alias("n_failed"))
        )
    if CORRUPT in df.columns:
        broken = F.count_if(~whole)
        counters.append(F.struct(F.lit(CORRUPT).alias("column_name"), broken.alias("n_failed")))
    return df.agg(F.array(*counters).alias("rows")).select(F.inline("rows"))
