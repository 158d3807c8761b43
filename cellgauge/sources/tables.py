"""Reading observation tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.sources.schema import CORRUPT, apply_contract, canonical_names

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read a file or folder as it is.

    A missing path raises FileNotFoundError, an unreadable one ValueError. CSV is
    read by header with string columns: no inference pass over the data. Lines of CSV
    and JSON that are broken, or have more or fewer fields than the header, are kept
    whole in the column `_corrupt_record`; the contract leaves them out and counts them.
    """
    if fmt is None:
        fmt = next((f for end, f in FORMATS.items() if path.rstrip("/").endswith(end)), "parquet")
    if fmt not in FORMATS.values():
        raise ValueError(f"Unsupported table format: {fmt}")
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    try:
        if fmt == "csv":
            reader = reader.option("header", True)
            names = [f"`{c.replace('`', '``')}` string" for c in reader.load(path).columns]
            reader = reader.schema(", ".join([*names, f"`{CORRUPT}` string"]))
        table = reader.load(path)
        if fmt == "json" and CORRUPT not in table.columns:  # every line was whole
            table = table.withColumn(CORRUPT, F.lit(None).cast("string"))
        return table
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {path}") from error
        raise ValueError(f"Error loading dataset: {error}") from error
    except Exception as error:
        raise ValueError(f"Error loading dataset: {error}") from error


def cached(df: DataFrame) -> DataFrame:
    """Cache rows that are read more than once, unless an equal plan is cached already."""
    if df.storageLevel == StorageLevel.NONE:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share out the rows of a scan that has fewer tasks than the cluster has slots.

    A file with one row group is read by one task, and so is all that follows without
    a shuffle. Scans with enough tasks are left alone.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def load_observations(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """The observation table under the column contract."""
    return apply_contract(canonical_names(read_table(spark, path, fmt)))
