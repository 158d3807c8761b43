"""Tables written to the shared folder, so that later steps read them instead of a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in `spark.checkpoint.dir`. Where that is unset, only a local
    master may go on, with a new folder that is put into the setting.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or getattr(spark.sparkContext, "_llm_dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext._llm_dir = folder
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: it survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write a table bucketed by a key: a later grouping by it does not shuffle this side.

    The catalog entry is only needed to plan the reading, and dropped again; the files
    stay in the shared folder.
    """
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(shuffle_partitions(spark), key).option("compression", "zstd")
    writer.option("path", new_path(spark, name)).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
