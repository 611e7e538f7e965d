"""Reading the given tables, and writing intermediate ones where every executor can read them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a side that is broadcast (beyond it the same join is shuffled), and what a hashed row needs besides its own bytes.
BROADCAST_BYTES, ROW_OVERHEAD = 16 << 20, 48
#: Rows and bytes of an Arrow batch while a table is written, so that wide rows don't fill the memory of executors and Python workers.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is made only for a local master without a setting."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-recordloom-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back, so a lost executor costs no recomputation.

    With by, a column of few values, a filter on it reads no rows of the other values.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recordloom-{label}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in ARROW}
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._recordloom_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_recordloom_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit as a hashed relation, else unchanged, so that Spark shuffles the join."""
    return F.broadcast(df) if df.count() * (row_bytes + ROW_OVERHEAD) <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is read in fewer parts than there are, for work that takes long per row; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case: name, or name with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def pick(df: DataFrame, keys: DataFrame, on: str, keep: bool = True) -> DataFrame:
    """Rows of df whose key is (or with keep=False isn't) in keys, a table of written(); null keys match nothing."""
    return df.join(small(keys.select(on), 16), on, "left_semi" if keep else "left_anti")
