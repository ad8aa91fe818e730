"""Scratch tables in the shared folder that the cluster names, broadcasts of a checked size, and joins without one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a few plain columns that are broadcast at most.
BROADCAST_ROWS = 200_000

_own_dir: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary folder of this machine, if Spark runs on this
    machine alone; on a cluster its executors would each write to a disk of their own, so that is an error."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="trailspark-")
    return f"file://{_own_dir}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_and_seen(df: DataFrame, name: str, **seen: Column) -> tuple[DataFrame, dict]:
    """written(df), and aggregates of its rows that Spark observes while it writes them: one query instead of two."""
    watched = Observation(name)
    table = written(df.observe(watched, *[c.alias(k) for k, c in seen.items()]), name)
    return table, watched.get


def removed(table: DataFrame) -> None:
    """Delete the files of a table that written() gave and that nothing reads any more."""
    spark = table.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most that many rows; else it is spread()."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else spread(df)


def spread(df: DataFrame) -> DataFrame:
    """df whose next join is by shuffle. Spark takes an exploded table for no larger than the files it comes from, and
    compressed files for their rows: what it would broadcast by that estimate can be beyond the driver's memory."""
    return df.hint("merge")
