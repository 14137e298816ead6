"""Session helpers: a local session for tests and the bench, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "dialwise") -> SparkSession:
    """A single-machine session. On a cluster, pass your own session to the operators instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine, as in tests, may leave it unset; it gets a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="dialwise-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The JVM's file system of a path, and the path as it wants it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def new_table_path(spark: SparkSession, stem: str) -> str:
    """A path below the shared folder that no other run uses; removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"
    system, hadoop = file_system(spark, path)
    system.deleteOnExit(hadoop)
    return path


def frozen(df: DataFrame, stem: str = "frozen") -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder.

    Use it where a result is read several times or must not change between reads. Lost executors
    cost nothing, columns can be pruned, and the planner knows the size of the table.
    """
    spark = df.sparkSession
    path = new_table_path(spark, stem)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(*tables: DataFrame, max_rows: int = 200_000) -> list[DataFrame]:
    """The tables, those with at most ``max_rows`` rows marked for broadcast.

    One job counts them all, so call it on frozen or grouped tables. A larger table is returned as
    it is, and its join shuffles (with AQE splitting skewed partitions).
    """
    counts = [
        t.agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("n")) for i, t in enumerate(tables)
    ]
    found = {row["i"]: row["n"] for row in reduce(DataFrame.union, counts).collect()}
    return [F.broadcast(t) if found[i] <= max_rows else t for i, t in enumerate(tables)]


def bucketed(df: DataFrame, key: str, stem: str) -> DataFrame:
    """``df`` computed once and kept in the shared folder, bucketed by ``key``.

    A join or grouping by ``key`` does not move it; tables bucketed alike join without any exchange.
    """
    spark, name = df.sparkSession, f"{stem}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", new_table_path(spark, stem)).saveAsTable(name)
    return spark.table(name)
