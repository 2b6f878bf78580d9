"""Cutting the lineage of iterative plans, and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one is made, which only a local
    master can share; on a cluster that is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tempograph-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost executor costs
    nothing. Returns the table and its path, for drop_dir. options are the writer's."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored_seen(df: DataFrame, name: str, **seen: Column) -> tuple[DataFrame, str, dict]:
    """stored, and the aggregates `seen` of the rows, taken while they are written: no second job reads them."""
    watch = Observation()
    out, path = stored(df.observe(watch, *(c.alias(n) for n, c in seen.items())), name)
    return out, path, watch.get


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not at some later collection of the driver's garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


class Rounds:
    """The tables of a loop: each is written once and dropped as soon as no later round reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def cut(self, df: DataFrame, *done: DataFrame) -> DataFrame:
        """df written and read again; then the tables in `done`, which were cut before, are deleted."""
        out, path = stored(df, self.name)
        self.paths[id(out)] = (out, path)
        self.drop(*done)
        return out

    def counted(self, df: DataFrame, *done: DataFrame) -> tuple[DataFrame, int]:
        """cut, and the number of rows."""
        out, path, seen = stored_seen(df, self.name, n=F.count("*"))
        self.paths[id(out)] = (out, path)
        self.drop(*done)
        return out, seen["n"]

    def counted_where(self, df: DataFrame, condition: Column, *done: DataFrame) -> tuple[DataFrame, int]:
        """cut, and the number of rows that meet the condition."""
        out, path, seen = stored_seen(df, self.name, n=F.count_if(condition))
        self.paths[id(out)] = (out, path)
        self.drop(*done)
        return out, seen["n"]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if id(t) in self.paths:
                drop_dir(self.spark, self.paths.pop(id(t))[1])
