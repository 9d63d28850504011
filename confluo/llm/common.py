"""Shared helpers: reading tables and cutting lineage with written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where it is unset and driver and tasks share
    one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or f"{tempfile.gettempdir()}/checkpoints"


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def row_key(*columns: Column | str) -> Column:
    """128 bits that tell rows apart by these columns."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(9), *columns).alias("b"))


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def write(df: DataFrame, tag: str) -> Callable[[], DataFrame]:
    """Write df as Parquet in the shared folder; the result reads it, each time as a new relation."""
    path, schema, spark = fresh_path(df.sparkSession, tag), df.schema, df.sparkSession
    df.write.parquet(path)
    return lambda: spark.read.schema(schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df, written and read back: cuts the lineage and survives lost executors."""
    return write(df, tag)()


class Scratch:
    """Tables of one computation: written in the shared folder and deleted by clear() once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, tag: str) -> Callable[[], DataFrame]:
        path, schema = fresh_path(self.spark, tag), df.schema
        df.write.parquet(path)
        self.paths.append(path)
        return lambda: self.spark.read.schema(schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """path with its file system, as Spark finds it: tasks that open files themselves reach the same ones."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString())
