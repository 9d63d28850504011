"""Tables of one computation, written in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where it is unset and driver and tasks share a machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")


def stored(df: DataFrame, tag: str) -> tuple[str, Callable[[], DataFrame]]:
    """The path of df, written as Parquet, and what reads it, each time as a new relation."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, lambda: spark.read.schema(schema).parquet(path)


class Scratch:
    """Tables that nothing reads after the block: `with Scratch(spark) as old: t = old.write(df, "t")`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, tag: str) -> Callable[[], DataFrame]:
        path, read = stored(df, tag)
        self.paths.append(path)
        return read

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
