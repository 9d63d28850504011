"""Tables that are kept beside what they were made from, and made again when that changes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

#: The file in a table's folder that says what the table was made from; Spark's readers pass over its name.
STAMP = "_made_from"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(df: DataFrame) -> str:
    """A digest of df's plan, its settings that change results, and the names, sizes and times of the files it reads.

    Plans are compared without the numbers that a session gives to columns. Tables built from rows of the driver have no
    files: their rows' number and types count, their values don't."""
    spark = df.sparkSession
    names: dict[str, str] = {}
    plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    plan = re.sub(r"#\d+L?", lambda m: names.setdefault(m.group(), f"#{len(names)}"), plan)
    seen = hashlib.sha256("\n".join([plan, df.schema.json(), spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.sql.ansi.enabled")]).encode())
    for file in sorted(df.inputFiles()):
        p, store = _path(spark, file)
        status = store.getFileStatus(p)
        seen.update(f"\n{file} {status.getLen()} {status.getModificationTime()}".encode())
    return seen.hexdigest()


def stamp(spark: SparkSession, path: str) -> str | None:
    """What the table at path says it was made from; none if there is no whole table."""
    p, store = _path(spark, f"{path.rstrip('/')}/{STAMP}")
    if not store.exists(p):
        return None
    stream = store.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def view(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at path, if it was made by the plan of build() from the files as they are now; else it is made again.

    The stamp is written after the table, so a table whose writing broke off is made again too."""
    df = build()
    now = fingerprint(df)
    if rebuild or stamp(spark, path) != now:
        df.write.mode("overwrite").parquet(path)
        p, store = _path(spark, f"{path.rstrip('/')}/{STAMP}")
        out = store.create(p, True)
        out.write(bytearray(now.encode()))
        out.close()
    return spark.read.parquet(path)


def first_fitting(spark: SparkSession, paths: Sequence[str], fits: Callable[[DataFrame], bool]) -> DataFrame | None:
    """The first of these tables that is there and fits: saved parameters, then a fallback; none if no table does."""
    for path in paths:
        p, store = _path(spark, path)
        if store.exists(p):
            df = spark.read.parquet(path)
            if fits(df):
                return df
    return None
