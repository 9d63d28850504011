"""Alignment of products in time and climatology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def common_days(wide: DataFrame, products: Sequence[str], day: str = "day") -> DataFrame:
    """Days on which every product has a value somewhere."""
    held = wide.groupBy(day).agg(*[F.count(p).alias(p) for p in products])
    for p in products:
        held = held.where(F.col(p) > 0)
    return held.select(day)


def align(wide: DataFrame, products: Sequence[str], day: str = "day") -> DataFrame:
    """Rows with every product, on common days."""
    return wide.join(common_days(wide, products, day), day, "left_semi").dropna(subset=list(products))


def climatology(df: DataFrame, keys: Sequence[str], value: str, day: str = "day", years: tuple[int, int] | None = None) -> DataFrame:
    """Adds clim, the mean of the month of the year over all years (or those given), and anom."""
    w = Window.partitionBy(*keys, F.month(day))
    v = F.col(value) if years is None else F.when(F.year(day).between(*years), F.col(value))
    return df.withColumn("clim", F.avg(v).over(w)).withColumn("anom", F.col(value) - F.col("clim"))


def same_grid(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one of two grids has: empty if the grids are equal."""
    left, right = a.select(*keys).distinct().withColumn("_l", F.lit(1)), b.select(*keys).distinct().withColumn("_r", F.lit(1))
    return left.join(right, list(keys), "full").where("_l is null or _r is null").select(*keys)
