"""Day boundaries, accumulation and de-accumulation, differences and gaps in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip


def daily_sum(df: DataFrame, keys: Sequence[str], day: Column, value: str, empty_as_zero: bool = False) -> DataFrame:
    """Sum and count by key and day; a day without any value is NULL, or 0 if empty_as_zero."""
    total = F.sum(value)
    return df.groupBy(*keys, day.alias("day")).agg((F.coalesce(total, F.lit(0.0)) if empty_as_zero else total).alias("total"), F.count(value).alias("n"))


def complete_days(hourly: DataFrame, keys: Sequence[str], value: str, hour: str = "hour", hours: int = 24) -> DataFrame:
    """Daily sums of days that have every hour. hourly holds one row for each key, day and hour."""
    days = hourly.groupBy(*keys, "day").agg(F.sum(value).alias("total"), F.countDistinct(hour).alias("hours"))
    return days.where(F.col("hours") == hours)


def accumulate(df: DataFrame, keys: Sequence[str], day: Column, rate: str, hours: float = 0.5, require: int | None = None) -> DataFrame:
    """Daily amounts from rates an hour, missing counted as 0; require keeps days with so many rows."""
    out = df.groupBy(*keys, day.alias("day")).agg(F.sum(F.coalesce(F.col(rate), F.lit(0.0)) * hours).alias("total"), F.count("*").alias("n"))
    return out if require is None else out.where(F.col("n") == require)


def deaccumulate(df: DataFrame, keys: Sequence[str], value: str, day: str = "day", hour: str = "hour") -> DataFrame:
    """Hourly amounts from running totals of a day, in which hour 0 holds the total of the day before.

    Hour h is c[h+1] - c[h] with c[0] taken as 0; the last hour needs the next day's hour 0 and is missing unless the
    days follow each other. Never negative.
    """
    w = Window.partitionBy(*keys).orderBy(day, hour)
    nxt, nxt_day, nxt_hour = (F.lead(c).over(w) for c in (value, day, hour))
    own = F.when(F.col(hour) == 0, F.lit(0.0)).otherwise(F.col(value))
    follows = ((nxt_day == F.col(day)) & (nxt_hour == F.col(hour) + 1)) | ((F.col(hour) == 23) & (nxt_hour == 0) & (F.datediff(nxt_day, F.col(day)) == 1))
    return df.withColumn("amount", clip(F.when(follows, nxt - own), 0.0))


def calendar(df: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """A row for every key and every day between the first and the last day of the whole table, values NULL in gaps."""
    span = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias(day))
    # Both sides of this product are dimensions: keys and days.
    return df.select(*keys).distinct().crossJoin(days).join(df, [*keys, day], "left")


def difference(keys: Sequence[str], value: str, day: str = "day") -> Column:
    """Difference to the row before: 0 at the start of a series, NULL where either value is missing."""
    w = Window.partitionBy(*keys).orderBy(day)
    return F.when(F.row_number().over(w) == 1, F.when(F.col(value).isNotNull(), F.lit(0.0))).otherwise(F.col(value) - F.lag(value).over(w))


def interpolate_gaps(df: DataFrame, keys: Sequence[str], value: str, day: str = "day", least: int = 2) -> DataFrame:
    """Linear in the place within the series; before the first and after the last value that value is held; a series of
    fewer than least values stays as it is. Adds filled and was_missing."""
    w = Window.partitionBy(*keys).orderBy(day)
    every = Window.partitionBy(*keys)
    at = F.row_number().over(w)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_at", at).withColumn("_p", F.when(F.col(value).isNotNull(), F.struct("_at", F.col(value).alias("v"))))
    df = df.withColumn("_a", F.last("_p", True).over(back)).withColumn("_b", F.first("_p", True).over(ahead)).withColumn("_n", F.count(value).over(every))
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("_at") - a["_at"]) / F.nullif(b["_at"] - a["_at"], F.lit(0))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_n") >= least, F.coalesce(line, a["v"], b["v"]))
    return df.withColumn("filled", filled).withColumn("was_missing", F.col(value).isNull()).drop("_at", "_p", "_a", "_b", "_n")


def never_valid(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys without any value: a fixed mask."""
    return df.groupBy(*keys).agg(F.count(value).alias("n")).where("n = 0").select(*keys)


def min_max(keys: Sequence[str], value: str, eps: float = 1e-6) -> Column:
    """(v - min) / (max - min + eps) over a key's whole series."""
    w = Window.partitionBy(*keys)
    return (F.col(value) - F.min(value).over(w)) / (F.max(value).over(w) - F.min(value).over(w) + eps)
