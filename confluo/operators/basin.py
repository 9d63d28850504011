"""Basin means by area and Thiessen weights, period sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def area_mean(cube: DataFrame, bridge: DataFrame, cell: Sequence[str], value: str, basin: str = "code", day: str = "day", area: str = "km2", least_share: float = 0.5) -> DataFrame:
    """Area-weighted mean over a basin's valid cells, NULL where they hold less than least_share of its area."""
    total = bridge.groupBy(basin).agg(F.sum(area).alias("_total"))
    got = cube.where(F.col(value).isNotNull()).join(bridge, list(cell)).groupBy(basin, day).agg(F.sum(F.col(area) * F.col(value)).alias("_num"), F.sum(area).alias("_den"))
    days = cube.select(day).distinct()
    out = total.crossJoin(days).join(got, [basin, day], "left")  # basins by days: the result's own rows
    return out.select(basin, day, F.when(F.col("_den") >= least_share * F.col("_total"), F.col("_num") / F.col("_den")).alias(value))


def thiessen_mean(observed: DataFrame, weights: DataFrame, station: str, value: str, basin: str = "code", day: str = "day", renormalise: bool = True) -> DataFrame:
    """Weighted mean over a basin's stations that report; without renormalise missing stations count as 0."""
    # Series move as arrays: a row for each station of a basin, not one for each of its days.
    series = observed.where(F.col(value).isNotNull()).select(station, F.struct(F.col(day).alias("day"), F.col(value).alias("v")).alias("_o")).groupBy(station).agg(F.collect_list("_o").alias("_o"))
    series = series.select(station, F.col("_o.day").alias("_days"), F.col("_o.v").alias("_values"))
    moved = series.join(weights, station).select(basin, "w", "_days", "_values").repartition(basin)
    got = moved.select(basin, "w", F.posexplode("_days").alias("_k", day), "_values").withColumn(value, F.get("_values", F.col("_k")))
    num = F.sum(F.col("w") * F.col(value))
    return got.groupBy(basin, day).agg((ratio(num, F.sum("w")) if renormalise else num).alias(value), F.count("*").alias("n_stations"))


def period_sums(df: DataFrame, periods: DataFrame, keys: Sequence[str], values: Sequence[str], day: str = "day") -> DataFrame:
    """Sums, valid days (_n) and sums over days on which every value is there (_c), by key and named period. periods has
    the keys, period, first and last; a period may be empty."""
    every = F.lit(True)
    for v in values:
        every = every & F.col(v).isNotNull()
    rows = periods.join(df, list(keys), "left").where(F.col(day).isNull() | F.col(day).between(F.col("first"), F.col("last")))
    aggs = []
    for v in values:
        aggs += [F.sum(v).alias(v), F.count(v).alias(f"{v}_n"), F.sum(F.when(every, F.col(v))).alias(f"{v}_c")]
    return rows.groupBy(*keys, "period").agg(*aggs)


def weighted_mean_of_all(df: DataFrame, weight: str, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Weighted mean of each value over the rows that have them all."""
    rows = df.dropna(subset=list(values))
    return rows.groupBy(*by).agg(*[(F.sum(F.col(weight) * F.col(v)) / F.sum(weight)).alias(v) for v in values])


def running_sum(keys: Sequence[str], value: str, day: str = "day") -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
