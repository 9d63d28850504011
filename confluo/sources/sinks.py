"""Exports: wide tables with a column for each cell, basin or station, and partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import network


def cell_name(lat: Column, lon: Column) -> Column:
    """The column name of a cell in wide exports."""
    return F.format_string("%.2f_%.2f", lat, lon)


def wide(df: DataFrame, row: str, column: str, value: str, names: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """One row for each row key, one column for each name, rounded values."""
    grouped = df.groupBy(row).pivot(column, list(names)) if names else df.groupBy(row).pivot(column)
    out = grouped.agg(F.first(value))
    return out.select(row, *[F.round(F.col(f"`{c}`"), digits).alias(c) for c in out.columns if c != row])


def long(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """The reverse of wide: NULLs stay."""
    return df.unpivot(row, [c for c in df.columns if c != row], column, value)


def write_wide_csv(df: DataFrame, path: str, row: str, column: str, value: str, digits: int = 2) -> None:
    wide(df, row, column, value, digits=digits).orderBy(row).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_station_csv(df: DataFrame, path: str, by: Sequence[str] = ("network", "station")) -> None:
    """One folder for each network and station."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).option("header", True).csv(path)


def attributed(df: DataFrame, **attributes: dict) -> DataFrame:
    """df with attributes (units, long_name, axis) added to its columns' metadata; Parquet keeps them."""
    unknown = set(attributes) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    for c, more in attributes.items():
        df = df.withMetadata(c, {**df.schema[c].metadata, **more})
    return df


def attributes(df: DataFrame) -> dict[str, dict]:
    """The attributes of each column that has any."""
    return {f.name: dict(f.metadata) for f in df.schema.fields if f.metadata}


def write_cube(df: DataFrame, path: str, value: str = "v") -> None:
    """A cube as Parquet by year, values stored as float; columns keep their attributes."""
    stored = df.withColumn(value, F.col(value).cast("float")).withMetadata(value, dict(df.schema[value].metadata)).withColumn("year", F.year("day"))
    stored.write.mode("overwrite").option("compression", "zstd").partitionBy("year").parquet(path)


def basin_facts(bridge: DataFrame, series: DataFrame, basin: str = "code", area: str = "km2", value: str = "v") -> DataFrame:
    """code, area_km2, n_cells, max_share_pct (the greatest cell's) and valid_days of the basin's series."""
    facts = bridge.groupBy(basin).agg(F.sum(area).alias("area_km2"), F.count("*").alias("n_cells"), (100 * F.max(area) / F.sum(area)).alias("max_share_pct"))
    days = series.groupBy(basin).agg(F.count(value).alias("valid_days"))
    return facts.join(days, basin, "left").withColumn("valid_days", F.coalesce("valid_days", F.lit(0)))


def excluded_basins(basins: DataFrame, facts: DataFrame, least_days: int = 1, basin: str = "code") -> DataFrame:
    """Basins that an export leaves out, with the reason: no cell, or fewer than least_days valid days."""
    joined = basins.select(basin).distinct().join(facts.select(basin, "n_cells", "valid_days"), basin, "left")
    reason = F.when(F.col("n_cells").isNull(), "no cell").when(F.col("valid_days") < least_days, "no valid day")
    return joined.select(basin, reason.alias("reason")).where("reason is not null")


def cell_table(cube: DataFrame, lat: Column, lon: Column, value: str, least_days: int = 1, cell: Sequence[str] = ("i", "j")) -> DataFrame:
    """The cells of a wide export with their column names: those of least_days valid days."""
    held = cube.groupBy(*cell).agg(F.count(value).alias("valid_days")).where(F.col("valid_days") >= least_days)
    return held.select(*cell, cell_name(lat, lon).alias("name"), F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"), "valid_days")


def ordered_weights(weights: DataFrame, basin: str = "code", station: str = "station", w: str = "w") -> DataFrame:
    """Weights with their place in the basin, the greatest first, and the station's network."""
    place = F.row_number().over(Window.partitionBy(basin).orderBy(F.desc(w), station))
    return weights.select(basin, place.alias("place"), station, network(F.col(station)).alias("network"), w)


def by_list(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """The rows that a list names, with place, their name's place in it."""
    names = df.sparkSession.createDataFrame([(k, v) for v, k in enumerate(order)], f"{column} string, place int")
    return df.join(F.broadcast(names), column)


def day_name(day: Column) -> Column:
    """A day as exports write it."""
    return F.date_format(day, "yyyy-MM-dd")
