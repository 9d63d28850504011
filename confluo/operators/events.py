"""Peaks and events in daily series."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def peak_day(value: str, day: str = "day") -> Column:
    """Aggregate: the first day of the largest value."""
    return F.max_by(day, F.when(F.col(value).isNotNull(), F.struct(F.col(value), -F.unix_date(day))))


def event_span(df: DataFrame, keys: Sequence[str], value: str, day: str = "day", wet: float | Column = 1.0) -> DataFrame:
    """first, peak and last day of the wet spell around each key's largest value; the peak belongs to it in any case.
    Spells are runs of rows of at least wet."""
    w = Window.partitionBy(*keys).orderBy(day)
    dry = F.coalesce(F.col(value) < wet, F.lit(True))
    runs = df.withColumn("_run", F.sum(dry.cast("int")).over(w)).withColumn("_dry", dry)
    peaks = df.groupBy(*keys).agg(peak_day(value, day).alias("peak"))
    at = runs.join(peaks, list(keys)).where(F.col(day) == F.col("peak")).select(*keys, "peak", F.col("_run").alias("_prun"), F.col("_dry").alias("_pdry"))
    wet_rows = runs.where(~F.col("_dry")).select(*keys, F.col(day).alias("_d"), "_run")
    same = at.join(wet_rows, list(keys), "left").where(F.col("_d").isNull() | F.col("_pdry") | (F.col("_run") == F.col("_prun")))
    span = same.groupBy(*keys, "peak").agg(F.min(F.when(~F.col("_pdry"), F.col("_d"))).alias("a"), F.max(F.when(~F.col("_pdry"), F.col("_d"))).alias("b"))
    return span.select(*keys, F.coalesce("a", "peak").alias("first"), "peak", F.coalesce("b", "peak").alias("last"))


def event_periods(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The periods before, at and after the peak, and the whole, of each span: keys, period, first, last."""
    p = lambda name, a, b: F.struct(F.lit(name).alias("period"), a.alias("first"), b.alias("last"))
    first, peak, last = F.col("first"), F.col("peak"), F.col("last")
    four = F.array(p("before", first, F.date_sub(peak, 1)), p("at", peak, peak), p("after", F.date_add(peak, 1), last), p("whole", first, last))
    return spans.select(*keys, F.explode(four).alias("_p")).select(*keys, "_p.*")


def around_peak(df: DataFrame, keys: Sequence[str], value: str, day: str = "day", days: int = 5) -> DataFrame:
    """Rows within so many days of each key's peak, with offset in days."""
    peaks = df.groupBy(*keys).agg(peak_day(value, day).alias("peak"))
    near = df.join(peaks, list(keys)).withColumn("offset", F.datediff(day, "peak"))
    return near.where(F.abs("offset") <= days)


def around_place(df: DataFrame, keys: Sequence[str], value: str, day: str = "day", rows: int = 5) -> DataFrame:
    """As around_peak, counted in rows of the series."""
    w = Window.partitionBy(*keys).orderBy(day)
    placed = df.withColumn("_at", F.row_number().over(w))
    peaks = placed.groupBy(*keys).agg(F.max_by("_at", F.when(F.col(value).isNotNull(), F.struct(F.col(value), -F.col("_at")))).alias("_peak"))
    return placed.join(peaks, list(keys)).withColumn("offset", F.col("_at") - F.col("_peak")).where(F.abs("offset") <= rows).drop("_at", "_peak")


def annual_maxima(df: DataFrame, keys: Sequence[str], obs: str, sims: Sequence[str], day: str = "day") -> DataFrame:
    """Each year's largest observation, its first day, and every product's value on that day with its percentage."""
    best = df.withColumn("year", F.year(day)).groupBy(*keys, "year").agg(
        F.max_by(F.struct(F.col(day).alias("day"), F.col(obs).alias("obs"), *sims), F.when(F.col(obs).isNotNull(), F.struct(F.col(obs), -F.unix_date(day)))).alias("_b")
    )
    share = [F.when(F.col(f"_b.obs") > 0, 100 * F.col(f"_b.{s}") / F.col("_b.obs")).alias(f"{s}_pct") for s in sims]
    return best.select(*keys, "year", F.col("_b.day").alias("peak_day"), F.col("_b.obs").alias("peak"), *[F.col(f"_b.{s}").alias(s) for s in sims], *share)


def decluster(df: DataFrame, keys: Sequence[str], value: str, day: str = "day", apart: int = 3) -> DataFrame:
    """Independent peaks: from the largest down, a day is kept if none kept before lies within fewer than apart days.
    Sequential within a key, whose series is a task's unit of work; ties to the earlier day."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, day, value])

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g[[*keys, day, value]].sort_values([value, day], ascending=[False, True])
        when = pd.to_datetime(g[day]).to_numpy().astype("datetime64[D]").astype(int)
        taken: set[int] = set()
        rows = []
        for row, t in enumerate(when):
            if not any(t + k in taken for k in range(-apart + 1, apart)):
                taken.add(int(t))
                rows.append(row)
        return g.iloc[rows]

    return df.where(F.col(value) > 0).select(*keys, day, value).groupBy(*keys).applyInPandas(keep, schema)
