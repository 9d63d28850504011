"""Null-safe scalar and aggregate expressions. NULL is the only missing value; NaN never leaves ingestion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and edges of the published evaluation.
REGIONS = {1: "Han", 2: "Nakdong", 3: "Geum", 4: "Seomjin", 5: "Yeongsan", 6: "Jeju"}
INTENSITY = (0.0, 1.0, 5.0, 10.0, 20.0, 50.0, 80.0, float("inf"))
BANDS = (-0.01, 0.5, 2.0, 5.0, 10.0, 20.0, 1000.0)


def clip(v: Column, low: float | None = None, high: float | None = None) -> Column:
    """v within [low, high]; NULL stays NULL (greatest and least alone would skip it)."""
    out = v
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(v.isNotNull(), out)


def missing(v: Column, sentinel: float | None = None) -> Column:
    """NULL for NaN, a sentinel or a negative value."""
    bad = F.isnan(v) | (v < 0)
    if sentinel is not None:
        bad = bad | (v == sentinel)
    return F.when(~bad, v)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return a / F.nullif(b, F.lit(0.0))


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation over pairs with both values; NULL if either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def kst_day(ts: Column) -> Column:
    """Day of a UTC time in UTC+9."""
    return F.to_date(ts + F.expr("INTERVAL 9 HOUR"))


def hour_ending_day(ts: Column) -> Column:
    """Day of an observation stamped with the end of its hour: hours 1 to 24 belong to one day."""
    return F.to_date(ts - F.expr("INTERVAL 1 HOUR"))


def month_bin(day: Column) -> Column:
    """Season of a day: DJF, MAM, JJA or SON."""
    return F.element_at(F.array(*map(F.lit, ("DJF", "MAM", "JJA", "SON"))), (F.month(day) % 12 / 3).cast("int") + 1)


def bin_left(v: Column, edges: Sequence[float]) -> Column:
    """Place of the bin [low, high) that holds v, from 0; NULL outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((v >= edges[i]) & (v < edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def bin_right(v: Column, edges: Sequence[float]) -> Column:
    """Place of the bin (low, high] that holds v, from 0; NULL outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((v > edges[i]) & (v <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def region(code: Column) -> Column:
    """Region of a basin's numeric code, by its tens."""
    names = F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])
    return names[F.floor(code / 10).cast("int")]


def network(station: Column) -> Column:
    return F.when(station < 300, "ASOS").otherwise("AWS")


def percent_change(new: Column, base: Column, least: float = 5.0) -> Column:
    """Percent difference, NULL where the base is under least."""
    return F.when(base >= least, 100 * (new - base) / base)


def level(most: Column, ladder: Sequence[float]) -> Column:
    """The smallest level that covers most; the last one beyond."""
    steps = F.array(*map(F.lit, ladder))
    return F.coalesce(F.get(F.filter(steps, lambda x: x >= most), 0), F.element_at(steps, -1))


def planar_km(dx: Column, dy: Column, x_km: float | Column, y_km: float | Column) -> Column:
    return F.sqrt((dx * x_km) * (dx * x_km) + (dy * y_km) * (dy * y_km))


def exact_mean(c: Column) -> Column:
    """Mean of doubles whose sum is exact before it is rounded once: it doesn't depend on the rows' order, as avg's last
    bits do. Values of 2 ** 31 and more, NaN and infinities take avg; bits under 2 ** -62 are cut off."""
    whole = F.when(F.abs(c) < 2.0**31, c.cast("long"))
    part = ((c - whole) * F.lit(2.0**62)).cast("long")
    scaled = F.sum(whole.cast("decimal(10,0)")) * F.lit(2**62).cast("decimal(19,0)") + F.sum(part.cast("decimal(19,0)"))
    mean = scaled.cast("decimal(38,0)").cast("double") / F.lit(2.0**62) / F.nullif(F.count(c), F.lit(0))
    return F.when(F.count(c) == F.count(whole), mean).otherwise(F.avg(c))
