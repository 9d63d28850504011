"""Triple collocation: error variances from one aggregate, weights, rescaling and the merged product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, ratio


def error_variances(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str, min_n: int = 100, least_cross: float = 1e-12, fit: Column | None = None) -> DataFrame:
    """ex, ey, ez and the scales cy, cz of y and z to x, by key, from rows with all three anomalies.

    Error variances are NULL with fewer than min_n rows or where a cross product is under least_cross.
    """
    rows = df.dropna(subset=[x, y, z])
    if fit is not None:
        rows = rows.where(fit)
    s = {a + b: F.sum(F.col(p) * F.col(q)).alias(f"s{a}{b}") for a, p in (("x", x), ("y", y), ("z", z)) for b, q in (("x", x), ("y", y), ("z", z)) if a <= b}
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *s.values())
    c = {k: F.col("s" + k) for k in s}
    usable = (F.col("n") >= min_n) & (F.least(F.abs(c["xy"]), F.abs(c["xz"]), F.abs(c["yz"])) >= least_cross)
    cy, cz = ratio(c["xz"], c["yz"]), ratio(c["xy"], c["yz"])
    n = F.col("n")
    return sums.select(
        *keys,
        "n",
        F.when(usable, (c["xx"] - c["xy"] * cy) / n).alias("ex"),
        F.when(usable, (cy * cy * c["yy"] - cy * c["xy"]) / n).alias("ey"),
        F.when(usable, (cz * cz * c["zz"] - cz * c["xz"]) / n).alias("ez"),
        F.when(usable, cy).alias("cy"),
        F.when(usable, cz).alias("cz"),
    )


def repair(errors: DataFrame, names: Sequence[str] = ("ex", "ey", "ez")) -> DataFrame:
    """A variance that is not positive becomes the median of the positive ones of its product, or 1."""
    medians = errors.agg(*[F.coalesce(F.median(F.when(F.col(e) > 0, F.col(e))), F.lit(1.0)).alias(f"_{e}") for e in names])
    out = errors.crossJoin(F.broadcast(medians))  # one row
    for e in names:
        out = out.withColumn(e, F.when(F.col(e) <= 0, F.col(f"_{e}")).otherwise(F.col(e)))
    return out.drop(*[f"_{e}" for e in names])


def weights(errors: DataFrame) -> DataFrame:
    """Adds wx, wy, wz, inverse to the error variances; they sum to 1."""
    ex, ey, ez = F.col("ex"), F.col("ey"), F.col("ez")
    total = ex * ey + ey * ez + ex * ez
    return errors.withColumns({"wx": ratio(ey * ez, total), "wy": ratio(ex * ez, total), "wz": ratio(ex * ey, total)})


def merge(df: DataFrame, weighted: DataFrame, keys: Sequence[str], x: str, y: str, z: str, clim: str) -> DataFrame:
    """Weighted anomalies in the scale of x plus its climatology, not under 0; missing where any member is."""
    w = weighted.select(*keys, "wx", "wy", "wz", "cy", "cz")
    merged = F.col("wx") * F.col(x) + F.col("wy") * F.col("cy") * F.col(y) + F.col("wz") * F.col("cz") * F.col(z) + F.col(clim)
    return df.join(w, list(keys)).withColumn("merged", clip(merged, 0.0))
