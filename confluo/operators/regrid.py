"""Regridding by separable linear weights: axis weight tables joined to the cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip


def axis_weights(source: DataFrame, target: DataFrame, s: str, sx: str, t: str, tx: str, beyond: bool = True) -> DataFrame:
    """(t, s, w): two rows for each target point, its neighbours on the source axis and their linear weights. Points
    beyond the ends take the end, or have no rows if beyond is false: strict interpolation leaves them missing. Axes are
    dimensions, a few thousand points; the source may run either way."""
    n = source.agg(F.count("*").alias("_n"))
    place = source.select(s, F.col(sx).alias("_x"), (F.row_number().over(Window.orderBy(sx)) - 1).alias("_k"))
    below = target.crossJoin(source.select(F.col(sx).alias("_x"))).groupBy(t, tx).agg(F.count_if(F.col("_x") < F.col(tx)).alias("_c"))
    low = below.crossJoin(n).select(t, tx, clip(F.col("_c") - 1, 0, None).alias("_c"), (F.col("_n") - 2).alias("_m")).select(t, tx, F.least("_c", "_m").alias("_k"))
    a = low.join(place.select("_k", F.col(s).alias("_sa"), F.col("_x").alias("_xa")), "_k")
    b = place.select((F.col("_k") - 1).alias("_k"), F.col(s).alias("_sb"), F.col("_x").alias("_xb"))
    w = clip((F.col(tx) - F.col("_xa")) / (F.col("_xb") - F.col("_xa")), 0.0, 1.0)
    both = a.join(b, "_k").where(F.lit(beyond) | F.col(tx).between(F.col("_xa"), F.col("_xb"))).withColumn("_w", w)
    pair = F.array(F.struct(F.col("_sa").alias("s"), (1 - F.col("_w")).alias("w")), F.struct(F.col("_sb").alias("s"), F.col("_w").alias("w")))
    return both.select(t, F.explode(pair).alias("_p")).select(t, F.col("_p.s").alias(s), F.col("_p.w").alias(f"w_{t}"))


def regrid(cube: DataFrame, rows: DataFrame, cols: DataFrame, value: str, by: tuple[str, ...] = ("day",), source: tuple[str, str] = ("i", "j"), target: tuple[str, str] = ("ti", "tj"), min_cover: float | None = 0.5) -> DataFrame:
    """value on the target grid, by the weight tables of both axes.

    With min_cover missing cells are left out and the rest is renormalised where more than that share of the weight is
    there; with None a target is missing if any of its corners is.
    """
    w = F.col(f"w_{target[0]}") * F.col(f"w_{target[1]}")
    spread = cube.join(F.broadcast(rows), source[0]).join(F.broadcast(cols), source[1])  # axes: at most two rows a target point
    sums = spread.groupBy(*target, *by).agg(
        F.sum(F.when(F.col(value).isNotNull(), w * F.col(value))).alias("_num"),
        F.coalesce(F.sum(F.when(F.col(value).isNotNull(), w)), F.lit(0.0)).alias("_den"),
        F.count(value).alias("_got"),
        F.count("*").alias("_all"),
    )
    if min_cover is None:
        out = F.when((F.col("_got") == F.col("_all")) & (F.col("_all") == 4), F.col("_num"))
    else:
        out = F.when(F.col("_den") > min_cover, F.col("_num") / F.col("_den"))
    return sums.select(*target, *by, out.alias(value))


def masked(cube: DataFrame, mask: DataFrame | None, value: str, cell: tuple[str, str] = ("i", "j")) -> DataFrame:
    """Cells of a mask (those where a reference product has values; all if there is none), negative values set to 0."""
    kept = cube if mask is None else cube.join(mask.select(*cell).distinct(), list(cell), "left_semi")
    return kept.withColumn(value, clip(F.col(value), 0.0))


def flipped(cube: DataFrame, flip: str, n_i: int, n_j: int, cell: tuple[str, str] = ("i", "j")) -> DataFrame:
    """The cube with its rows (lat), columns (lon), both or none in reverse."""
    turn = lambda c, n, on: (F.lit(n - 1) - F.col(c) if on else F.col(c)).alias(c)
    turned = {cell[0]: turn(cell[0], n_i, flip in ("lat", "both")), cell[1]: turn(cell[1], n_j, flip in ("lon", "both"))}
    return cube.select(*[turned.get(c, F.col(c)) for c in cube.columns])
