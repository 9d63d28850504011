"""Spatial gap filling: by the ratio to a guide product, and by triangulation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, planar_km
from ..sources.scratch import Scratch, stored


def ratio_fill(df: DataFrame, value: str, guide: str, x: str, y: str, cell: str = "cell", day: str = "day", x_km: float = 88.0, y_km: float = 111.0, radius: float = 150.0, least: int = 3, dry: float = 0.1) -> DataFrame:
    """Adds filled and how: own, dry (the guide is at most dry: 0), ratio, or none.

    ratio: the guide times the inverse-distance mean (power 2, distances from 1 km) of value/guide, clipped to [0, 5],
    over the valid wet cells of the day within radius km, or the least nearest ones if there are fewer; a day with
    fewer than least such cells stays missing. Cells meet within a day only, by squares of side radius.
    """
    v, g = F.col(value), F.col(guide)
    src = df.where(v.isNotNull() & (g > dry)).select(F.col(day).alias("_d"), F.col(cell).alias("_c"), F.col(x).alias("_x"), F.col(y).alias("_y"), clip(v / g, 0.0, 5.0).alias("_r"))
    todo = df.where(v.isNull() & (g > dry)).select(day, cell, x, y, guide)
    km = planar_km(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"), x_km, y_km)
    # Squares of side radius: what is near stands in the nine around a cell.
    square = lambda c, scale: F.floor(c * scale / radius)
    step = F.sequence(F.lit(-1), F.lit(1))
    asked = todo.withColumn("_a", F.explode(step)).withColumn("_b", F.explode(step))
    asked = asked.withColumn("_sx", square(F.col(x), x_km) + F.col("_a")).withColumn("_sy", square(F.col(y), y_km) + F.col("_b")).drop("_a", "_b")
    held = src.withColumn("_sx", square(F.col("_x"), x_km)).withColumn("_sy", square(F.col("_y"), y_km)).withColumnRenamed("_d", day)
    near = asked.join(held, [day, "_sx", "_sy"]).withColumn("_km", km).where(F.col("_km") <= radius)
    near = near.withColumn("_n", F.count("*").over(Window.partitionBy(day, cell))).where(F.col("_n") >= least).select(day, cell, "_r", "_km")
    # The few cells with too few near ones look through the whole day.
    lonely = todo.join(near.select(day, cell).distinct(), [day, cell], "left_anti").join(src.withColumnRenamed("_d", day), day).withColumn("_km", km)
    w = Window.partitionBy(day, cell)
    lonely = lonely.withColumn("_rank", F.row_number().over(w.orderBy("_km", "_c"))).withColumn("_all", F.count("*").over(w))
    used = near.unionByName(lonely.where((F.col("_all") >= least) & (F.col("_rank") <= least)).select(day, cell, "_r", "_km"))
    weight = 1 / F.pow(F.greatest("_km", F.lit(1.0)), F.lit(2.0))
    ratios = used.groupBy(day, cell).agg((F.sum(weight * F.col("_r")) / F.sum(weight)).alias("_ratio"))
    out = df.join(ratios, [day, cell], "left")
    how = F.when(v.isNotNull(), "own").when(g <= dry, "dry").when(F.col("_ratio").isNotNull(), "ratio").otherwise("none")
    filled = F.when(v.isNotNull(), v).when(g <= dry, 0.0).otherwise(F.col("_ratio") * g)
    return out.withColumn("filled", filled).withColumn("how", how).drop("_ratio")


#: Stands for the place at infinity that the sides of the hull are joined to.
GHOST = -1
#: Coordinates become whole numbers of so many bits: tests of places are exact.
BITS = 26


class Triangulation:
    """Delaunay triangles of places in the plane, built by adding one place after the other.

    Each triangle (counter-clockwise) knows its neighbours across the sides before its corners; beyond each side of the hull
    stands a triangle with the ghost. A place is found by walking from the last triangle; the triangles whose circles hold
    it are replaced. Places lie on a fine lattice of whole numbers, so no test is rounded.
    """

    def __init__(self, places: np.ndarray):
        self.low = places.min(0)
        span = float(np.ptp(places, axis=0).max())
        self.scale = 2.0 ** (BITS - math.ceil(math.log2(span))) if span else 0.0  # a power of two: whole numbers stay exact
        self.p = [tuple(v) for v in self.whole(places)]
        # Neighbours in this order are near each other, so walks are short.
        strips = max(1, int(len(places) ** 0.5))
        strip = ((places[:, 1] - self.low[1]) / max(float(np.ptp(places[:, 1])), 1e-300) * strips).astype(int)
        order = np.lexsort((np.where(strip % 2, -places[:, 0], places[:, 0]), strip)).tolist()
        self.corners: list[tuple[int, int, int]] = []
        self.beside: list[list[int]] = []
        self.last = 0
        a, b = order[0], next((k for k in order if self.p[k] != self.p[order[0]]), None)
        c = None if b is None else next((k for k in order if self._turn(self.p[a], self.p[b], self.p[k])), None)
        if c is None:
            return
        if self._turn(self.p[a], self.p[b], self.p[c]) < 0:
            b, c = c, b
        self.corners = [(a, b, c), (b, a, GHOST), (c, b, GHOST), (a, c, GHOST)]
        self.beside = [[2, 3, 1], [3, 2, 0], [1, 3, 0], [2, 1, 0]]
        for k in order:
            if k not in (a, b, c):
                self._add(k)

    def whole(self, places: np.ndarray) -> list[list[int]]:
        return np.rint((places - self.low) * self.scale).astype(np.int64).tolist()

    @staticmethod
    def _turn(a, b, c) -> int:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def _circle_holds(self, t: int, q) -> bool:
        a, b, c = self.corners[t]
        if GHOST in (a, b, c):
            u, v = (b, c) if a == GHOST else (c, a) if b == GHOST else (a, b)
            u, v = self.p[u], self.p[v]
            turn = self._turn(u, v, q)
            return turn > 0 or turn == 0 and (q[0] - u[0]) * (q[0] - v[0]) + (q[1] - u[1]) * (q[1] - v[1]) < 0
        rows = [(self.p[k][0] - q[0], self.p[k][1] - q[1]) for k in (a, b, c)]
        (ax, ay), (bx, by), (cx, cy) = rows
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0

    def find(self, q) -> int:
        """The triangle that holds a place: one with the ghost, if it is outside."""
        t = self.last
        if GHOST in self.corners[t]:
            t = self.beside[t][self.corners[t].index(GHOST)]
        while GHOST not in (corners := self.corners[t]):
            for k in range(3):
                if self._turn(self.p[corners[(k + 1) % 3]], self.p[corners[(k + 2) % 3]], q) < 0:
                    t = self.beside[t][k]
                    break
            else:
                break
        self.last = t
        return t

    def holder(self, q) -> int | None:
        """The triangle that holds a place; none outside the hull, but for places within two steps of the lattice of one of
        its sides, which rounding may have put there."""
        t = self.find(q)
        if GHOST not in self.corners[t]:
            return t
        k = self.corners[t].index(GHOST)
        u, v = (self.p[self.corners[t][(k + i) % 3]] for i in (1, 2))
        length = (v[0] - u[0]) ** 2 + (v[1] - u[1]) ** 2
        along = (q[0] - u[0]) * (v[0] - u[0]) + (q[1] - u[1]) * (v[1] - u[1])
        return self.beside[t][k] if 0 <= along <= length and self._turn(u, v, q) ** 2 <= 4 * length else None

    def _add(self, k: int) -> None:
        q = self.p[k]
        start = self.find(q)
        if k in self.corners[start] or any(c != GHOST and self.p[c] == q for c in self.corners[start]):
            return
        hit, todo, rim = {start}, [start], []
        while todo:
            t = todo.pop()
            for side, n in enumerate(self.beside[t]):
                if n not in hit and self._circle_holds(n, q):
                    hit.add(n)
                    todo.append(n)
        for t in hit:
            for side, n in enumerate(self.beside[t]):
                if n not in hit:
                    rim.append((self.corners[t][(side + 1) % 3], self.corners[t][(side + 2) % 3], t, n))
        free = list(hit)  # fewer than the new triangles: a rim has two sides more than triangles in it
        starts: dict[int, int] = {}
        new = []
        for a, b, t, n in rim:
            at = free.pop() if free else len(self.corners)
            if at == len(self.corners):
                self.corners.append((GHOST, GHOST, GHOST))
                self.beside.append([])
            new.append((at, a, b, t, n))
            starts[a] = at
        links = [(n, self.beside[n].index(t), at) for at, _, _, t, n in new]
        for n, side, at in links:
            self.beside[n][side] = at
        ends = {b: at for at, _, b, _, _ in new}
        for at, a, b, _, n in new:
            self.corners[at] = (a, b, k)
            self.beside[at] = [starts[b], ends[a], n]
        self.last = new[0][0]

    def triangles(self) -> list[tuple[int, int, int]]:
        return [t for t in self.corners if GHOST not in t]


def mask_weights(valid: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in missing, places in valid and weights: the missing place's value is the sum of weights times valid values.
    Inside the hull of the valid places these are the corners of the triangle that holds it, outside the nearest one."""
    mesh = Triangulation(valid)
    to, by, w = [], [], []
    for k, q in enumerate(mesh.whole(missing)):
        t = mesh.holder(q) if mesh.corners else None
        if t is None:
            to.append(k)
            by.append(int(np.argmin(((valid - missing[k]) ** 2).sum(1))))
            w.append(1.0)
            continue
        a, b, c = (mesh.p[i] for i in mesh.corners[t])
        parts = [max(part, 0) for part in (mesh._turn(q, b, c), mesh._turn(a, q, c), mesh._turn(a, b, q))]
        for i, part in zip(mesh.corners[t], parts, strict=True):
            if part:
                to.append(k)
                by.append(i)
                w.append(part / sum(parts))
    return np.array(to, int), np.array(by, int), np.array(w, float)


def spatial_fill(df: DataFrame, keys: Sequence[str], value: str, x: str, y: str, least: int = 4, cell: str | None = None) -> DataFrame:
    """Adds filled: missing cells linear within the triangles of the valid ones, and the nearest valid value outside (of
    equals the one of smallest x, then y); groups (a day each) with fewer than least valid cells stay as they are. NaN is
    missing. With cell (the column that names a cell) cells without a value in any group stay missing: they are outside the
    product's mask. A group has one row a place; rows with null coordinates stay as they are.

    Days with the same valid and the same missing cells share one triangulation: a digest of both names it, and its weights
    are a table that the days are joined to. One pattern of a grid is a task's unit of work, whatever the number of days.
    """
    if cell is not None:
        seen = df.where(F.col(value).isNotNull()).select(cell).distinct()
        inside = spatial_fill(df.join(seen, cell, "left_semi").select(*df.columns), keys, value, x, y, least)
        return inside.unionByName(df.join(seen, cell, "left_anti").select(*df.columns).withColumn("filled", F.col(value).cast("double")))
    v = F.nullif(F.col(value).cast("double"), F.lit(float("nan")))
    place = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    there = F.col(x).isNotNull() & F.col(y).isNotNull()
    lists = [F.sort_array(F.collect_list(F.when(have & there, place))).alias(c) for c, have in (("_valid", v.isNotNull()), ("_missing", v.isNull()))]
    days = df.groupBy(*keys).agg(*lists).where((F.size("_valid") >= least) & (F.size("_missing") > 0))
    days = days.withColumn("_mask", F.sha2(F.to_json(F.struct("_valid", "_missing")), 256))

    def weights(parts):
        for part in parts:
            for mask, have, need in zip(part["_mask"], part["_valid"], part["_missing"], strict=True):
                have, need = (np.array([(p["x"], p["y"]) for p in some], float) for some in (have, need))
                to, by, w = mask_weights(have, need)
                yield pd.DataFrame({"_mask": mask, "_tx": need[to, 0], "_ty": need[to, 1], "_sx": have[by, 0], "_sy": have[by, 1], "_w": w})

    with Scratch(df.sparkSession) as old:
        patterns = old.write(days, "mask-days")
        one = patterns().dropDuplicates(["_mask"]).select("_mask", "_valid", "_missing")
        one = one.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_mask")
        _, table = stored(one.mapInPandas(weights, "_mask string, _tx double, _ty double, _sx double, _sy double, _w double"), "mask-weights")
        _, masks = stored(patterns().select(*keys, "_mask"), "masks")
    own = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    named = [f"_k{i}" for i in range(len(keys))]
    asked = masks().select(*own, "_mask").join(table(), "_mask")
    given = df.where(v.isNotNull()).select(*own, F.col(x).cast("double").alias("_sx"), F.col(y).cast("double").alias("_sy"), v.alias("_v"))
    found = asked.join(given, [*named, "_sx", "_sy"]).groupBy(*named, "_tx", "_ty").agg(F.sum(F.col("_w") * F.col("_v")).alias("_found"))
    same = [F.col(c) == F.col(n) for c, n in (*zip(keys, named, strict=True), (x, "_tx"), (y, "_ty"))]
    return df.join(found, reduce(and_, same), "left").select(*df.columns, F.coalesce(v, "_found").alias("filled"))
