"""Valid polygons: sides cut at each other, only those kept that part inside from outside, rings built anew.

A polygon's parts (a shell with its holes) are filled by the even-odd rule, so a bow-tie keeps both of its triangles, and
the parts are united: what lies in several counts once. Polygons of few sides are repaired where they stand, many at once;
all work on sides of others is joins and aggregates by equality of polygon and grid square or band; only the rings of one
polygon are linked in one task, from the sides that remain.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import assigned_rings
from ..sources.scratch import stored

#: Decimals of coordinates: about a tenth of a millimetre for degrees.
DIGITS = 9
#: Sides of a polygon that is repaired where it stands; and what polygons taken together may meet of pieces, were all sides to cross.
FEW, MEETINGS = 24, 1 << 21
RINGS = "array<struct<is_hole: boolean, shell: int, pts: array<struct<x: double, y: double>>>>"


def _sides(polygons: DataFrame, rings: str) -> Column:
    """An array of a polygon's sides: part, x1, y1, x2, y2, of rounded coordinates; sides without length are left out. Rings
    that name their shell belong to it; else a hole belongs to the last shell before it."""
    named = "shell" in polygons.schema[rings].dataType.elementType.names

    def part(r, i):
        return F.coalesce(r["shell"], i) if named else F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), i), lambda k: ~F.get(rings, k)["is_hole"])), i)

    def sides(r, i):
        pts = F.transform(r["pts"], lambda p: F.struct(*[(F.round(p[c], DIGITS) + F.lit(0.0)).alias(c) for c in "xy"]))
        after = F.concat(F.slice(pts, 2, F.size(pts)), F.slice(pts, 1, 1))
        found = F.zip_with(pts, after, lambda a, b: F.struct(part(r, i).alias("part"), a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
        found = F.filter(found, lambda d: (d["x1"] != d["x2"]) | (d["y1"] != d["y2"]))
        return F.when(F.size(r["pts"]) >= 3, found).otherwise(F.array().cast("array<struct<part: int, x1: double, y1: double, x2: double, y2: double>>"))

    return F.flatten(F.transform(rings, sides))


def part_sides(polygons: DataFrame, key: str = "code", rings: str = "rings") -> DataFrame:
    """The sides of _sides as rows: key, part, x1, y1, x2, y2."""
    return polygons.select(key, F.explode(_sides(polygons, rings)).alias("_s")).select(key, "_s.*")


def _cut(sides: DataFrame, key: str, per_square: int) -> DataFrame:
    """The sides cut at every place where another side of the polygon meets them: key, part, x1, y1, x2, y2."""
    sides = sides.withColumn("_id", F.struct("part", "x1", "y1", "x2", "y2"))
    low, high = (lambda c: F.least(f"{c}1", f"{c}2")), (lambda c: F.greatest(f"{c}1", f"{c}2"))
    box = sides.groupBy(key).agg(F.min(low("x")).alias("_bx"), F.min(low("y")).alias("_by"), F.greatest(F.max(high("x")) - F.min(low("x")), F.max(high("y")) - F.min(low("y"))).alias("_w"), F.count("*").alias("_n"))
    # As many squares as the sides of a polygon call for: a side of average length is in few of them.
    step = F.col("_w") / F.greatest(F.lit(1.0), F.ceil(F.sqrt(F.col("_n") / per_square)))
    held = sides.join(box.select(key, "_bx", "_by", step.alias("_step")), key)
    span = lambda c: F.sequence(F.floor((low(c) - F.col(f"_b{c}")) / F.col("_step")), F.floor((high(c) - F.col(f"_b{c}")) / F.col("_step")))
    held = held.withColumn("_sx", F.explode(span("x"))).withColumn("_sy", F.explode(span("y"))).select(key, "_sx", "_sy", "_id", "x1", "y1", "x2", "y2")
    other = held.select(key, "_sx", "_sy", F.col("_id").alias("_other"), *[F.col(f"{c}{i}").alias(f"o{c}{i}") for i in (1, 2) for c in "xy"])
    met = held.join(other, [key, "_sx", "_sy"]).where((F.col("_id") != F.col("_other")) & (low("x") <= high("ox")) & (high("x") >= low("ox")) & (low("y") <= high("oy")) & (high("y") >= low("oy")))
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    cross = dx * ey - dy * ex
    # Where lines cross; and ends of the other that lie on the side, in line with it or not.
    t = ((F.col("ox1") - F.col("x1")) * ey - (F.col("oy1") - F.col("y1")) * ex) / F.nullif(cross, F.lit(0.0))
    u = ((F.col("ox1") - F.col("x1")) * dy - (F.col("oy1") - F.col("y1")) * dx) / F.nullif(cross, F.lit(0.0))
    inside = (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
    point = lambda x, y: F.struct((F.round(x, DIGITS) + F.lit(0.0)).alias("x"), (F.round(y, DIGITS) + F.lit(0.0)).alias("y"))
    near = F.lit(10.0**-DIGITS)

    def on_side(i):
        px, py = F.col(f"ox{i}") - F.col("x1"), F.col(f"oy{i}") - F.col("y1")
        along, off = (px * dx + py * dy) / (dx * dx + dy * dy), F.abs(px * dy - py * dx) / F.sqrt(dx * dx + dy * dy)
        return F.when((along > 0) & (along < 1) & (off <= near), point(F.col(f"ox{i}"), F.col(f"oy{i}")))

    crossing = F.when(inside & on_side(1).isNull() & on_side(2).isNull(), point(F.col("x1") + t * dx, F.col("y1") + t * dy))
    places = met.select(key, "_id", F.explode(F.filter(F.array(crossing, on_side(1), on_side(2)), lambda p: p.isNotNull())).alias("p"))
    places = places.groupBy(key, "_id").agg(F.collect_set("p").alias("_places"))
    ends = sides.join(places, [key, "_id"], "left")
    along = lambda p: (p["x"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (p["y"] - F.col("y1")) * (F.col("y2") - F.col("y1"))
    line = F.array_sort(F.transform(F.array_union(F.array(point(F.col("x1"), F.col("y1")), point(F.col("x2"), F.col("y2"))), F.coalesce("_places", F.array())), lambda p: F.struct(along(p).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
    run = ends.select(key, "part", line.alias("_l")).select(key, "part", "_l", F.explode(F.sequence(F.lit(1), F.size("_l") - 1)).alias("_k"))
    a, b = F.get("_l", F.col("_k") - 1), F.get("_l", F.col("_k"))
    return run.select(key, "part", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")).where("x1 != x2 or y1 != y2")


def _pairs(of: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row, of the group of[row], with every row of the group's stretch."""
    n = size[of]
    first = np.cumsum(n) - n
    return np.repeat(np.arange(len(of)), n), np.arange(n.sum()) - np.repeat(first - begin[of], n)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _repaired(of: np.ndarray, part: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> list[np.ndarray]:
    """of, x1, y1, x2, y2 of the sides of the valid forms of several polygons (of: 0 to the last, ascending), as valid_sides
    tells them, by the same formulas."""
    size = np.bincount(of)
    i, j = _pairs(of, np.cumsum(size) - size, size)
    apart = i != j
    for a, b in ((x1, x2), (y1, y2)):
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart &= (low[i] <= high[j]) & (high[i] >= low[j])
    i, j = i[apart], j[apart]
    dx, dy, ex, ey = (x2 - x1)[i], (y2 - y1)[i], (x2 - x1)[j], (y2 - y1)[j]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = dx * ey - dy * ex
        cross[cross == 0] = np.nan
        t = ((x1[j] - x1[i]) * ey - (y1[j] - y1[i]) * ex) / cross
        u = ((x1[j] - x1[i]) * dy - (y1[j] - y1[i]) * dx) / cross
        crossing = (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
        found = [(np.arange(len(x1)), x1, y1), (np.arange(len(x1)), x2, y2)]
        for ox, oy in ((x1[j], y1[j]), (x2[j], y2[j])):
            px, py = ox - x1[i], oy - y1[i]
            along, off = (px * dx + py * dy) / (dx * dx + dy * dy), np.abs(px * dy - py * dx) / np.sqrt(dx * dx + dy * dy)
            on = (along > 0) & (along < 1) & (off <= 10.0**-DIGITS)
            found.append((i[on], ox[on], oy[on]))
            crossing &= ~on
    c = i[crossing]
    found.append((c, np.round(x1[c] + t[crossing] * dx[crossing], DIGITS), np.round(y1[c] + t[crossing] * dy[crossing], DIGITS)))
    side, x, y = (np.concatenate(z) for z in zip(*found, strict=True))
    order = np.lexsort((y, x, (x - x1[side]) * (x2 - x1)[side] + (y - y1[side]) * (y2 - y1)[side], side))
    side, x, y = side[order], x[order], y[order]
    once = _new(side, x, y)
    side, x, y = side[once], x[once], y[once]
    k = np.flatnonzero(side[1:] == side[:-1])
    of, part, ax, ay, bx, by = of[side[k]], part[side[k]], x[k], y[k], x[k + 1], y[k + 1]
    down = (ay > by) | (ay == by) & (ax > bx)
    ax, bx, ay, by = np.where(down, bx, ax), np.where(down, ax, bx), np.where(down, by, ay), np.where(down, ay, by)
    # Pieces, and the parts that have them an odd number of times.
    order = np.lexsort((part, by, bx, ay, ax, of))
    of, part, ax, ay, bx, by = (c[order] for c in (of, part, ax, ay, bx, by))
    piece = np.cumsum(_new(of, ax, ay, bx, by)) - 1
    first = np.flatnonzero(_new(piece))
    run = np.flatnonzero(_new(piece, part))
    run = run[np.diff(np.append(run, len(piece))) % 2 == 1]
    parts = int(part.max()) + 1
    own = piece[run] * parts + part[run]
    # Crossings of a ray to the right from each piece's middle, by parts.
    wall = run[ay[run] != by[run]]
    begin = np.searchsorted(of[wall], np.arange(len(size)))
    i, j = _pairs(of[first], begin, np.searchsorted(of[wall], np.arange(len(size)), side="right") - begin)
    j = wall[j]
    mx, my = ((ax + bx) / 2)[first][i], ((ay + by) / 2)[first][i]
    met = (ay[j] <= my) & (by[j] > my) & (piece[j] != i)
    i, j, mx, my = i[met], j[met], mx[met], my[met]
    met = ax[j] + (bx[j] - ax[j]) * (my - ay[j]) / (by[j] - ay[j]) > mx
    right, times = np.unique(i[met] * parts + part[j[met]], return_counts=True)
    right = right[times % 2 == 1]
    n_own, n_right, n_both = (np.bincount(c // parts, minlength=len(first)) for c in (own, right, np.intersect1d(own, right)))
    beside, across, level = n_right > 0, n_own + n_right - 2 * n_both > 0, (ay == by)[first]
    in_left = np.where(level, beside, across)
    kept = beside != across
    of, ax, ay, bx, by = (c[first][kept] for c in (of, ax, ay, bx, by))
    left = in_left[kept]
    return [of, np.where(left, ax, bx), np.where(left, ay, by), np.where(left, bx, ax), np.where(left, by, ay)]


def _repair(parts):
    """Rows of key and the sides of small polygons as rows of the sides of their valid forms."""
    for rows in parts:
        lists = rows.column(1)
        size = lists.value_lengths().to_numpy()
        flat = [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()]
        end = np.cumsum(size)
        meetings = np.cumsum(size.astype(np.int64) ** 4)
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(meetings, (meetings[a - 1] if a else 0) + MEETINGS, side="right")))
            begin = end[a] - size[a]
            if begin < end[b - 1]:
                of, *sides = _repaired(np.repeat(np.arange(b - a), size[a:b]), *(c[begin : end[b - 1]] for c in flat))
                yield pa.record_batch([rows.column(0).take(pa.array(of + a)), *(pa.array(c + 0.0) for c in sides)], names=[rows.schema.names[0], "x1", "y1", "x2", "y2"])
            a = b


def valid_sides(polygons: DataFrame, key: str = "code", rings: str = "rings", per_square: int = 4, few: int = FEW) -> DataFrame:
    """The sides of each polygon's valid form, the inside on their left: key, x1, y1, x2, y2.

    Sides are cut where they meet; a piece stays if inside and outside differ across it. Inside is what an odd number of
    sides of one part separates from far away, for any part. Polygons without area have no sides; null rings and rings of
    fewer than three places are left out. Places nearer than 10 ** -DIGITS are one. A key names one polygon. Polygons of at
    most few places are repaired where they stand, others by joins among their sides.
    """
    places = F.when(F.col(rings).isNull(), 0).otherwise(F.coalesce(F.size(F.flatten(F.col(f"{rings}.pts"))), F.lit(few + 1)))
    kind = T.StructType([polygons.schema[key], *(T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2"))])
    # Dealt first: many small polygons may stand in one file.
    small, none = polygons.where(places <= few).repartition(key), F.array().cast("array<struct<part: int, x1: double, y1: double, x2: double, y2: double>>")
    small = small.select(key, F.coalesce(_sides(polygons, rings), none).alias("_s")).mapInArrow(_repair, kind)
    large = polygons.where(places > few)
    return small if large.isEmpty() else small.union(_valid_sides_joined(large, key, rings, per_square))


def _valid_sides_joined(polygons: DataFrame, key: str, rings: str, per_square: int) -> DataFrame:
    """valid_sides by joins."""
    cut = _cut(part_sides(polygons, key, rings), key, per_square)
    up = (F.col("y1") < F.col("y2")) | ((F.col("y1") == F.col("y2")) & (F.col("x1") < F.col("x2")))
    turned = cut.select(key, "part", *[F.when(up, F.col(f"{c}{i}")).otherwise(F.col(f"{c}{3 - i}")).alias(f"{c}{i}") for i in (1, 2) for c in "xy"])
    place = [key, "x1", "y1", "x2", "y2"]
    # A side twice in one part parts nothing. Sides are cut once, into a table.
    _, own = stored(turned.groupBy(*place, "part").agg((F.count("*") % 2).alias("odd")), "polygon-pieces")
    own = own()
    pieces = own.groupBy(*place).agg(F.collect_list(F.when(F.col("odd") == 1, F.col("part"))).alias("own"))
    # Crossings of a ray to the right from each piece's middle, by parts; bands of y as high as a polygon's pieces are on average.
    band = own.groupBy(key).agg(F.greatest(F.avg(F.col("y2") - F.col("y1")), F.lit(10.0**-DIGITS)).alias("_band"))
    middle = pieces.join(band, key).withColumn("_my", (F.col("y1") + F.col("y2")) / 2).withColumn("_mx", (F.col("x1") + F.col("x2")) / 2).withColumn("_b", F.floor(F.col("_my") / F.col("_band")))
    walls = own.where("odd = 1 and y1 != y2").join(band, key)
    walls = walls.select(key, F.col("part").alias("wall"), *[F.col(f"{c}{i}").alias(f"w{c}{i}") for i in (1, 2) for c in "xy"], F.explode(F.sequence(F.floor(F.col("y1") / F.col("_band")), F.floor(F.col("y2") / F.col("_band")))).alias("_b"))
    straddles = (F.col("wy1") <= F.col("_my")) & (F.col("wy2") > F.col("_my"))
    at = F.col("wx1") + (F.col("wx2") - F.col("wx1")) * (F.col("_my") - F.col("wy1")) / (F.col("wy2") - F.col("wy1"))
    itself = reduce(or_, [F.col(c) != F.col(f"w{c}") for c in ("x1", "y1", "x2", "y2")])
    met = middle.join(walls, [key, "_b"]).where(straddles & itself & (at > F.col("_mx")))
    crossed = met.groupBy(*place, "wall").agg((F.count("*") % 2).alias("odd")).where("odd = 1").groupBy(*place).agg(F.collect_list("wall").alias("right"))
    both = pieces.join(crossed, place, "left").withColumn("right", F.coalesce("right", F.array().cast("array<int>")))
    # Across the piece, the parts that it bounds change sides. Beside a level piece the ray runs just above it.
    across = F.array_union(F.array_except("right", "own"), F.array_except("own", "right"))
    level = F.col("y1") == F.col("y2")
    filled = both.select(*place, (F.size(F.when(level, across).otherwise(F.col("right"))) > 0).alias("_in_right"), (F.size(F.when(level, F.col("right")).otherwise(across)) > 0).alias("_in_left"))
    kept = filled.where("_in_left != _in_right")
    return kept.select(key, *[F.when(F.col("_in_left"), F.col(f"{c}{i}")).otherwise(F.col(f"{c}{3 - i}")).alias(f"{c}{i}") for i in (1, 2) for c in "xy"])


def areas(sides: DataFrame, key: str = "code") -> DataFrame:
    """Area of each polygon from sides with the inside on their left."""
    return sides.groupBy(key).agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))


def linked_rings(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> list[list[tuple[float, float]]]:
    """Rings of sides with the inside on their left: from each end on along the side most to the left, so that rings that
    touch in a place stay apart."""
    leaving: dict[tuple[float, float], list[int]] = {}
    for k, start in enumerate(zip(x1, y1, strict=True)):
        leaving.setdefault(start, []).append(k)
    angle = np.arctan2(y2 - y1, x2 - x1)
    free, rings = set(range(len(x1))), []
    for first in range(len(x1)):
        if first not in free:
            continue
        ring, k = [], first
        while k in free:
            free.discard(k)
            ring.append((float(x1[k]), float(y1[k])))
            back = angle[k] + np.pi
            after = [n for n in leaving.get((x2[k], y2[k]), []) if n in free]
            if not after:
                break
            k = min(after, key=lambda n: (back - angle[n]) % (2 * np.pi) or 2 * np.pi)
        rings.append(ring)
    return rings


def valid_polygons(polygons: DataFrame, key: str = "code", rings: str = "rings") -> DataFrame:
    """key and rings (is_hole, shell, pts) of each polygon's valid form: shells that don't overlap, each with the holes in it;
    shells run clockwise, as files have them. Polygons without area have no row. See valid_sides."""
    sides = valid_sides(polygons, key, rings)
    kind = polygons.schema[key].dataType.simpleString()

    def build(g: pd.DataFrame) -> pd.DataFrame:
        found = [r for r in linked_rings(*(g[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))) if len(r) >= 3]
        return pd.DataFrame([[g[key].iloc[0], assigned_rings([[*r, r[0]][::-1] for r in found])]], columns=[key, "rings"])

    return sides.groupBy(key).applyInPandas(build, f"`{key}` {kind}, rings {RINGS}")
