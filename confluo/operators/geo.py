"""Points, polygons and stations: containment, nearest neighbours, Thiessen weights, overlap areas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import network
from ..sources.scratch import Scratch, stored

RINGS = "array<struct<is_hole: boolean, pts: array<struct<x: double, y: double>>>>"


def edges(polygons: DataFrame, key: str = "code", rings: str = "rings") -> DataFrame:
    """One row for each side of each ring: key, ring, is_hole, x1, y1, x2, y2. Rings may or may not repeat their start."""
    ring = polygons.select(key, F.posexplode(rings).alias("ring", "_r"))
    n = F.size("_r.pts")
    side = ring.select(key, "ring", F.col("_r.is_hole").alias("is_hole"), F.col("_r.pts").alias("_p"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_k"))
    a, b = F.get("_p", F.col("_k")), F.get("_p", (F.col("_k") + 1) % F.size("_p"))
    return side.select(key, "ring", "is_hole", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


#: Points of one place that stand together in a row.
TOGETHER = 1 << 12


def _places(points: DataFrame, point: str, px: str, py: str) -> DataFrame:
    """Points by place: px, py and _points, at most about TOGETHER of the points there."""
    asked = points.select(F.col(point).alias("_point"), F.col(px).alias("_px"), F.col(py).alias("_py")).where("_px is not null and _py is not null").distinct()
    # Points' numbers deal a crowded place to several rows; how many is known where places are counted.
    many = asked.groupBy("_px", "_py").count().where(F.col("count") > TOGETHER).select("_px", "_py", F.ceil(F.col("count") / TOGETHER).alias("_n"))
    dealt = asked.join(many, ["_px", "_py"], "left").withColumn("_part", F.pmod(F.xxhash64("_point"), F.coalesce("_n", F.lit(1).cast("long"))))
    return dealt.groupBy("_px", "_py", "_part").agg(F.collect_list("_point").alias("_points")).drop("_part")


def _banded(sides: DataFrame, key: str, band: float, reach: float = 0.0) -> DataFrame:
    """A row for each polygon and band of y that holds some of its sides, widened by reach: key, _row, _sides (by ring),
    _many (whether they are of several rings), _x0 and _x1 (where points may be inside or within reach)."""
    y0, y1 = F.least("y1", "y2"), F.greatest("y1", "y2")
    step = F.lit(band)
    held = sides.withColumn("_row", F.explode(F.sequence(F.floor((y0 - reach) / step), F.floor((y1 + reach) / step))))
    # Where a side is met is rounded: a little more is looked at.
    more = lambda c: F.lit(reach) + F.lit(1e-9) * (F.abs(c) + 1)
    low, high = F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2"))
    held = held.groupBy(key, "_row").agg(F.array_sort(F.collect_list(F.struct("ring", "is_hole", "x1", "y1", "x2", "y2"))).alias("_sides"), (F.min("ring") != F.max("ring")).alias("_many"), low.alias("_x0"), high.alias("_x1"))
    return held.withColumn("_x0", F.col("_x0") - more(F.col("_x0"))).withColumn("_x1", F.col("_x1") + more(F.col("_x1")))


def _inside(x: F.Column, y: F.Column) -> F.Column:
    """Whether a place is in a shell and in no hole of the _sides, by counting the crossings of a ray to the right."""

    def crossed(s):
        at = (s["x2"] - s["x1"]) * (y - s["y1"]) / F.nullif(s["y2"] - s["y1"], F.lit(0.0)) + s["x1"]
        return ((s["y1"] > y) != (s["y2"] > y)) & (x < at)

    met = F.filter("_sides", crossed)
    # Sides stand by ring: what a ring's end says is added when the next begins.
    state = lambda ring, hole, odd, shells, holes: F.struct(ring.alias("ring"), hole.alias("hole"), odd.alias("odd"), shells.alias("shells"), holes.alias("holes"))
    shells, holes = (lambda t: t["shells"] | t["odd"] & ~t["hole"]), (lambda t: t["holes"] | t["odd"] & t["hole"])
    no = F.lit(False)
    merge = lambda t, s: F.when(t["ring"] == s["ring"], state(t["ring"], t["hole"], ~t["odd"], t["shells"], t["holes"])).otherwise(state(s["ring"], s["is_hole"], F.lit(True), shells(t), holes(t)))
    several = F.aggregate(met, state(F.lit(-1), no, no, no, no), merge, lambda t: shells(t) & ~holes(t))
    return F.when(F.col("_many"), several).otherwise(~F.get("_sides", F.lit(0))["is_hole"] & (F.size(met) % 2 == 1))


def in_polygon(points: DataFrame, sides: DataFrame, point: str, px: str = "lon", py: str = "lat", key: str = "code", band: float = 0.05, own: bool = False) -> DataFrame:
    """(point, key) of every point inside a polygon: in a shell and in no hole, by counting the crossings of a ray. Points
    without coordinates are in none. With own, points name the polygon they are asked about in the column key.

    Places meet polygons by bands of y and squares of x: a polygon's sides in one band are a row, which stands in each
    square that they touch. A pair is decided where it is met, and no pair is moved.
    """
    banded = _banded(sides.where("y1 != y2"), key, band)
    if own:
        asked = points.select(point, key, F.col(px).alias("_px"), F.col(py).alias("_py")).distinct().withColumn("_row", F.floor(F.col("_py") / F.lit(band)))
        return asked.join(banded, [key, "_row"]).where(_inside(F.col("_px"), F.col("_py"))).select(point, key)
    return _met(_places(points, point, px, py), banded, point, key, band, _inside(F.col("_px"), F.col("_py")))


def _met(places: DataFrame, banded: DataFrame, point: str, key: str, band: float, true: F.Column) -> DataFrame:
    """(point, key) of the places' points for which true holds of the place and a row of _banded in its band."""
    step = F.lit(band)
    square = lambda c: F.floor(F.col(c) / (step * 2))
    held = banded.withColumn("_column", F.explode(F.sequence(square("_x0"), square("_x1"))))
    asked = places.withColumn("_row", F.floor(F.col("_py") / step)).withColumn("_column", square("_px"))
    met = asked.join(held, ["_row", "_column"]).where((F.col("_px") >= F.col("_x0")) & (F.col("_px") <= F.col("_x1"))).where(true)
    return met.select(F.explode("_points").alias(point), key)


def _boxes(sides: DataFrame, key: str) -> DataFrame:
    ends = {"_x0": F.min(F.least("x1", "x2")), "_x1": F.max(F.greatest("x1", "x2")), "_y0": F.min(F.least("y1", "y2")), "_y1": F.max(F.greatest("y1", "y2"))}
    return sides.groupBy(key).agg(*[e.alias(c) for c, e in ends.items()])


def near_polygon(points: DataFrame, sides: DataFrame, point: str, px: str = "lon", py: str = "lat", key: str = "code", buffer: float = 0.05) -> DataFrame:
    """(point, key) of every point inside a polygon or within buffer of one of its sides: the mask of a buffered polygon.

    Places meet polygons as in in_polygon, by bands as high as the buffer: a side stands in all that it, widened, touches.
    """
    x, y, size = F.col("_px"), F.col("_py"), F.lit(buffer)

    def close(s):
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        along = ((x - s["x1"]) * dx + (y - s["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        t = F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        ex, ey = x - s["x1"] - t * dx, y - s["y1"] - t * dy
        return ex * ex + ey * ey <= size * size

    return _met(_places(points, point, px, py), _banded(sides, key, buffer, buffer), point, key, buffer, _inside(x, y) | F.exists("_sides", close))


def inside_lattice(boxes: DataFrame, sides: DataFrame, key: str, step: float, dx: float = 0.0, dy: float = 0.0, band: float = 0.05) -> DataFrame:
    """(key, pa, pb, px, py) of the points of each box's lattice, moved by dx and dy, that are inside its polygon. A
    polygon's points are made where its sides of a band are, and only there: those outside are never rows that move."""
    rows = _banded(sides.where("y1 != y2"), key, band).join(boxes, key)
    steps = lambda a, b: F.sequence(F.lit(0), F.floor((F.col(b) - F.col(a)) / step).cast("int"))
    at = lambda c, k: F.col(c) + k * step + dy
    rows = rows.select("*", F.explode(F.filter(steps("y0", "y1"), lambda k: F.floor(at("y0", k) / F.lit(band)) == F.col("_row"))).alias("pb"))
    rows = rows.select("*", F.explode(steps("x0", "x1")).alias("pa"))
    rows = rows.withColumn("_px", F.col("x0") + F.col("pa") * step + dx).withColumn("_py", at("y0", F.col("pb")))
    return rows.where(_inside(F.col("_px"), F.col("_py"))).select(key, "pa", "pb", F.col("_px").alias("px"), F.col("_py").alias("py"))


#: Sites that a square of the first grid holds at most, for each neighbour asked for; how often squares are halved to get
#: there, or doubled after it with their greatest number of sites known; and sites that a point meets at once.
CROWDED, HALVINGS, DOUBLINGS, AT_ONCE = 32, 24, 9, 1024


def _known(*columns: str) -> F.Column:
    """Whether coordinates are neither null nor NaN nor infinite."""
    return reduce(and_, [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) for c in columns])


def k_nearest(
    points: DataFrame, stations: DataFrame, point: Sequence[str], px: str, py: str, station: str, sx: str, sy: str, k: int = 1, weights: tuple[str, str] | None = None
) -> DataFrame:
    """The k nearest stations of every point (all, if fewer): the point's columns, rank (from 1), station, distance.

    Distances are Euclidean in the coordinates given, of equals the smaller station first; weights names two columns of
    points, positive factors of the differences in x and y. A point given twice counts once; its columns may be null.
    Points without finite coordinates have no rows; stations without take no part.
    """
    return _ranked(points.select(*{c: None for c in (*point, px, py, *(weights or ()))}).distinct(), stations, point, px, py, station, sx, sy, k, weights)[0]


def _ranked(points: DataFrame, stations: DataFrame, point: Sequence[str], px: str, py: str, station: str, sx: str, sy: str, k: int, weights: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of k_nearest, for points given twice too, and the points that have none.

    A grid's squares hold few stations; a point meets those of the nine squares around it, as arrays of bounded size. It is
    done once its k-th best is nearer than a square's side, which nothing beyond the nine can be; the others look again in
    squares of eight times the side. All joins are by equality; points move once a round, and each round's points are a
    written table, so no plan grows.
    """
    spark = points.sparkSession
    wx, wy = (F.col("_wx"), F.col("_wy")) if weights else (F.lit(1.0), F.lit(1.0))
    factors = [F.col(c).alias(n) for c, n in zip(weights or (), ("_wx", "_wy"), strict=False)]
    told = [*point, "_px", "_py", *(("_wx", "_wy") if weights else ())]
    asked = points.select(*point, F.col(px).cast("double").alias("_px"), F.col(py).cast("double").alias("_py"), *factors)
    sites = stations.where(_known(sx, sy)).select(F.col(station).alias("_s"), F.col(sx).cast("double").alias("_sx"), F.col(sy).cast("double").alias("_sy"))
    # Of stations in one place only the first k can count.
    place = F.row_number().over(Window.partitionBy("_sx", "_sy").orderBy("_s"))
    found = []
    with Scratch(spark) as old:
        sites = old.write(sites.withColumn("_k", place).where(F.col("_k") <= k).drop("_k"), "sites")
        every = old.write(asked, "points")
        left = lambda: every().where(_known("_px", "_py"))
        n, x0, x1, y0, y1 = sites().agg(F.count("*"), F.min("_sx"), F.max("_sx"), F.min("_sy"), F.max("_sy")).first()
        if n:
            reach = F.greatest(F.abs(F.col("_px") - x0), F.abs(F.col("_px") - x1), F.abs(F.col("_py") - y0), F.abs(F.col("_py") - y1))
            far = left().agg(F.max(reach)).first()[0] or 0.0
            base = 1.5 * max(x1 - x0, y1 - y0, 1e-9) * min(1.0, (k / n) ** 0.5)
            halved = sites().select("_sx", "_sy", F.explode(F.sequence(F.lit(-DOUBLINGS), F.lit(HALVINGS))).alias("_h")) if n > CROWDED * k else None
            most = {}
            if halved is not None:
                square = [F.floor(F.col(c) / F.lit(base) * F.pow(F.lit(2.0), "_h")) for c in ("_sx", "_sy")]
                most = dict(halved.groupBy("_h", *square).count().groupBy("_h").agg(F.max("count")).collect())
            step = next((h for h in range(HALVINGS) if most.get(h, 0) <= CROWDED * k), HALVINGS)
        while n and not left().isEmpty():
            side = base / 2.0**step
            chunks = -(-9 * min(n, most.get(step, n)) // AT_ONCE)
            square = lambda c: F.floor(F.col(c) / F.lit(side))  # noqa: E731, B023
            around = F.sequence(F.lit(-1), F.lit(1))
            held = sites().withColumn("_a", F.explode(around)).withColumn("_c", F.explode(around))
            held = held.groupBy((square("_sx") + F.col("_a")).alias("_gx"), (square("_sy") + F.col("_c")).alias("_gy"), F.pmod(F.hash("_s"), F.lit(chunks)).alias("_part"))
            held = held.agg(F.array_sort(F.collect_list(F.struct("_s", "_sx", "_sy"))).alias("_sites"))
            met = left().withColumn("_gx", square("_px")).withColumn("_gy", square("_py")).join(held, ["_gx", "_gy"], "left")

            def d2(z):
                dx, dy = (F.col("_px") - z["_sx"]) * wx, (F.col("_py") - z["_sy"]) * wy
                return dx * dx + dy * dy

            if k == 1:
                # The smallest station of a square stands first.
                met = met.withColumn("_d", F.transform("_sites", d2)).withColumn("_m", F.array_min("_d"))
                best = F.array(F.struct(F.col("_m").alias("d2"), F.element_at("_sites", F.array_position("_d", F.col("_m")).cast("int"))["_s"].alias("s")))
            else:
                best = F.slice(F.array_sort(F.transform("_sites", lambda z: F.struct(d2(z).alias("d2"), z["_s"].alias("s")))), 1, k)
            met = met.select(*told, F.when(F.col("_sites").isNotNull(), best).alias("_best"), F.coalesce("_part", F.lit(0)).alias("_part"))
            if chunks > 1:
                # A point given twice meets each part twice.
                copies = F.size(F.collect_list("_part")) / F.size(F.collect_set("_part"))
                met = met.groupBy(*told).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_best")))).alias("_best"), copies.cast("int").alias("_copies"))
                met = met.withColumn("_best", F.when(F.size("_best") > 0, F.slice("_best", 1, k))).withColumn("_part", F.explode(F.sequence(F.lit(1), "_copies")))
            bound = F.least(wx, wy) * F.lit(side)
            done = F.lit(True) if side >= far else F.coalesce((F.size("_best") == k) & (F.element_at("_best", -1)["d2"] <= bound * bound), F.lit(False))
            path, seen = stored(met.select(*told, "_best").withColumn("_done", done), "nearest")
            found.append(path)
            left = lambda seen=seen: seen().where("not _done").select(*told)
            step -= 3
        lost = stored((every().where(~_known("_px", "_py")) if n else every()).select(*point), "nearest-to-none")[1]()
    kind = stations.schema[station].dataType
    if not found:
        return points.select(*point, F.lit(1).alias("rank"), F.lit(None).cast(kind).alias(station), F.lit(0.0).alias("distance")).limit(0), lost
    rows = spark.read.parquet(*found).where("_done").select(*point, F.posexplode("_best").alias("_k", "_b"))
    return rows.select(*point, (F.col("_k") + 1).alias("rank"), F.col("_b.s").cast(kind).alias(station), F.sqrt("_b.d2").alias("distance")), lost


def nearest(points: DataFrame, stations: DataFrame, point: Sequence[str], px: str, py: str, station: str, sx: str, sy: str) -> DataFrame:
    """The nearest station of every point by distance in the coordinates given, ties to the smaller station; see k_nearest.
    A point given twice has two rows. A point without finite coordinates, and every point if there are no stations, has a
    null station and distance."""
    met, rest = _ranked(points, stations, point, px, py, station, sx, sy, 1)
    none = [F.lit(None).cast(met.schema[c].dataType).alias(c) for c in (station, "distance")]
    return met.drop("rank").union(rest.select(*point, *none))


def nearest_candidates(centres: DataFrame, stations: DataFrame, key: str, x: str, y: str, station: str, sx: str, sy: str, k: int = 80) -> DataFrame:
    """The k stations nearest to each centre: (key, station)."""
    return k_nearest(centres, stations, [key], x, y, station, sx, sy, k).select(key, station)


def lattice(boxes: DataFrame, key: str, step: float) -> DataFrame:
    """Points (key, px, py) of a lattice from each box's corner; boxes have x0, y0, x1, y1."""
    steps = lambda a, b: F.sequence(F.lit(0), F.floor((F.col(b) - F.col(a)) / step).cast("int"))
    out = boxes.select("*", F.explode(steps("x0", "x1")).alias("_a")).select("*", F.explode(steps("y0", "y1")).alias("_b"))
    return out.select(key, F.col("_a").alias("pa"), F.col("_b").alias("pb"), (F.col("x0") + F.col("_a") * step).alias("px"), (F.col("y0") + F.col("_b") * step).alias("py"))


def thiessen_weights(owned: DataFrame, key: str, station: str, cell_km2: float | None = None) -> DataFrame:
    """Share of a basin's lattice points that each station owns, from (key, point, station) rows; with cell_km2 also the
    area."""
    n = owned.groupBy(key, station).agg(F.count("*").alias("n"))
    out = n.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    return out if cell_km2 is None else out.withColumn("km2", F.col("n") * cell_km2)


def shoelace(sides: DataFrame, key: str = "code") -> DataFrame:
    """Area and centroid of each polygon in the units of its coordinates, holes taken off."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    ring = sides.groupBy(key, "ring", "is_hole").agg(F.sum(cross).alias("a"), F.sum(cross * (F.col("x1") + F.col("x2"))).alias("cx"), F.sum(cross * (F.col("y1") + F.col("y2"))).alias("cy"))
    sign = F.when(F.col("is_hole"), -1.0).otherwise(1.0) * F.signum("a")
    out = ring.groupBy(key).agg(F.sum(sign * F.col("a") / 2).alias("area"), F.sum(sign * F.col("cx") / 6).alias("mx"), F.sum(sign * F.col("cy") / 6).alias("my"))
    return out.select(key, "area", (F.col("mx") / F.col("area")).alias("x"), (F.col("my") / F.col("area")).alias("y"))


def overlap_areas(polygons: DataFrame, cells: DataFrame, size: float, key: str = "code", rings: str = "rings", least: float = 1e-6) -> DataFrame:
    """(key, i, j, km2): the overlap of polygons and square cells of size degrees around (lon, lat), over least.

    Column expressions only: a ring's area within a cell is the sum over its sides of the area between the cell's lower
    edge and the side, cut at the cell's edges, by the side's direction. Cells meet polygons by the squares of their
    boxes, and then a polygon's sides by columns of cells.
    """
    sides = edges(polygons, key, rings)
    box = _boxes(sides, key)
    half, step = size / 2, F.lit(float(size))
    column, row = F.floor(F.col("lon") / step), F.floor(F.col("lat") / step)
    span = lambda a, b: F.sequence(F.floor((a - half) / step), F.floor((b + half) / step))
    boxed = box.withColumn("_col", F.explode(span(F.col("_x0"), F.col("_x1")))).withColumn("_row", F.explode(span(F.col("_y0"), F.col("_y1"))))
    held = boxed.select(key, "_col", "_row").join(cells.select("i", "j", "lon", "lat", column.alias("_col"), row.alias("_row")), ["_col", "_row"])
    cut = sides.where("x1 != x2").withColumn("_col", F.explode(span(F.least("x1", "x2"), F.greatest("x1", "x2"))))
    met = held.join(cut, [key, "_col"])
    low, high = F.col("lat") - half, F.col("lat") + half
    a, b = F.greatest(F.least("x1", "x2"), F.col("lon") - half), F.least(F.greatest("x1", "x2"), F.col("lon") + half)
    at = lambda x: F.col("y1") + (F.col("y2") - F.col("y1")) * (x - F.col("x1")) / (F.col("x2") - F.col("x1"))
    met = met.withColumn("_a", a).withColumn("_b", b).where("_b > _a").withColumn("_ya", at(F.col("_a"))).withColumn("_yb", at(F.col("_b")))
    height = lambda y: F.least(F.greatest(y - low, F.lit(0.0)), F.lit(float(size)))
    # The integral of the height over y: nothing under the cell, a square's half in it, then all of its height.
    total = lambda y: height(y) * height(y) / 2 + F.greatest(y - high, F.lit(0.0)) * size
    flat = F.abs(F.col("_yb") - F.col("_ya")) < 1e-12
    area = (F.col("_b") - F.col("_a")) * F.when(flat, height(F.col("_ya"))).otherwise((total(F.col("_yb")) - total(F.col("_ya"))) / F.nullif(F.col("_yb") - F.col("_ya"), F.lit(0.0)))
    signed = F.when(F.col("x2") > F.col("x1"), area).otherwise(-area)
    rings_in = met.groupBy(key, "i", "j", "lat", "ring", "is_hole").agg(F.abs(F.sum(signed)).alias("_deg2"))
    sums = rings_in.groupBy(key, "i", "j", "lat").agg(F.sum(F.when(F.col("is_hole"), -F.col("_deg2")).otherwise(F.col("_deg2"))).alias("_deg2"))
    km2 = F.col("_deg2") * 111.32 * 111.32 * F.cos(F.radians("lat"))
    return sums.select(key, "i", "j", km2.alias("km2")).where(F.col("km2") > least)


def coverage(basins: DataFrame, sides: DataFrame, stations: DataFrame, key: str = "code", alone_km: float = 15.0) -> DataFrame:
    """Gauges inside each basin by network, distance of the nearest to the basin's centre, and whether it is ungauged:
    none inside and none within alone_km. basins has key, x, y (lon, lat). Without stations the distance is null and every
    basin ungauged."""
    held = in_polygon(stations, sides, "station", key=key)
    counts = held.groupBy(key).agg(*[F.count_if(network(F.col("station")) == n).alias(c) for n, c in (("ASOS", "n_asos"), ("AWS", "n_aws"))])
    centres = basins.select(key, "x", "y", (F.cos(F.radians("y")) * 111.32).alias("_kx"), F.lit(110.57).alias("_ky"))
    near = k_nearest(centres, stations, [key], "x", "y", "station", "lon", "lat", weights=("_kx", "_ky")).select(key, F.col("distance").alias("nearest_km"))
    out = basins.select(key).join(counts, key, "left").join(near, key, "left").select(key, F.coalesce("n_asos", F.lit(0)).alias("n_asos"), F.coalesce("n_aws", F.lit(0)).alias("n_aws"), "nearest_km")
    return out.withColumn("ungauged", (F.col("n_asos") + F.col("n_aws") == 0) & (F.coalesce("nearest_km", F.lit(float("inf"))) >= alone_km))
