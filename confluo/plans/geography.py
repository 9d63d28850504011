"""Polygons, stations, basins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projection import TransverseMercator
from ..operators import basin, geo, repair
from ..sources import adapters as a
from .preprocess import rounded
from .registry import query

_INSIDE = f"""{a.STATIONS_SQL}, {a.SIDES_SQL}, odd AS (SELECT s.station, d.code, d.ring, d.is_hole, count(*) % 2 AS odd FROM stn s, side d
  WHERE (d.y1 > s.lat) <> (d.y2 > s.lat) AND s.lon < (d.x2 - d.x1) * (s.lat - d.y1) / (d.y2 - d.y1) + d.x1 GROUP BY 1, 2, 3, 4),
ins AS (SELECT station, code FROM odd GROUP BY 1, 2 HAVING max(CASE WHEN NOT is_hole THEN odd END) = 1 AND coalesce(max(CASE WHEN is_hole THEN odd END), 0) = 0)"""


@query(f"WITH {_INSIDE} SELECT station, code FROM ins")
def point_in_polygon(spark, sf_dir):
    return geo.in_polygon(a.stations(spark, sf_dir), geo.edges(a.polygons(spark, sf_dir)), "station")


#: The grid of cells of 0.05 degrees that holds all basins and stations; its centres lie a little off round numbers.
CELLS_SQL = "cl AS (SELECT x.v AS i, y.v AS j, 33.90017::DOUBLE + x.v * 0.05::DOUBLE AS lat, 125.90013::DOUBLE + y.v * 0.05::DOUBLE AS lon FROM range(86) x(v), range(66) y(v))"


def grid_cells(spark):
    cells = spark.range(86 * 66).select(F.floor(F.col("id") / 66).alias("i"), (F.col("id") % 66).alias("j"))
    return cells.withColumn("lat", F.lit(33.90017) + F.col("i") * F.lit(0.05)).withColumn("lon", F.lit(125.90013) + F.col("j") * F.lit(0.05))


#: Steps of the fixtures' lattice in degrees.
STEP = 0.02
_LATTICE = f"""pts AS (SELECT b.code, x.v AS pa, y.v AS pb, b.x0 + x.v * {STEP} AS px, b.y0 + y.v * {STEP} AS py FROM
  (SELECT code, min(x1) AS x0, min(y1) AS y0, max(x1) AS xm, max(y1) AS ym FROM side GROUP BY code) b, range(16) x(v), range(16) y(v)
  WHERE x.v <= floor((b.xm - b.x0) / {STEP} + 1e-6) AND y.v <= floor((b.ym - b.y0) / {STEP} + 1e-6))"""


def _boxes(polygons):
    """The boxes of the lattices, and the polygons' sides."""
    sides = geo.edges(polygons)
    tiny = STEP * 1e-6
    boxes = sides.groupBy("code").agg(F.min("x1").alias("x0"), F.min("y1").alias("y0"), (F.max("x1") + tiny).alias("x1"), (F.max("y1") + tiny).alias("y1"))
    return boxes, sides


@query(f"""
WITH {a.STATIONS_SQL}, {a.SIDES_SQL}, {_LATTICE}, near AS (SELECT code, pa, pb, station, sqrt((px - lon) * (px - lon) + (py - lat) * (py - lat)) AS d,
  row_number() OVER (PARTITION BY code, pa, pb ORDER BY (px - lon) * (px - lon) + (py - lat) * (py - lat), station) AS k FROM pts, stn)
SELECT code, pa, pb, station, round(d, 6) AS distance FROM near WHERE k = 1
""")
def nearest_station(spark, sf_dir):
    points = geo.lattice(_boxes(a.polygons(spark, sf_dir))[0], "code", STEP)
    return rounded(geo.nearest(points, a.stations(spark, sf_dir), ["code", "pa", "pb"], "px", "py", "station", "lon", "lat"), 6)


_WEIGHTS = f"""{a.STATIONS_SQL}, {a.SIDES_SQL}, {_LATTICE}, mid AS (SELECT code, pa, pb, px + {STEP} * 0.37 AS px, py + {STEP} * 0.41 AS py FROM pts),
od AS (SELECT p.code, pa, pb, ring, is_hole, count(*) % 2 AS odd FROM mid p JOIN side d ON p.code = d.code
  AND (d.y1 > py) <> (d.y2 > py) AND px < (d.x2 - d.x1) * (py - d.y1) / (d.y2 - d.y1) + d.x1 GROUP BY 1, 2, 3, 4, 5),
inn AS (SELECT code, pa, pb FROM od GROUP BY 1, 2, 3 HAVING max(CASE WHEN NOT is_hole THEN odd END) = 1 AND coalesce(max(CASE WHEN is_hole THEN odd END), 0) = 0),
nr AS (SELECT m.code, m.pa, m.pb, station, row_number() OVER (PARTITION BY m.code, m.pa, m.pb ORDER BY (px - lon) * (px - lon) + (py - lat) * (py - lat), station) AS k
  FROM mid m JOIN inn USING (code, pa, pb), stn),
tw AS (SELECT code, station, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY code) AS w FROM nr WHERE k = 1 GROUP BY 1, 2)"""


def _thiessen(spark, sf_dir, polygons=None):
    boxes, sides = _boxes(a.polygons(spark, sf_dir) if polygons is None else polygons)
    inside = geo.inside_lattice(boxes, sides, "code", STEP, STEP * 0.37, STEP * 0.41)
    owned = geo.nearest(inside, a.stations(spark, sf_dir), ["code"], "px", "py", "station", "lon", "lat")
    return geo.thiessen_weights(owned, "code", "station")


@query(f"WITH {_WEIGHTS} SELECT code, station, n, round(w, 6) AS w FROM tw")
def thiessen_weights(spark, sf_dir):
    return rounded(_thiessen(spark, sf_dir), 6)


def rain(spark, sf_dir, event_type: str, total) -> DataFrame:
    """station, day, v: the gauges' rain; a user's events are those of the station of their number."""
    rows = a.table(spark, sf_dir, "events").where(F.col("event_type") == event_type)
    return rows.groupBy((F.col("user_id") * 50).alias("station"), F.to_date("ts").alias("day")).agg(total("value").alias("v"))


def rain_sql(event_type: str, total: str) -> str:
    return f"rain AS (SELECT user_id * 50 AS station, CAST(ts AS DATE) AS day, {total}(value) AS v FROM events WHERE event_type = '{event_type}' GROUP BY 1, 2)"


@query(f"WITH {_WEIGHTS}, {rain_sql('view', 'sum')} SELECT code, day, round(sum(w * v) / sum(w), 8) AS v, count(*) AS n_stations FROM rain JOIN tw USING (station) GROUP BY 1, 2")
def thiessen_mean(spark, sf_dir):
    return rounded(basin.thiessen_mean(rain(spark, sf_dir, "view", F.sum), _thiessen(spark, sf_dir), "station", "v"), 8)


_TM = TransverseMercator()
_T = _TM.arc_terms()
_TM_SQL = f"""
WITH {a.PLACES_SQL}, ll AS (SELECT code, x AS lon, y AS lat FROM plc),
q AS (SELECT *, radians(lat) AS p, {_TM.e2 / (1 - _TM.e2)!r}::DOUBLE AS s FROM ll),
r AS (SELECT *, {_TM.a!r} * ({_T[0]!r}::DOUBLE * p + {_T[1]!r}::DOUBLE * sin(2 * p) + {_T[2]!r}::DOUBLE * sin(4 * p) + {_T[3]!r}::DOUBLE * sin(6 * p)) AS arc,
  {_TM.a!r} / sqrt(1 - {_TM.e2!r}::DOUBLE * sin(p) * sin(p)) AS n, tan(p) * tan(p) AS t, s * cos(p) * cos(p) AS c, (radians(lon) - radians({_TM.lon0!r})) * cos(p) AS k FROM q)
SELECT code, round({_TM.east!r} + {_TM.scale!r} * n * (k + (1 - t + c) * pow(k, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * s) * pow(k, 5) / 120), 3) AS x,
  round({_TM.north!r} + {_TM.scale!r} * (arc - {_TM.arc0()!r}::DOUBLE + n * tan(p) * (k * k / 2 + (5 - t + 9 * c + 4 * c * c) * pow(k, 4) / 24
  + (61 - 58 * t + t * t + 600 * c - 330 * s) * pow(k, 6) / 720)), 3) AS y FROM r
"""


@query(_TM_SQL)
def tm_projection(spark, sf_dir):
    x, y = _TM.forward(F.col("x"), F.col("y"))
    return a.basin_places(spark, sf_dir).select("code", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""
WITH {a.obs_px_sql(16)}, {a.BRIDGE_SQL}, tot AS (SELECT code, sum(km2) AS total FROM br GROUP BY code), days AS (SELECT DISTINCT day FROM obs),
g AS (SELECT code, day, sum(km2 * gpm) AS num, sum(km2) AS den FROM obs JOIN br ON obs.i = br.i AND obs.j = br.j WHERE gpm IS NOT NULL GROUP BY 1, 2)
SELECT tot.code, days.day, round(CASE WHEN den >= 0.5 * total THEN num / den END, 4) AS gpm FROM tot CROSS JOIN days LEFT JOIN g ON g.code = tot.code AND g.day = days.day
""")
def area_weighted_basin(spark, sf_dir):
    return rounded(basin.area_mean(a.obs_px(spark, sf_dir, 16), a.bridge(spark), ["i", "j"], "gpm"))


@query(f"""
WITH {_INSIDE}, ring AS (SELECT code, ring, is_hole, sum(x1 * y2 - x2 * y1) AS a, sum((x1 * y2 - x2 * y1) * (x1 + x2)) AS cx, sum((x1 * y2 - x2 * y1) * (y1 + y2)) AS cy FROM side GROUP BY 1, 2, 3),
ctr AS (SELECT code, sum(CASE WHEN is_hole THEN -1 ELSE 1 END * sign(a) * cx / 6) / sum(CASE WHEN is_hole THEN -1 ELSE 1 END * sign(a) * a / 2) AS x,
  sum(CASE WHEN is_hole THEN -1 ELSE 1 END * sign(a) * cy / 6) / sum(CASE WHEN is_hole THEN -1 ELSE 1 END * sign(a) * a / 2) AS y FROM ring GROUP BY code),
nr AS (SELECT code, min(sqrt(pow((lon - x) * 111.32 * cos(radians(y)), 2) + pow((lat - y) * 110.57, 2))) AS km FROM ctr, stn GROUP BY code),
ct AS (SELECT code, count(*) FILTER (WHERE station < 300) AS s, count(*) FILTER (WHERE station >= 300) AS w FROM ins GROUP BY code)
SELECT nr.code, coalesce(s, 0) AS n_asos, coalesce(w, 0) AS n_aws, round(km, 3) AS nearest_km, coalesce(s, 0) + coalesce(w, 0) = 0 AND km >= 15 AS ungauged FROM nr LEFT JOIN ct USING (code)
""")
def ungauged_basins(spark, sf_dir):
    sides = geo.edges(a.polygons(spark, sf_dir))
    centres = geo.shoelace(sides).select("code", "x", "y")
    return rounded(geo.coverage(centres, sides, a.stations(spark, sf_dir)), 3)


def _broken(spark, sf_dir):
    """Basins of two squares, the second shifted by quarters of its side (alike, overlapping, touching in a corner, apart), and
    a bow-tie beside them."""
    square, tie = ((0, 0), (1, 0), (1, 1), (0, 1)), ((3, 0), (4, 1), (4, 0), (3, 1))
    places = a.basin_places(spark, sf_dir).withColumn("s", F.substring("code", 2, 18).cast("long") % 6 * F.col("r") / 4)

    def ring(shell, corners, shift):
        pts = [F.struct((F.col("x") + F.col("r") * dx + shift).alias("x"), (F.col("y") + F.col("r") * dy + shift).alias("y")) for dx, dy in corners]
        return F.struct(F.lit(False).alias("is_hole"), F.lit(shell).alias("shell"), F.array(*pts).alias("pts"))

    return places.select("code", F.array(ring(0, square, F.lit(0.0)), ring(1, square, F.col("s")), ring(2, tie, F.lit(0.0))).alias("rings"))


@query(f"""
WITH {a.PLACES_SQL}, s AS (SELECT code, r, CAST(substr(code, 2) AS BIGINT) % 6 * r / 4 AS s FROM plc)
SELECT code, round(2 * r * r - pow(greatest(r - s, 0), 2) + r * r / 2, 6) AS area FROM s
""")
def valid_basin_areas(spark, sf_dir):
    """Areas of basins whose parts overlap or cross themselves, after repair."""
    return rounded(repair.areas(repair.valid_sides(_broken(spark, sf_dir))), 6)
