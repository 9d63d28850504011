"""Series of the rainfall model made from the star-schema tables, each beside the same query in SQL.

Event types stand for products: view = SM2RAIN, click = ERA5, purchase = GPM, signup = AWS (target), error = ASOS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import exact_mean

PRODUCTS = {"sm2rain": "view", "era5": "click", "gpm": "purchase", "aws": "signup", "asos": "error"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean(*types: str) -> F.Column:
    return F.avg(F.when(F.col("event_type").isin(*types), F.col("value")))


def obs_px(spark: SparkSession, sf_dir: str, m: int) -> DataFrame:
    """Daily cube of five products on m cells of a grid four wide, with real gaps: cell, i, j, day and the products."""
    cell = F.col("user_id") % m
    keys = [cell.alias("cell"), F.floor(cell / 4).alias("i"), (F.col("user_id") % 4).alias("j"), F.to_date("ts").alias("day")]
    return table(spark, sf_dir, "events").groupBy(*keys).agg(*[_mean(t).alias(p) for p, t in PRODUCTS.items()])


def obs_px_sql(m: int) -> str:
    means = ", ".join(f"avg(value) FILTER (WHERE event_type = '{t}') AS {p}" for p, t in PRODUCTS.items())
    return f"obs AS (SELECT user_id % {m} AS cell, CAST(floor((user_id % {m}) / 4) AS BIGINT) AS i, user_id % 4 AS j, CAST(ts AS DATE) AS day, {means} FROM events GROUP BY 1, 2, 3, 4)"


def triplet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three products that share signal: cell, day, x, y, z."""
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("cell"), F.to_date("ts").alias("day"))
    return rows.agg(_mean("view", "click", "signup").alias("x"), _mean("click", "purchase", "signup").alias("y"), _mean("purchase", "view", "signup").alias("z"))


TRIPLET_SQL = """tri AS (SELECT user_id % 4 AS cell, CAST(ts AS DATE) AS day,
  avg(value) FILTER (WHERE event_type IN ('view', 'click', 'signup')) AS x,
  avg(value) FILTER (WHERE event_type IN ('click', 'purchase', 'signup')) AS y,
  avg(value) FILTER (WHERE event_type IN ('purchase', 'view', 'signup')) AS z FROM events GROUP BY 1, 2)"""


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven years of an observation and two simulations on ten cells: cell, day, obs, sim1, sim2."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("cell"), F.to_date("l_shipdate").alias("day"))
    q = F.col("l_quantity")
    # Means that bins and thresholds meet: on an edge the order of a sum would decide.
    return rows.agg(exact_mean(q).alias("obs"), exact_mean(q * (1 - F.col("l_discount"))).alias("sim1"), exact_mean(q * (1 - F.col("l_tax"))).alias("sim2"))


LONG_SQL = """ser AS (SELECT l_suppkey % 10 AS cell, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS obs,
  avg(l_quantity * (1 - l_discount)) AS sim1, avg(l_quantity * (1 - l_tax)) AS sim2 FROM lineitem GROUP BY 1, 2)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by cell, day and hour of the events: cell, day, hour, mm."""
    keys = [(F.col("user_id") % 4).alias("cell"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour")]
    return table(spark, sf_dir, "events").groupBy(*keys).agg(F.sum("value").alias("mm"))


HOURLY_SQL = "hr AS (SELECT user_id % 4 AS cell, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, sum(value) AS mm FROM events GROUP BY 1, 2, 3)"

#: Corners of the basins' shells and holes, in radii from the centre.
SHELL = ((-1.0, -0.6), (0.9, -0.5), (0.7, 1.0), (-0.8, 0.9))
HOLE = ((-0.2, -0.1), (0.3, -0.2), (0.1, 0.3))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station for each supplier: station (50 times the key), lon, lat, spread over three by four degrees."""
    s = F.col("s_suppkey")
    lon, lat = F.lit(126.0) + s * 6101 % 9973 * F.lit(0.0003), F.lit(34.0) + s * 3571 % 9967 * F.lit(0.0004)
    return table(spark, sf_dir, "supplier").select((s * 50).alias("station"), lon.alias("lon"), lat.alias("lat"))


STATIONS_SQL = """stn AS (SELECT s_suppkey * 50 AS station, 126.0::DOUBLE + (s_suppkey * 6101 % 9973) * 0.0003::DOUBLE AS lon,
  34.0::DOUBLE + (s_suppkey * 3571 % 9967) * 0.0004::DOUBLE AS lat FROM supplier)"""


def basin_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for each customer's basin: code, x, y (centre), r (radius), holed."""
    k = F.col("c_custkey")
    x, y = F.lit(126.0) + k * 7919 % 10007 * F.lit(0.0003), F.lit(34.0) + k * 104729 % 10009 * F.lit(0.0004)
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("B"), k).alias("code"), x.alias("x"), y.alias("y"), (F.lit(0.04) + k % 7 * F.lit(0.01)).alias("r"), (k % 3 == 0).alias("holed"))


PLACES_SQL = """plc AS (SELECT 'B' || c_custkey AS code, 126.0::DOUBLE + (c_custkey * 7919 % 10007) * 0.0003::DOUBLE AS x, 34.0::DOUBLE + (c_custkey * 104729 % 10009) * 0.0004::DOUBLE AS y,
  0.04::DOUBLE + (c_custkey % 7) * 0.01::DOUBLE AS r, c_custkey % 3 = 0 AS holed FROM customer)"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four-sided basin for each customer, every third with a hole: code, rings."""

    def ring(is_hole, corners):
        pts = [F.struct((F.col("x") + F.col("r") * dx).alias("x"), (F.col("y") + F.col("r") * dy).alias("y")) for dx, dy in corners]
        return F.struct(F.lit(is_hole).alias("is_hole"), F.array(*pts).alias("pts"))

    rings = F.when(F.col("holed"), F.array(ring(False, SHELL), ring(True, HOLE))).otherwise(F.array(ring(False, SHELL)))
    return basin_places(spark, sf_dir).select("code", rings.alias("rings"))


def _corners() -> str:
    rows = [(k, i, *pts[i], *pts[(i + 1) % len(pts)]) for k, pts in enumerate((SHELL, HOLE)) for i in range(len(pts))]
    return "crn(ring, k, u1, w1, u2, w2) AS (VALUES " + ", ".join(f"({ring}, {k}, " + ", ".join(f"{v}::DOUBLE" for v in rest) + ")" for ring, k, *rest in rows) + ")"


SIDES_SQL = f"""{PLACES_SQL}, {_corners()}, side AS (SELECT code, ring, ring = 1 AS is_hole, x + r * u1 AS x1, y + r * w1 AS y1, x + r * u2 AS x2, y + r * w2 AS y2 FROM plc JOIN crn ON ring = 0 OR holed)"""


def bridge(spark: SparkSession) -> DataFrame:
    """Overlap of a 4 x 4 grid with basins 1 to 3: code, i, j, km2."""
    grid = spark.range(48).select((F.floor(F.col("id") / 16) + 1).alias("code"), F.floor(F.col("id") % 16 / 4).alias("i"), (F.col("id") % 4).alias("j"))
    return grid.withColumn("km2", (F.col("i") * 7 + F.col("j") * 3 + F.col("code") * 5) % 11 * 10.0).where("km2 > 0")


BRIDGE_SQL = """br AS (SELECT * FROM (SELECT b AS code, i, j, CAST((i * 7 + j * 3 + b * 5) % 11 * 10.0 AS DOUBLE) AS km2
  FROM range(1, 4) x(b), range(0, 4) y(i), range(0, 4) z(j)) WHERE km2 > 0)"""


def axis(spark: SparkSession, n: int, start: float, step: float, name: str, coordinate: str) -> DataFrame:
    return spark.range(n).select(F.col("id").alias(name), (F.lit(start) + F.col("id") * F.lit(step)).alias(coordinate))
