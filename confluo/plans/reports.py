"""The tables behind maps and reports: pixel scores, area means, completeness rules, set differences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import align, basin, events, gapfill, geo, metrics, time
from ..sources import adapters as a
from .evaluation import _KGE, _kge_sql
from .geography import CELLS_SQL, grid_cells
from .preprocess import _FILL, rounded
from .registry import query


@query(f"""
WITH {a.obs_px_sql(16)}, g AS (SELECT i, j, count(*) AS n, covar_pop(gpm, aws) / nullif(stddev_pop(gpm) * stddev_pop(aws), 0) AS r, stddev_pop(gpm - aws) AS ub, avg(gpm - aws) AS bias
  FROM obs WHERE gpm IS NOT NULL AND aws IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT i, j, n, round(r, 4) AS r, round(ub, 4) AS ubrmse, round(bias, 4) AS bias FROM g
""")
def pixel_maps(spark, sf_dir):
    out = metrics.full(a.obs_px(spark, sf_dir, 16), ["i", "j"], "gpm", "aws", min_n=10).where("n >= 10")
    return rounded(out.select("i", "j", "n", "r", "ubrmse", "bias"))


@query(f"WITH {a.obs_px_sql(16)} SELECT day, round(avg(gpm), 4) AS gpm, round(avg(aws), 4) AS aws FROM obs WHERE i BETWEEN 1 AND 2 AND j BETWEEN 0 AND 2 GROUP BY day")
def bounding_box_mean(spark, sf_dir):
    box = a.obs_px(spark, sf_dir, 16).where(F.col("i").between(1, 2) & F.col("j").between(0, 2))
    return rounded(box.groupBy("day").agg(F.avg("gpm").alias("gpm"), F.avg("aws").alias("aws")))


@query(f"""
WITH {_FILL.format(v="aws")}, d AS (SELECT CASE WHEN aws IS NOT NULL THEN 'own' ELSE 'filled' END AS part, coalesce(aws, CASE WHEN gpm <= 0.1 THEN 0 ELSE q * gpm END) AS v, asos
  FROM obs o LEFT JOIN us ON us.day = o.day AND us.cell = o.cell WHERE asos IS NOT NULL)
SELECT coalesce(part, 'all') AS part, count(v) AS n, round(avg(v - asos), 3) AS bias, round(sqrt(avg((v - asos) ** 2)), 3) AS rmse FROM d GROUP BY ROLLUP (part)
""")
def fill_comparison(spark, sf_dir):
    done = gapfill.ratio_fill(a.obs_px(spark, sf_dir, 16), "aws", "gpm", "i", "j").where("asos is not null")
    d = F.col("filled") - F.col("asos")
    parts = done.withColumn("part", F.when(F.col("how") == "own", "own").otherwise("filled")).rollup("part")
    return parts.agg(F.count("filled").alias("n"), F.round(F.avg(d), 3).alias("bias"), F.round(F.sqrt(F.avg(d * d)), 3).alias("rmse")).withColumn("part", F.coalesce("part", F.lit("all")))


@query(f"""
WITH {a.LONG_SQL}, u AS (SELECT cell, 'sim1' AS product, sim1 AS s, obs AS o FROM ser UNION ALL SELECT cell, 'sim2', sim2, obs FROM ser), g AS (SELECT cell, product, {_kge_sql("s", "o")} FROM u GROUP BY 1, 2)
SELECT cell, round(max(CASE WHEN product = 'sim1' THEN {_KGE} END), 4) AS sim1, round(max(CASE WHEN product = 'sim2' THEN {_KGE} END), 4) AS sim2 FROM g GROUP BY cell
""")
def kge_pivot(spark, sf_dir):
    rows = a.long_series(spark, sf_dir).select("cell", "obs", F.explode(F.create_map(F.lit("sim1"), "sim1", F.lit("sim2"), "sim2")).alias("product", "s"))
    return rounded(metrics.kge(rows, ["cell", "product"], "s", "obs", 1).groupBy("cell").pivot("product", ["sim1", "sim2"]).agg(F.first("kge")))


@query(f"""
WITH {a.obs_px_sql(16)}, {a.BRIDGE_SQL} SELECT code, day, round(CASE WHEN count(gpm) = count(*) THEN sum(km2 * gpm) / sum(km2) END, 4) AS gpm, count(gpm) = count(*) AS complete
FROM obs JOIN br ON obs.i = br.i AND obs.j = br.j GROUP BY 1, 2
""")
def complete_basin_days(spark, sf_dir):
    rows = a.obs_px(spark, sf_dir, 16).join(a.bridge(spark), ["i", "j"]).groupBy("code", "day")
    every = F.count("gpm") == F.count("*")
    return rounded(rows.agg(F.when(every, F.sum(F.col("km2") * F.col("gpm")) / F.sum("km2")).alias("gpm"), every.alias("complete")))


@query(f"WITH {a.obs_px_sql(16)} SELECT cell, round(CASE WHEN count(aws) = count(*) THEN sum(aws) END, 6) AS total, count(aws) AS n FROM obs WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY cell")
def context_period_sums(spark, sf_dir):
    rows = a.obs_px(spark, sf_dir, 16).where("day between date'2024-01-05' and date'2024-01-12'").groupBy("cell")
    return rounded(rows.agg(F.when(F.count("aws") == F.count("*"), F.sum("aws")).alias("total"), F.count("aws").alias("n")), 6)


@query(f"""
WITH {a.LONG_SQL}, b AS (SELECT (cell + 1) * 10 % 60 + 13 AS code, sim1, obs FROM ser), r AS (SELECT CASE CAST(floor(code / 10) AS INTEGER) WHEN 1 THEN 'Han' WHEN 2 THEN 'Nakdong' WHEN 3 THEN 'Geum' WHEN 4 THEN 'Seomjin' WHEN 5 THEN 'Yeongsan' WHEN 6 THEN 'Jeju' END AS region, sim1, obs FROM b),
g AS (SELECT region, {_kge_sql("sim1", "obs")}, 100 * (avg(sim1) - avg(obs)) / avg(obs) AS rel, count(*) FILTER (WHERE sim1 >= 30 AND obs >= 30) AS h, count(*) FILTER (WHERE sim1 >= 30 OR obs >= 30) AS anyw FROM r GROUP BY region)
SELECT region, n, round({_KGE}, 4) AS kge, round(rel, 4) AS rbias, round(h / nullif(anyw, 0), 4) AS csi FROM g
""")
def region_summary(spark, sf_dir):
    rows = a.long_series(spark, sf_dir).withColumn("region", scalars.region((F.col("cell") + 1) * 10 % 60 + 13))
    return rounded(metrics.full(rows, ["region"], "sim1", "obs", wet=30.0).select("region", "n", "kge", "rbias", "csi"))


@query(f"""
WITH {a.obs_px_sql(16)}, all_days AS (SELECT DISTINCT day FROM obs), com AS (SELECT day FROM obs GROUP BY day HAVING count(sm2rain) > 0 AND count(gpm) > 0 AND count(aws) >= 14)
SELECT day FROM all_days WHERE day NOT IN (SELECT day FROM com)
""")
def dropped_days(spark, sf_dir):
    obs = a.obs_px(spark, sf_dir, 16)
    full = obs.groupBy("day").agg(F.count("aws").alias("n")).where("n >= 14").select("day")
    kept = align.common_days(obs, ["sm2rain", "gpm"]).join(full, "day", "left_semi")
    return obs.select("day").distinct().join(kept, "day", "left_anti")


@query(f"WITH {a.STATIONS_SQL}, {a.PLACES_SQL}, k AS (SELECT code, station, row_number() OVER (PARTITION BY code ORDER BY (x - lon) * (x - lon) + (y - lat) * (y - lat), station) AS k FROM plc, stn) SELECT code, station FROM k WHERE k <= 8")
def station_candidates(spark, sf_dir):
    return geo.nearest_candidates(a.basin_places(spark, sf_dir), a.stations(spark, sf_dir), "code", "x", "y", "station", "lon", "lat", 8)


@query(f"""
WITH {a.SIDES_SQL}, ring AS (SELECT code, ring, is_hole, sum(x1 * y2 - x2 * y1) AS a FROM side GROUP BY 1, 2, 3)
SELECT code, round(sum(CASE WHEN is_hole THEN -1 ELSE 1 END * abs(a) / 2), 6) AS area FROM ring GROUP BY code
""")
def basin_geometry(spark, sf_dir):
    return rounded(geo.shoelace(geo.edges(a.polygons(spark, sf_dir))).select("code", "area"), 6)


@query(f"""
WITH {a.STATIONS_SQL}, {CELLS_SQL}, k AS (SELECT station, i, j, row_number() OVER (PARTITION BY station ORDER BY (cl.lon - stn.lon) * (cl.lon - stn.lon) + (cl.lat - stn.lat) * (cl.lat - stn.lat), i, j) AS k FROM stn, cl)
SELECT station, i, j FROM k WHERE k = 1
""")
def nearest_cell(spark, sf_dir):
    cells = grid_cells(spark).select(F.struct("i", "j").alias("cell"), F.col("lon").alias("cx"), F.col("lat").alias("cy"))
    return geo.nearest(a.stations(spark, sf_dir), cells, ["station"], "lon", "lat", "cell", "cx", "cy").select("station", "cell.i", "cell.j")


@query("""
WITH d AS (SELECT user_id AS station, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2), span AS (SELECT min(day) AS a, max(day) AS b FROM d),
cal AS (SELECT s.station, CAST(t.day AS DATE) AS day FROM (SELECT DISTINCT station FROM d) s, (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM span) t)
SELECT cal.station, cal.day, round(v, 3) AS v FROM cal LEFT JOIN d ON d.station = cal.station AND d.day = cal.day
""")
def calendar_reindex(spark, sf_dir):
    rows = a.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("station"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return rounded(time.calendar(rows, ["station"]), 3)


@query(f"""
WITH {a.LONG_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY obs DESC, day) AS k FROM ser)
SELECT cell, k AS rank, day, round(obs, 4) AS obs, round(min(obs) OVER (PARTITION BY cell), 4) AS u FROM k WHERE k <= 12
""")
def top_peaks(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("obs"), "day"))
    top = a.long_series(spark, sf_dir).withColumn("rank", rank).where("rank <= 12")
    return rounded(top.select("cell", "rank", "day", "obs", F.min("obs").over(Window.partitionBy("cell")).alias("u")))


@query(f"""
WITH {a.LONG_SQL}, lv AS (SELECT cell, quantile_cont(obs, 0.99) AS lv FROM ser GROUP BY cell)
SELECT ser.cell, count(*) FILTER (WHERE obs >= lv) AS exceeded, count(*) FILTER (WHERE obs >= lv AND sim1 >= lv) AS hit1, count(*) FILTER (WHERE obs >= lv AND sim2 >= lv) AS hit2 FROM ser JOIN lv ON lv.cell = ser.cell GROUP BY ser.cell
""")
def exceedance_hits(spark, sf_dir):
    ser = a.long_series(spark, sf_dir)
    levels = ser.groupBy("cell").agg(F.percentile("obs", F.lit(0.99)).alias("lv"))
    over = lambda *c: sum_and(*[F.col(x) >= F.col("lv") for x in c])
    return ser.join(levels, "cell").groupBy("cell").agg(F.count_if(over("obs")).alias("exceeded"), F.count_if(over("obs", "sim1")).alias("hit1"), F.count_if(over("obs", "sim2")).alias("hit2"))


def sum_and(*conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


@query(f"""
WITH {a.LONG_SQL}, pk AS (SELECT cell, arg_max(day, (obs, -(day - DATE '1970-01-01'))) AS peak FROM ser GROUP BY cell)
SELECT ser.cell, round(sum(obs), 6) AS obs, round(sum(sim1), 6) AS sim1, count(*) AS n FROM ser JOIN pk ON pk.cell = ser.cell AND day BETWEEN peak - 5 AND peak + 5 GROUP BY ser.cell
""")
def peak_totals(spark, sf_dir):
    near = events.around_peak(a.long_series(spark, sf_dir), ["cell"], "obs")
    return rounded(near.groupBy("cell").agg(F.sum("obs").alias("obs"), F.sum("sim1").alias("sim1"), F.count("*").alias("n")), 6)


_FLIP = "(VALUES ('none', 1, 1), ('lat', -1, 1), ('lon', 1, -1), ('both', -1, -1)) f(flip, si, sj)"


@query(f"""
WITH {a.obs_px_sql(16)}, m AS (SELECT avg(i) AS ci, avg(j) AS cj FROM obs WHERE gpm > 40), r AS (SELECT avg(3 - i) AS ci, avg(j) AS cj FROM obs WHERE gpm > 40),
d AS (SELECT flip, pow(CASE WHEN si = 1 THEN m.ci ELSE 3 - m.ci END - r.ci, 2) + pow(CASE WHEN sj = 1 THEN m.cj ELSE 3 - m.cj END - r.cj, 2) AS d2 FROM m, r, {_FLIP})
SELECT flip, round(d2, 6) AS d2 FROM d ORDER BY d2 LIMIT 1
""")
def flip_detection(spark, sf_dir):
    """The flip of a field that brings its valid cells' centre nearest to a reference's."""
    valid = a.obs_px(spark, sf_dir, 16).where("gpm > 40")
    centre, ref = valid.agg(F.avg("i").alias("ci"), F.avg("j").alias("cj")), valid.agg(F.avg(3 - F.col("i")).alias("ri"), F.avg("j").alias("rj"))
    flips = spark.createDataFrame([("none", 1, 1), ("lat", -1, 1), ("lon", 1, -1), ("both", -1, -1)], "flip string, si int, sj int")
    at = lambda s, c: F.when(F.col(s) == 1, F.col(c)).otherwise(3 - F.col(c))
    d2 = F.pow(at("si", "ci") - F.col("ri"), F.lit(2.0)) + F.pow(at("sj", "cj") - F.col("rj"), F.lit(2.0))
    tried = flips.crossJoin(centre).crossJoin(ref)  # four rows
    return rounded(tried.select("flip", d2.alias("d2")).orderBy("d2").limit(1), 6)


@query(f"""
WITH {a.obs_px_sql(16)}, {a.BRIDGE_SQL}, s AS (SELECT obs.i, obs.j, sum(gpm) AS v FROM obs WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' GROUP BY 1, 2)
SELECT code, round(sum(km2 * v) / sum(km2), 3) AS v FROM s JOIN br ON s.i = br.i AND s.j = br.j WHERE v IS NOT NULL GROUP BY code
""")
def period_cumulative(spark, sf_dir):
    """A period's sum by cell, then the area mean over the basin's cells."""
    sums = a.obs_px(spark, sf_dir, 16).where("day between date'2024-01-03' and date'2024-01-09'").groupBy("i", "j").agg(F.sum("gpm").alias("v"))
    return rounded(basin.area_mean(sums.withColumn("day", F.lit(1)), a.bridge(spark), ["i", "j"], "v", least_share=0.0).drop("day"), 3)
