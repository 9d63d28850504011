"""Ingestion and day-boundary queries, regridding and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, hour_ending_day, kst_day, missing
from ..operators import align, gapfill, regrid, time
from ..sources import adapters as a
from .registry import query


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, as both engines add in different orders; negative zero becomes zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("SELECT user_id % 4 AS cell, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, round(sum(value), 4) AS total, count(value) AS n FROM events GROUP BY 1, 2")
def day_kst_sum(spark, sf_dir):
    events = a.table(spark, sf_dir, "events").withColumn("cell", F.col("user_id") % 4)
    return rounded(time.daily_sum(events, ["cell"], kst_day(F.col("ts")), "value"))


@query("""
WITH e AS (SELECT user_id % 50 AS station, CAST(ts - INTERVAL 1 HOUR AS DATE) AS day, CASE WHEN event_type <> 'error' THEN value END AS rain FROM events)
SELECT station, day, round(coalesce(sum(rain), 0), 4) AS sum_zero, round(sum(rain), 4) AS sum_null, count(rain) AS n FROM e GROUP BY 1, 2
""")
def day_hour_ending_sum(spark, sf_dir):
    events = a.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("station"), "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("rain"))
    day = hour_ending_day(F.col("ts"))
    null = time.daily_sum(events, ["station"], day, "rain").withColumnRenamed("total", "sum_null")
    zero = time.daily_sum(events, ["station"], day, "rain", empty_as_zero=True).withColumnRenamed("total", "sum_zero").drop("n")
    return rounded(zero.join(null, ["station", "day"]))


@query(f"""
WITH {a.HOURLY_SQL}
SELECT cell, day, round(sum(mm), 4) AS total, count(DISTINCT hour) AS hours FROM hr GROUP BY 1, 2 HAVING count(DISTINCT hour) = 24
""")
def complete_days(spark, sf_dir):
    return rounded(time.complete_days(a.hourly(spark, sf_dir), ["cell"], "mm"))


@query("""
WITH e AS (SELECT user_id % 4 AS cell, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, CASE WHEN value >= 1 THEN value END AS rate FROM events)
SELECT cell, day, round(sum(coalesce(rate, 0) * 0.5), 4) AS total, count(*) AS n FROM e GROUP BY 1, 2
""")
def halfhour_accumulate(spark, sf_dir):
    raw = a.table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("cell"), "ts", F.when(F.col("value") < 1, -9999.9).otherwise(F.col("value")).alias("rate"))
    return rounded(time.accumulate(raw.withColumn("rate", missing(F.col("rate"), -9999.9)), ["cell"], kst_day(F.col("ts")), "rate"))


CUMULATIVE_SQL = f"""{a.HOURLY_SQL}, span AS (SELECT min(day) AS a, max(day) AS b FROM hr),
cal AS (SELECT c.cell, CAST(d.day AS DATE) AS day, CAST(h.hour AS INTEGER) AS hour FROM (SELECT DISTINCT cell FROM hr) c,
  (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM span) d, (SELECT unnest(range(24)) AS hour) h),
flat AS (SELECT cal.*, coalesce(hr.mm, 0) AS mm FROM cal LEFT JOIN hr USING (cell, day, hour)),
run AS (SELECT cell, day, hour, CASE WHEN hour = 0 THEN sum(mm) OVER (PARTITION BY cell, day) - sum(mm) OVER (PARTITION BY cell, day)
  ELSE coalesce(sum(mm) OVER (PARTITION BY cell, day ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS c FROM flat),
tot AS (SELECT cell, day + 1 AS day, sum(mm) AS c FROM flat GROUP BY 1, 2),
cum AS (SELECT run.cell, run.day, run.hour, CASE WHEN run.hour = 0 THEN tot.c ELSE run.c END AS tp FROM run LEFT JOIN tot ON tot.cell = run.cell AND tot.day = run.day)"""


def cumulative_hours(spark, sf_dir) -> DataFrame:
    """Running totals of a day in hours 1 to 23; hour 0 holds the day before: cell, day, hour, tp."""
    from pyspark.sql import Window

    hourly = a.hourly(spark, sf_dir)
    span = hourly.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = hourly.select("cell").distinct().crossJoin(days).select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    flat = grid.join(hourly, ["cell", "day", "hour"], "left").withColumn("mm", F.coalesce("mm", F.lit(0.0)))
    earlier = Window.partitionBy("cell", "day").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    run = flat.withColumn("c", F.coalesce(F.sum("mm").over(earlier), F.lit(0.0))).select("cell", "day", "hour", "c")
    total = flat.groupBy("cell", F.date_add("day", 1).alias("day")).agg(F.sum("mm").alias("t"))
    return run.join(total, ["cell", "day"], "left").select("cell", "day", "hour", F.when(F.col("hour") == 0, F.col("t")).otherwise(F.col("c")).alias("tp"))


@query(f"""
WITH {CUMULATIVE_SQL}, nxt AS (SELECT *, lead(tp) OVER w AS n, lead(day) OVER w AS nd, lead(hour) OVER w AS nh FROM cum WINDOW w AS (PARTITION BY cell ORDER BY day, hour))
SELECT cell, day, hour, round(CASE WHEN (nd = day AND nh = hour + 1) OR (hour = 23 AND nh = 0 AND nd - day = 1)
  THEN CASE WHEN n - CASE WHEN hour = 0 THEN 0 ELSE tp END < 0 THEN 0 ELSE n - CASE WHEN hour = 0 THEN 0 ELSE tp END END END, 3) + 0.0 AS amount FROM nxt
""")
def deaccumulate(spark, sf_dir):
    return rounded(time.deaccumulate(cumulative_hours(spark, sf_dir), ["cell"], "tp").select("cell", "day", "hour", "amount"), 3)


@query("""
SELECT event_id, round(least(value, 100.0), 4) AS v FROM events WHERE user_id % 16 BETWEEN 2 AND 13 AND value <= 300
UNION ALL SELECT event_id, NULL FROM events WHERE user_id % 16 BETWEEN 2 AND 13 AND value > 300
""")
def sentinel_clean(spark, sf_dir):
    events = a.table(spark, sf_dir, "events").where((F.col("user_id") % 16).between(2, 13))
    raw = F.when(F.col("value") > 300, -9999.9).otherwise(F.col("value"))
    return rounded(events.select("event_id", clip(missing(raw, -9999.9), 0.0, 100.0).alias("v")))


def _aligned_sql(names: list[str]) -> str:
    held = " AND ".join(f"count({p}) > 0" for p in names)
    there = " AND ".join(f"{p} IS NOT NULL" for p in names)
    return f"""WITH {a.obs_px_sql(16)}, days AS (SELECT day FROM obs GROUP BY day HAVING {held})
SELECT cell, day, {", ".join(f"round({p}, 6) AS {p}" for p in names)} FROM obs WHERE day IN (SELECT day FROM days) AND {there}"""


@query(_aligned_sql(["sm2rain", "era5", "gpm"]))
def common_days_3way(spark, sf_dir):
    return rounded(align.align(a.obs_px(spark, sf_dir, 16), ["sm2rain", "era5", "gpm"]).select("cell", "day", "sm2rain", "era5", "gpm"), 6)


@query(_aligned_sql(list(a.PRODUCTS)))
def common_days_6way(spark, sf_dir):
    return rounded(align.align(a.obs_px(spark, sf_dir, 16), list(a.PRODUCTS)).select("cell", "day", *a.PRODUCTS), 6)


@query(f"WITH {a.LONG_SQL} SELECT cell, day, round(avg(obs) OVER w, 4) AS clim, round(obs - avg(obs) OVER w, 4) + 0.0 AS anom FROM ser WINDOW w AS (PARTITION BY cell, month(day))")
def climatology_anomaly(spark, sf_dir):
    return rounded(align.climatology(a.long_series(spark, sf_dir), ["cell"], "obs").select("cell", "day", "clim", "anom"))


THETA_SQL = "th AS (SELECT cell, i, j, day, (sm2rain - min(sm2rain) OVER w) / (max(sm2rain) OVER w - min(sm2rain) OVER w + 1e-6) AS theta, gpm AS rain FROM obs WINDOW w AS (PARTITION BY cell))"


def theta(spark, sf_dir, m: int = 16) -> DataFrame:
    return a.obs_px(spark, sf_dir, m).select("cell", "i", "j", "day", time.min_max(["cell"], "sm2rain").alias("theta"), F.col("gpm").alias("rain"))


@query(f"WITH {a.obs_px_sql(16)}, {THETA_SQL} SELECT cell, day, round(theta, 6) AS theta FROM th")
def minmax_normalise(spark, sf_dir):
    return rounded(theta(spark, sf_dir).select("cell", "day", "theta"), 6)


AXES_SQL = """ax AS (SELECT k AS t, least(CAST(greatest(ceil(k * 0.05 / 0.1 - 1e-9) - 1, 0) AS BIGINT), 2) AS lo FROM range(7) r(k)),
axw AS (SELECT t, lo AS s, 1 - (t * 0.05 - lo * 0.1) / 0.1 AS w FROM ax UNION ALL SELECT t, lo + 1, (t * 0.05 - lo * 0.1) / 0.1 FROM ax)"""


def _axes(spark) -> tuple[DataFrame, DataFrame]:
    """Weight tables from the 0.1 degree axes to the 0.05 degree ones."""
    rows = regrid.axis_weights(a.axis(spark, 4, 0.0, 2.0, "i", "lat"), a.axis(spark, 7, 0.0, 1.0, "ti", "tlat"), "i", "lat", "ti", "tlat")
    cols = regrid.axis_weights(a.axis(spark, 4, 0.0, 2.0, "j", "lon"), a.axis(spark, 7, 0.0, 1.0, "tj", "tlon"), "j", "lon", "tj", "tlon")
    return rows, cols


_SPREAD = """spread AS (SELECT y.t AS ti, x.t AS tj, o.day, y.w * x.w AS w, o.gpm AS v FROM obs o JOIN axw y ON o.i = y.s JOIN axw x ON o.j = x.s)"""


@query(f"""
WITH {a.obs_px_sql(16)}, {AXES_SQL}, {_SPREAD}, s AS (SELECT ti, tj, day, sum(w * v) AS num, coalesce(sum(CASE WHEN v IS NOT NULL THEN w END), 0) AS den FROM spread GROUP BY 1, 2, 3)
SELECT ti, tj, day, round(CASE WHEN den > 0.5 + 1e-9 THEN num / den END, 8) AS gpm FROM s
""")
def regrid_bilinear_nan(spark, sf_dir):
    return rounded(regrid.regrid(a.obs_px(spark, sf_dir, 16), *_axes(spark), "gpm"), 8)


@query(f"""
WITH {a.obs_px_sql(16)}, {AXES_SQL}, {_SPREAD}, s AS (SELECT ti, tj, day, sum(w * v) AS num, count(v) AS got, count(*) AS n FROM spread GROUP BY 1, 2, 3)
SELECT ti, tj, day, round(CASE WHEN got = n AND n = 4 THEN num END, 8) AS gpm FROM s
""")
def regrid_bilinear_plain(spark, sf_dir):
    return rounded(regrid.regrid(a.obs_px(spark, sf_dir, 16), *_axes(spark), "gpm", min_cover=None), 8)


@query(f"""
WITH {a.obs_px_sql(16)}, att AS (SELECT cell, day, sm2rain AS v, row_number() OVER (PARTITION BY cell ORDER BY day) AS k, count(sm2rain) OVER (PARTITION BY cell) AS n FROM obs),
pk AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN k END) OVER (PARTITION BY cell ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ka,
  min(CASE WHEN v IS NOT NULL THEN k END) OVER (PARTITION BY cell ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb FROM att)
SELECT p.cell, p.day, p.v IS NULL AS was_missing, round(CASE WHEN p.v IS NOT NULL THEN p.v WHEN p.n >= 2 THEN
  coalesce(a.v + (b.v - a.v) * (p.k - p.ka) / nullif(p.kb - p.ka, 0), a.v, b.v) END, 6) AS filled
FROM pk p LEFT JOIN att a ON a.cell = p.cell AND a.k = p.ka LEFT JOIN att b ON b.cell = p.cell AND b.k = p.kb
""")
def gap_interpolate_linear(spark, sf_dir):
    return rounded(time.interpolate_gaps(a.obs_px(spark, sf_dir, 16), ["cell"], "sm2rain").select("cell", "day", "was_missing", "filled"), 6)


#: Missing target cells take the ratio to the guide over cells within 150 km; the fixture's cells are a degree apart.
_FILL = f"""{a.obs_px_sql(16)}, src AS (SELECT day, cell, i, j, greatest(least(aws / gpm, 5), 0) AS r FROM obs WHERE aws IS NOT NULL AND gpm > 0.1),
pr AS (SELECT o.day, o.cell, o.gpm, s.r, s.cell AS sc, sqrt(((o.i - s.i) * 88.0) * ((o.i - s.i) * 88.0) + ((o.j - s.j) * 111.0) * ((o.j - s.j) * 111.0)) AS km
  FROM obs o JOIN src s ON o.day = s.day WHERE o.{{v}} IS NULL AND o.gpm > 0.1),
rk AS (SELECT *, sum(CASE WHEN km <= 150 THEN 1 ELSE 0 END) OVER w AS near, count(*) OVER w AS al, row_number() OVER (PARTITION BY day, cell ORDER BY km, sc) AS k FROM pr WINDOW w AS (PARTITION BY day, cell)),
us AS (SELECT day, cell, sum(r / greatest(km, 1) ** 2) / sum(1 / greatest(km, 1) ** 2) AS q FROM rk WHERE al >= 3 AND CASE WHEN near >= 3 THEN km <= 150 ELSE k <= 3 END GROUP BY 1, 2)"""


@query(f"""
WITH {_FILL.format(v="aws")}
SELECT o.cell, o.day, CASE WHEN aws IS NOT NULL THEN 'own' WHEN gpm <= 0.1 THEN 'dry' WHEN q IS NOT NULL THEN 'ratio' ELSE 'none' END AS how,
  round(CASE WHEN aws IS NOT NULL THEN aws WHEN gpm <= 0.1 THEN 0 ELSE q * gpm END, 4) AS filled
FROM obs o LEFT JOIN us ON us.day = o.day AND us.cell = o.cell
""")
def ratio_guided_fill(spark, sf_dir):
    obs = a.obs_px(spark, sf_dir, 16).select("cell", "i", "j", "day", "aws", "gpm")
    return rounded(gapfill.ratio_fill(obs, "aws", "gpm", "i", "j").select("cell", "day", "how", "filled"))


_HELD = "obs0 AS (SELECT * FROM obs_all), obs AS (SELECT cell, i, j, day, gpm, aws AS truth, CASE WHEN (cell * 31 + (day - DATE '2024-01-01') * 7) % 5 <> 0 THEN aws END AS aws FROM obs0)"


@query(f"""
WITH {a.obs_px_sql(16).replace("obs AS", "obs_all AS", 1)}, {_HELD}, {_FILL.format(v="aws").split(", src AS", 1)[1].join(["src AS", ""])}
SELECT count(*) AS n, round(avg(q * gpm - truth), 3) AS bias, round(sqrt(avg((q * gpm - truth) ** 2)), 3) AS rmse,
  round(covar_pop(q * gpm, truth) / nullif(stddev_pop(q * gpm) * stddev_pop(truth), 0), 4) AS r
FROM obs o JOIN us ON us.day = o.day AND us.cell = o.cell WHERE aws IS NULL AND truth IS NOT NULL
""")
def fill_holdout_score(spark, sf_dir):
    from ..functions.scalars import corr

    hidden = (F.col("cell") * 31 + F.datediff("day", F.lit("2024-01-01")) * 7) % 5 == 0
    obs = a.obs_px(spark, sf_dir, 16).select("cell", "i", "j", "day", "gpm", F.col("aws").alias("truth"), F.when(~hidden, F.col("aws")).alias("aws"))
    done = gapfill.ratio_fill(obs, "aws", "gpm", "i", "j").where("how = 'ratio' and truth is not null")
    d = F.col("filled") - F.col("truth")
    return done.agg(F.count("*").alias("n"), F.round(F.avg(d), 3).alias("bias"), F.round(F.sqrt(F.avg(d * d)), 3).alias("rmse"), F.round(corr(F.col("filled"), F.col("truth")), 4).alias("r"))


@query()
def spatial_fill(spark, sf_dir):
    obs = a.obs_px(spark, sf_dir, 16).select("cell", F.col("i").cast("double").alias("y"), F.col("j").cast("double").alias("x"), "day", "aws")
    return gapfill.spatial_fill(obs, ["day"], "aws", "x", "y").select("cell", "day", "aws", "filled")


@query(f"""
WITH {a.obs_px_sql(16)}, f AS (SELECT day, cell, i AS y, j AS x, CASE WHEN aws IS NOT NULL THEN 2.0::DOUBLE * j + 3.0::DOUBLE * i END AS v FROM obs), val AS (SELECT * FROM f WHERE v IS NOT NULL),
ok AS (SELECT day FROM val GROUP BY day HAVING count(*) >= 4), mis AS (SELECT f.* FROM f JOIN ok USING (day) WHERE v IS NULL),
t AS (SELECT m.day, m.cell, (a.x - m.x) * (b.y - m.y) - (b.x - m.x) * (a.y - m.y) AS p, (b.x - m.x) * (c.y - m.y) - (c.x - m.x) * (b.y - m.y) AS q, (c.x - m.x) * (a.y - m.y) - (a.x - m.x) * (c.y - m.y) AS r
  FROM mis m JOIN val a ON a.day = m.day JOIN val b ON b.day = m.day AND b.cell > a.cell JOIN val c ON c.day = m.day AND c.cell > b.cell),
ins AS (SELECT DISTINCT day, cell FROM t WHERE p + q + r <> 0 AND (p >= 0 AND q >= 0 AND r >= 0 OR p <= 0 AND q <= 0 AND r <= 0)),
nr AS (SELECT m.day, m.cell, arg_min(val.v, ((val.x - m.x) * (val.x - m.x) + (val.y - m.y) * (val.y - m.y), val.x, val.y)) AS v FROM mis m JOIN val ON val.day = m.day GROUP BY 1, 2)
SELECT f.day, f.cell, round(CASE WHEN f.v IS NOT NULL THEN f.v WHEN ins.cell IS NOT NULL THEN 2 * x + 3 * y ELSE nr.v END, 6) AS filled
FROM f LEFT JOIN ins ON ins.day = f.day AND ins.cell = f.cell LEFT JOIN nr ON nr.day = f.day AND nr.cell = f.cell
""")
def spatial_fill_linear(spark, sf_dir):
    """A linear field with a product's gaps: within the hull of a day's valid cells the fill gives it back, beyond it the nearest."""
    x, y = F.col("j").cast("double"), F.col("i").cast("double")
    obs = a.obs_px(spark, sf_dir, 16).select("cell", "day", x.alias("x"), y.alias("y"), F.when(F.col("aws").isNotNull(), 2 * x + 3 * y).alias("v"))
    return rounded(gapfill.spatial_fill(obs, ["day"], "v", "x", "y").select("day", "cell", "filled"), 6)


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id % 4 AS cell, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT day, round(max(v) FILTER (WHERE cell = 0), 2) AS c0, round(max(v) FILTER (WHERE cell = 1), 2) AS c1,
  round(max(v) FILTER (WHERE cell = 2), 2) AS c2, round(max(v) FILTER (WHERE cell = 3), 2) AS c3 FROM d GROUP BY day
""")
def pivot_day_cell(spark, sf_dir):
    from ..sources.sinks import wide

    events = a.table(spark, sf_dir, "events").withColumn("cell", F.concat(F.lit("c"), F.col("user_id") % 4))
    days = time.daily_sum(events, ["cell"], F.to_date("ts"), "value")
    return wide(days, "day", "cell", "total", ["c0", "c1", "c2", "c3"])
