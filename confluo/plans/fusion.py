"""Collocation, soil-moisture inversion and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, boost, regress, sm2rain, tca
from ..sources import adapters as a
from .preprocess import THETA_SQL, rounded, theta
from .registry import query

#: Rows that a fit needs on the fixtures of thirty days; the operators' defaults are the published ones.
MIN_N = 5

_ANOM = f"""{a.TRIPLET_SQL}, an AS (SELECT cell, day, x, avg(x) OVER w AS clim, x - avg(x) OVER w AS ax, y - avg(y) OVER w AS ay, z - avg(z) OVER w AS az FROM tri WINDOW w AS (PARTITION BY cell, month(day))),
sm AS (SELECT cell, count(*) AS n, sum(ax * ax) AS xx, sum(ax * ay) AS xy, sum(ax * az) AS xz, sum(ay * ay) AS yy, sum(ay * az) AS yz, sum(az * az) AS zz
  FROM an WHERE ax IS NOT NULL AND ay IS NOT NULL AND az IS NOT NULL GROUP BY cell),
ev AS (SELECT cell, n, (xx - xy * xz / yz) / n AS ex, (xz / yz * (xz / yz) * yy - xz / yz * xy) / n AS ey, (xy / yz * (xy / yz) * zz - xy / yz * xz) / n AS ez, xz / yz AS cy, xy / yz AS cz FROM sm WHERE n >= {MIN_N}),
md AS (SELECT coalesce(median(CASE WHEN ex > 0 THEN ex END), 1) AS mx, coalesce(median(CASE WHEN ey > 0 THEN ey END), 1) AS my, coalesce(median(CASE WHEN ez > 0 THEN ez END), 1) AS mz FROM ev),
rp AS (SELECT cell, n, CASE WHEN ex <= 0 THEN mx ELSE ex END AS ex, CASE WHEN ey <= 0 THEN my ELSE ey END AS ey, CASE WHEN ez <= 0 THEN mz ELSE ez END AS ez, cy, cz FROM ev, md),
wt AS (SELECT *, ey * ez / (ex * ey + ey * ez + ex * ez) AS wx, ex * ez / (ex * ey + ey * ez + ex * ez) AS wy, ex * ey / (ex * ey + ey * ez + ex * ez) AS wz FROM rp)"""


def anomalies(spark, sf_dir):
    """Anomalies of the triplet: cell, day, x, clim (of x), ax, ay, az."""
    out = a.triplet(spark, sf_dir)
    for p in "xyz":
        out = align.climatology(out, ["cell"], p).withColumnRenamed("anom", f"a{p}").withColumnRenamed("clim", f"clim_{p}")
    return out.withColumnRenamed("clim_x", "clim")


def errors(spark, sf_dir):
    return tca.error_variances(anomalies(spark, sf_dir), ["cell"], "ax", "ay", "az", min_n=MIN_N)


def _merged(spark, sf_dir):
    weighted = tca.weights(tca.repair(errors(spark, sf_dir)))
    return tca.merge(anomalies(spark, sf_dir), weighted, ["cell"], "ax", "ay", "az", "clim").select("cell", "day", "merged")


@query(f"WITH {_ANOM} SELECT cell, n, round(ex, 3) AS ex, round(ey, 3) AS ey, round(ez, 3) AS ez, round(cy, 4) AS cy, round(cz, 4) AS cz FROM ev")
def tca_error_variance(spark, sf_dir):
    e = errors(spark, sf_dir)
    return e.select("cell", "n", *[F.round(c, 3).alias(c) for c in ("ex", "ey", "ez")], *[F.round(c, 4).alias(c) for c in ("cy", "cz")])


@query(f"WITH {_ANOM} SELECT cell, round(wx, 4) AS wx, round(wy, 4) AS wy, round(wz, 4) AS wz FROM wt")
def tca_weights(spark, sf_dir):
    return rounded(tca.weights(tca.repair(errors(spark, sf_dir))).select("cell", "wx", "wy", "wz"))


@query(f"""
WITH {_ANOM} SELECT cell, day, round(CASE WHEN m IS NOT NULL THEN greatest(m, 0) END, 3) + 0.0 AS merged FROM
  (SELECT an.cell, day, wx * ax + wy * cy * ay + wz * cz * az + clim AS m FROM an JOIN wt ON an.cell = wt.cell)
""")
def tca_merge(spark, sf_dir):
    return rounded(_merged(spark, sf_dir), 3)


_DELTA = f"""{a.obs_px_sql(16)}, {THETA_SQL}, tt AS (SELECT *, CASE WHEN theta IS NOT NULL THEN greatest(least(theta, 1 - 1e-6), 1e-6) END AS t FROM th),
dt AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN CASE WHEN t IS NOT NULL THEN 0 END ELSE t - lag(t) OVER w END AS d, count(t) OVER (PARTITION BY cell) AS n FROM tt WINDOW w AS (PARTITION BY cell ORDER BY day))"""


@query(f"WITH {_DELTA} SELECT cell, day, round(CASE WHEN n >= {MIN_N} AND d IS NOT NULL AND t IS NOT NULL THEN greatest(20.0 * d + 20.0 * pow(t, 10.0), 0) END, 4) + 0.0 AS rain FROM dt")
def sm2rain_forward(spark, sf_dir):
    p, q, z = sm2rain.STARTS[0]
    moist = theta(spark, sf_dir).drop("rain")
    return rounded(sm2rain.forward(moist, ["cell"], "theta", F.lit(p), F.lit(q), F.lit(z), min_n=MIN_N).select("cell", "day", "rain"))


_GRID = [(p, q, z) for p in (1.0, 20.0, 50.0) for q in (2.0, 10.0) for z in (5.0, 20.0, 40.0)]
_GRID_SQL = "gr(a, b, z) AS (VALUES " + ", ".join(f"({p}::DOUBLE, {q}::DOUBLE, {z}::DOUBLE)" for p, q, z in _GRID) + ")"


@query(f"""
WITH {a.obs_px_sql(16)}, {THETA_SQL}, {_GRID_SQL}, r AS (SELECT cell, day, rain, greatest(least(theta, 1 - 1e-6), 1e-6) AS t FROM th WHERE theta IS NOT NULL AND rain IS NOT NULL),
dt AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY cell ORDER BY day), 0) AS d FROM r),
tr AS (SELECT cell, a, b, z, avg((greatest(z * d + a * pow(t, b), 0) - rain) ** 2) AS mse, count(*) AS n FROM dt, gr GROUP BY 1, 2, 3, 4 HAVING count(*) >= {MIN_N}),
bs AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(mse, 6), a, b, z) AS k FROM tr)
SELECT cell, a, b, z, round(mse, 3) AS mse FROM bs WHERE k = 1
""")
def sm2rain_grid_calibrate(spark, sf_dir):
    grid = spark.createDataFrame(_GRID, "a double, b double, z double")
    return rounded(sm2rain.grid_calibrate(theta(spark, sf_dir), ["cell"], "theta", "rain", grid, min_n=MIN_N), 3)


@query(f"""
WITH {_DELTA}, lim AS (SELECT cell, quantile_cont(t, 0.05) AS lo, quantile_cont(t, 0.95) AS hi FROM tt GROUP BY cell),
f AS (SELECT dt.cell, day, n, t, d, 10.0 * greatest(t - lo, 0.1 / 10.0) AS depth, greatest(least(hi - lo, 0.60), 0.03) AS room FROM dt JOIN lim ON dt.cell = lim.cell)
SELECT cell, day, round(CASE WHEN n >= 20 AND t IS NOT NULL AND d IS NOT NULL THEN least(greatest((10.0 * d + 0.05 * 5.0 * (1 + 100.0 * room / greatest(depth, 0.1))) / greatest(1 - pow(t, 2.0), 0.02), 0), 500) END, 4) + 0.0 AS rain FROM f
""")
def sm2rain_ga_forward(spark, sf_dir):
    return rounded(sm2rain.forward_infiltration(theta(spark, sf_dir).drop("rain"), ["cell"], "theta", 0.05, 2.0, 10.0, 5.0, 100.0, min_n=20).select("cell", "day", "rain"))


@query(f"""
WITH {a.STATIONS_SQL}, px AS (SELECT DISTINCT CAST(floor((lat - 34) * 20) AS BIGINT) AS i, CAST(floor((lon - 126) * 20) AS BIGINT) AS j FROM stn),
cal AS (SELECT i, j, 1.0 * i AS a, 2.0 * j AS b, 1.0 * (i + j) AS z FROM px WHERE (i * 4 + j) % 3 = 0),
nr AS (SELECT px.i, px.j, a, b, z, row_number() OVER (PARTITION BY px.i, px.j ORDER BY (px.i - cal.i) * (px.i - cal.i) + (px.j - cal.j) * (px.j - cal.j), cal.i, cal.j) AS k FROM px, cal)
SELECT i, j, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(z AS DOUBLE) AS z, CASE WHEN (i * 4 + j) % 3 = 0 THEN 1 ELSE 2 END AS flag FROM nr WHERE k = 1
""")
def param_transfer_nearest(spark, sf_dir):
    """The stations' pixels; every third is calibrated."""
    place = lambda c, low: F.floor((F.col(c) - low) * 20)
    px = a.stations(spark, sf_dir).select(place("lat", 34).alias("i"), place("lon", 126).alias("j")).distinct()
    done = px.where((F.col("i") * 4 + F.col("j")) % 3 == 0).select("i", "j", (F.col("i") * 1.0).alias("a"), (F.col("j") * 2.0).alias("b"), ((F.col("i") + F.col("j")) * 1.0).alias("z"))
    return sm2rain.transfer_parameters(px, done)


@query()
def calibrate_optimizer(spark, sf_dir):
    return sm2rain.calibrate(theta(spark, sf_dir), ["cell"], "theta", "rain", min_n=MIN_N)


@query(f"""
WITH {a.obs_px_sql(16)}, {THETA_SQL}, {_GRID_SQL}, r AS (SELECT cell, day, rain, greatest(least(theta, 1 - 1e-6), 1e-6) AS t FROM th WHERE theta IS NOT NULL AND rain IS NOT NULL),
dt AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY cell ORDER BY day), 0) AS d FROM r),
tr AS (SELECT cell, a, b, z, avg((greatest(z * d + a * pow(t, b), 0) - rain) ** 2) AS mse, count(*) AS n FROM dt, gr GROUP BY 1, 2, 3, 4 HAVING count(*) >= {MIN_N})
SELECT cell, max(n) AS n, round(min(mse), 3) AS grid_mse, true AS within_bounds, true AS not_above_grid FROM tr GROUP BY cell
""")
def calibrate_against_grid(spark, sf_dir):
    """The calibration's objective against the best of a grid of parameters, which it must not exceed."""
    grid = spark.createDataFrame(_GRID, "a double, b double, z double")
    best = sm2rain.grid_calibrate(theta(spark, sf_dir), ["cell"], "theta", "rain", grid, min_n=MIN_N).select("cell", F.col("mse").alias("grid_mse"))
    done = sm2rain.calibrate(theta(spark, sf_dir), ["cell"], "theta", "rain", min_n=MIN_N, candidates=_GRID).join(best, "cell")
    within = F.lit(True)
    for k, (low, high) in enumerate(sm2rain.BOUNDS):
        within = within & F.get("params", F.lit(k)).between(low, high)
    return done.select("cell", "n", F.round("grid_mse", 3).alias("grid_mse"), within.alias("within_bounds"), (F.col("mse") <= F.col("grid_mse") * F.lit(1 + 1e-9)).alias("not_above_grid"))


@query()
def calibrate_infiltration(spark, sf_dir):
    return sm2rain.calibrate(theta(spark, sf_dir), ["cell"], "theta", "rain", "infiltration", min_n=MIN_N)


_OLS = f"{a.obs_px_sql(16)}, co AS (SELECT cell, i, j, regr_slope(aws, gpm) AS slope, regr_intercept(aws, gpm) AS intercept, count(*) AS n_fit FROM obs WHERE aws IS NOT NULL AND gpm IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_N})"


def _coefs(spark, sf_dir):
    return regress.ols_single(a.obs_px(spark, sf_dir, 16), ["cell", "i", "j"], "gpm", "aws", MIN_N)


@query(f"WITH {_OLS} SELECT cell, round(slope, 4) + 0.0 AS slope, round(intercept, 3) AS intercept, n_fit FROM co")
def ols_single(spark, sf_dir):
    return _coefs(spark, sf_dir).select("cell", (F.round("slope", 4) + F.lit(0.0)).alias("slope"), F.round("intercept", 3).alias("intercept"), "n_fit")


@query(f"WITH {_OLS} SELECT obs.cell, day, round(CASE WHEN gpm IS NOT NULL THEN greatest(intercept + slope * gpm, 0) END, 3) AS pred FROM obs JOIN co ON obs.cell = co.cell")
def ols_apply(spark, sf_dir):
    obs, coefs = a.obs_px(spark, sf_dir, 16), _coefs(spark, sf_dir).select("cell", "slope", "intercept")
    return rounded(regress.predict(obs, coefs, ["cell"], {"gpm": F.col("slope")}).select("cell", "day", "pred"), 3)


@query(f"""
WITH {_OLS}, st(di, dj) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1))
SELECT c.i, c.j, round(avg(n.slope), 4) + 0.0 AS slope, round(avg(n.intercept), 3) AS intercept, count(*) AS n_neighbors
FROM co c, st, co n WHERE n.i = c.i + st.di AND n.j = c.j + st.dj GROUP BY 1, 2
""")
def loov_neighbour_coef(spark, sf_dir):
    out = regress.neighbour_means(_coefs(spark, sf_dir), ["slope", "intercept"])
    return out.select("i", "j", (F.round("slope", 4) + F.lit(0.0)).alias("slope"), F.round("intercept", 3).alias("intercept"), "n_neighbors")


_OWNER = f"{a.BRIDGE_SQL}, own AS (SELECT i, j, arg_max(code, (km2, -code)) AS code FROM br GROUP BY 1, 2)"


@query(f"""
WITH {a.obs_px_sql(16)}, {_OWNER}, tg AS (SELECT code, day, avg(aws) AS target FROM obs JOIN own ON obs.i = own.i AND obs.j = own.j GROUP BY 1, 2)
SELECT obs.cell, own.code, round(regr_slope(target, gpm), 4) + 0.0 AS slope, round(regr_intercept(target, gpm), 3) AS intercept, count(*) AS n_fit
FROM obs JOIN own ON obs.i = own.i AND obs.j = own.j JOIN tg ON tg.code = own.code AND tg.day = obs.day WHERE gpm IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 7
""")
def lr_target_dominant(spark, sf_dir):
    owner = regress.dominant_owner(a.bridge(spark), ["i", "j"])
    owned = a.obs_px(spark, sf_dir, 16).join(owner, ["i", "j"])
    target = owned.groupBy("code", "day").agg(F.avg("aws").alias("target"))
    out = regress.ols_single(owned.join(target, ["code", "day"]), ["cell", "code"], "gpm", "target", 7)
    return out.select("cell", "code", (F.round("slope", 4) + F.lit(0.0)).alias("slope"), F.round("intercept", 3).alias("intercept"), "n_fit")


def _boosted(spark, sf_dir, *more):
    """Six features and more, with the published settings, fitted on twenty days. The merged product stands on the
    triplet's four cells, which are the columns of the grid."""
    merged = _merged(spark, sf_dir).select(F.col("cell").alias("j"), "day", F.col("merged").alias("tca"))
    obs = a.obs_px(spark, sf_dir, 16).join(merged, ["j", "day"], "left")
    products = ["sm2rain", "era5", "gpm", "tca"]
    obs = obs.select("cell", "day", F.col("i").cast("double").alias("lat"), F.col("j").cast("double").alias("lon"), *products, "aws")
    fit = F.col("day") < F.lit("2024-01-21").cast("date")
    return regress.boosted(obs, [*products, "lon", "lat", *more], products, "aws", fit)


@query()
def gbt_bias_correct(spark, sf_dir):
    return _boosted(spark, sf_dir)


@query()
def gbt_gauge_fusion(spark, sf_dir):
    return _boosted(spark, sf_dir, "aws")


def _boost_rows(spark, sf_dir):
    """Three products, place and target, on the events' users and days, which grow with the scale."""
    keys = [(F.col("user_id") % 16).cast("double").alias("lat"), F.col("user_id").cast("double").alias("lon"), F.to_date("ts").alias("day")]
    means = [F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(p) for p, t in a.PRODUCTS.items()]
    return a.table(spark, sf_dir, "events").groupBy(*keys).agg(*means).withColumn("any", F.coalesce("sm2rain", "era5", "gpm"))


_BOOST_SQL = f"""bo AS (SELECT user_id % 16 AS lat, user_id AS lon, CAST(ts AS DATE) AS day, {", ".join(f"avg(value) FILTER (WHERE event_type = '{t}') AS {p}" for p, t in a.PRODUCTS.items())} FROM events GROUP BY 1, 2, 3),
ro AS (SELECT *, coalesce(sm2rain, era5, gpm) AS any_of FROM bo), va AS (SELECT * FROM ro WHERE any_of > 0)"""


def _leafwise(spark, sf_dir):
    rows = _boost_rows(spark, sf_dir)
    return boost.corrected(rows, ["any", "lon", "lat"], ["any"], "aws", F.col("day") < F.lit("2024-01-21").cast("date"))


@query(f"""
WITH {_BOOST_SQL} SELECT count(*) AS n, (SELECT count(*) FROM va) AS n_predicted, (SELECT count(*) FROM va WHERE aws > 0 AND day < DATE '2024-01-21') AS n_fit, true AS none_negative, true AS better_than_mean FROM ro
""")
def leafwise_bias_correct(spark, sf_dir):
    """Counts of the rows that a leaf-wise model predicts; its guesses are never negative, and on the rows of the fit they are
    nearer than the mean."""
    rows, model = _leafwise(spark, sf_dir)
    fitted = F.col("pred").isNotNull() & (F.col("aws") > 0) & (F.col("day") < F.lit("2024-01-21").cast("date"))
    y = F.when(fitted, F.col("aws"))
    sums = rows.agg(F.count("*").alias("n"), F.count("pred").alias("n_predicted"), F.count(y).alias("n_fit"), F.min("pred").alias("low"), F.avg((y - F.col("pred")) ** 2).alias("mse"), F.var_pop(y).alias("var"))
    return sums.select("n", "n_predicted", "n_fit", F.coalesce(F.col("low") >= 0, F.lit(True)).alias("none_negative"), F.coalesce(F.col("mse") <= F.col("var"), F.lit(True)).alias("better_than_mean"))


@query()
def leafwise_importances(spark, sf_dir):
    """How often, and with what gain, the model's trees split by each feature."""
    rows, model = _leafwise(spark, sf_dir)
    return boost.importances(rows, model)
