"""Exports, masks, parameter reuse and basin tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, basin, gapfill, geo, metrics, regress, regrid, sm2rain
from ..sources import adapters as a
from ..sources import sinks
from .evaluation import _KGE, _kge_sql
from .fusion import _GRID, _GRID_SQL, _OWNER, MIN_N
from .geography import _INSIDE, _WEIGHTS, CELLS_SQL, _thiessen, grid_cells, rain, rain_sql
from .preprocess import THETA_SQL, rounded, theta
from .registry import query

PRODUCTS = ("sm2rain", "era5", "gpm", "aws", "asos")


def sweep_sql(source: str, group: str, xs: list[str], y: str, least: int) -> str:
    """CTEs ending in fit(group, n_fit, b1 .., b0): least squares with intercept by sweeping the covariance matrix."""
    names = [*xs, y]
    p, full = len(xs), " AND ".join(f"{c} IS NOT NULL" for c in names)
    cov = ", ".join(f"covar_pop({names[i]}, {names[j]}) AS m{i}_{j}" for i in range(p + 1) for j in range(i, p + 1))
    ctes = [f"sw0 AS (SELECT {group}, count(*) AS n_fit, {', '.join(f'avg({c}) AS mu{i}' for i, c in enumerate(names))}, {cov} FROM {source} WHERE {full} GROUP BY {group} HAVING count(*) >= {least})"]
    at = lambda i, j: f"m{min(i, j)}_{max(i, j)}"
    for k in range(p):
        cells = []
        for i in range(p + 1):
            for j in range(i, p + 1):
                d = at(k, k)
                if i == k and j == k:
                    cells.append(f"-1 / {d} AS {at(i, j)}")
                elif k in (i, j):
                    cells.append(f"{at(i, j)} / {d} AS {at(i, j)}")
                else:
                    cells.append(f"{at(i, j)} - {at(i, k)} * {at(j, k)} / {d} AS {at(i, j)}")
        ctes.append(f"sw{k + 1} AS (SELECT {group}, n_fit, {', '.join(f'mu{i}' for i in range(p + 1))}, {', '.join(cells)} FROM sw{k})")
    b = [at(i, p) for i in range(p)]
    ctes.append(f"fit AS (SELECT {group}, n_fit, {', '.join(f'{c} AS b{i + 1}' for i, c in enumerate(b))}, mu{p} - ({' + '.join(f'{c} * mu{i}' for i, c in enumerate(b))}) AS b0 FROM sw{p})")
    return ", ".join(ctes)


def _coefs(fits, key: list[str], n: int):
    return rounded(fits.select(*key, "n_fit", *[F.get("coef", F.lit(i)).alias(f"b{i + 1}") for i in range(n)], F.col("intercept").alias("b0")), 3)


@query(f"WITH {a.obs_px_sql(16)}, {sweep_sql('obs', 'cell', ['sm2rain', 'era5', 'gpm'], 'aws', 8)} SELECT cell, n_fit, round(b1, 3) + 0.0 AS b1, round(b2, 3) + 0.0 AS b2, round(b3, 3) + 0.0 AS b3, round(b0, 3) + 0.0 AS b0 FROM fit")
def ols_multi(spark, sf_dir):
    return _coefs(regress.ols_multi(a.obs_px(spark, sf_dir, 16), ["cell"], ["sm2rain", "era5", "gpm"], "aws", 8), ["cell"], 3)


#: Thiessen series of the basins that the pixels' owners name by number.
_GAUGED = f"{_WEIGHTS}, {rain_sql('signup', 'avg')}, th AS (SELECT CAST(substr(code, 2) AS BIGINT) AS code, day, sum(w * v) / sum(w) AS target FROM rain JOIN tw USING (station) GROUP BY 1, 2)"
_FIVE = ["sm2rain", "era5", "gpm", "tca", "asos"]
_LR = f"""{a.obs_px_sql(16)}, {_OWNER}, {_GAUGED}, lr AS (SELECT obs.cell, sm2rain, era5, gpm, (sm2rain + era5) / 2 + aws / 4 AS tca, asos, target
  FROM obs JOIN own ON obs.i = own.i AND obs.j = own.j JOIN th ON th.code = own.code AND th.day = obs.day)"""


def thiessen_series(spark, sf_dir, owners):
    """code, day, target: the gauge series of the basins that owners name."""
    number = F.substring("code", 2, 18).cast("long")
    wanted = a.polygons(spark, sf_dir).join(owners.select(F.concat(F.lit("B"), "code").alias("code")).distinct(), "code", "left_semi")
    out = basin.thiessen_mean(rain(spark, sf_dir, "signup", F.avg), _thiessen(spark, sf_dir, wanted), "station", "v")
    return out.select(number.alias("code"), "day", F.col("v").alias("target"))


@query(f"WITH {_LR}, {sweep_sql('lr', 'cell', _FIVE, 'target', 9)} SELECT cell, n_fit, {', '.join(f'round(b{i}, 3) + 0.0 AS b{i}' for i in (1, 2, 3, 4, 5, 0))} FROM fit")
def lr_gauge_fit(spark, sf_dir):
    """Five predictors by pixel; the target is the Thiessen series of the basin that holds most of the pixel."""
    owner = regress.dominant_owner(a.bridge(spark), ["i", "j"])
    rows = a.obs_px(spark, sf_dir, 16).withColumn("tca", (F.col("sm2rain") + F.col("era5")) / 2 + F.col("aws") / 4).join(owner, ["i", "j"]).join(thiessen_series(spark, sf_dir, owner), ["code", "day"])
    return _coefs(regress.ols_multi(rows, ["cell"], _FIVE, "target", 9), ["cell"], 5)


_MEANS = f"""{a.obs_px_sql(16)}, {a.BRIDGE_SQL}, tot AS (SELECT code, sum(km2) AS total, count(*) AS n_cells, 100 * max(km2) / sum(km2) AS share FROM br GROUP BY code), days AS (SELECT DISTINCT day FROM obs), long AS ({" UNION ALL ".join(f"SELECT i, j, day, '{p}' AS product, {p} AS v FROM obs" for p in PRODUCTS)}),
bs AS (SELECT code, day, product, sum(km2 * v) AS num, sum(km2) AS den FROM long JOIN br USING (i, j) WHERE v IS NOT NULL GROUP BY 1, 2, 3),
bd AS (SELECT tot.code, days.day, pr.product, CASE WHEN den >= 0.5 * total THEN num / den END AS v FROM tot CROSS JOIN days CROSS JOIN (SELECT DISTINCT product FROM long) pr LEFT JOIN bs ON bs.code = tot.code AND bs.day = days.day AND bs.product = pr.product)"""


def basin_series(spark, sf_dir, products=PRODUCTS):
    """code, day, product, v: the area-weighted series of every product."""
    obs = a.obs_px(spark, sf_dir, 16)
    out = [basin.area_mean(obs, a.bridge(spark), ["i", "j"], p).select("code", "day", F.lit(p).alias("product"), F.col(p).alias("v")) for p in products]
    all_of = out[0]
    for df in out[1:]:
        all_of = all_of.unionByName(df)
    return all_of


@query(f"WITH {_MEANS} SELECT code, day, product, round(v, 8) AS v FROM bd")
def basin_build(spark, sf_dir):
    return rounded(basin_series(spark, sf_dir), 8)


def _against(series, reference: str):
    ref = series.where(F.col("product") == reference).select("code", "day", F.col("v").alias("ref"))
    return series.where(F.col("product") != reference).join(ref, ["code", "day"])


@query(f"""
WITH {_MEANS}, g AS (SELECT x.code, x.product, {_kge_sql("x.v", "r.v")}, sqrt(avg((x.v - r.v) ** 2)) AS rmse, avg(x.v - r.v) AS bias FROM bd x JOIN bd r ON r.code = x.code AND r.day = x.day AND r.product = 'aws'
  WHERE x.product <> 'aws' AND x.v IS NOT NULL AND r.v IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT code, product, n, round({_KGE}, 4) AS kge, round(r, 4) AS r, round(rmse, 4) AS rmse, round(bias, 4) AS bias FROM g
""")
def basin_product_summary(spark, sf_dir):
    out = metrics.full(_against(basin_series(spark, sf_dir), "aws"), ["code", "product"], "v", "ref", min_n=5).where("n >= 5")
    return rounded(out.select("code", "product", "n", "kge", "r", "rmse", "bias"))


# The products compared by default, and those that a reference network took part in.
COMPARED = ("BC", "BC_G", "BC_LR", "TCA", "GPM", "ERA5", "SM2RAIN")
CIRCULAR = {"AWS": ("BC", "BC_G", "BC_LR", "TCA"), "ASOS": ()}


def compared(reference: str, drop=()) -> list[str]:
    """The products that a reference is compared with: not itself; ASOS too beside AWS."""
    names = [*COMPARED, "ASOS"] if reference == "AWS" else COMPARED
    return [p for p in names if p != reference and p not in drop]


def merged_series(spark, sf_dir):
    """code, day, product, v by the products' published names: the corrected ones are mixtures of the basins' five series."""
    wide = basin_series(spark, sf_dir).groupBy("code", "day").pivot("product", list(PRODUCTS)).agg(F.first("v"))
    s, e, g, w = (F.col(c) for c in ("sm2rain", "era5", "gpm", "aws"))
    made = {"BC": (s + w) / 2, "BC_G": (s + 3 * w) / 4, "BC_LR": (e + w) / 2, "TCA": (s + e + w) / 3, "GPM": g, "ERA5": e, "SM2RAIN": s, "AWS": w, "ASOS": F.col("asos")}
    return wide.select("code", "day", *[v.alias(k) for k, v in made.items()]).unpivot(["code", "day"], list(made), "product", "v")


@query(f"""
WITH {_MEANS}, w AS (SELECT code, day, max(v) FILTER (WHERE product = 'sm2rain') AS s, max(v) FILTER (WHERE product = 'era5') AS e, max(v) FILTER (WHERE product = 'gpm') AS g,
  max(v) FILTER (WHERE product = 'aws') AS w, max(v) FILTER (WHERE product = 'asos') AS a FROM bd GROUP BY 1, 2),
named AS (SELECT code, day, unnest(['BC', 'BC_G', 'BC_LR', 'TCA', 'GPM', 'ERA5', 'SM2RAIN', 'AWS', 'ASOS']) AS product, unnest([(s + w) / 2, (s + 3 * w) / 4, (e + w) / 2, (s + e + w) / 3, g, e, s, w, a]) AS v FROM w),
pairs AS (SELECT r.product AS reference, x.product, x.v AS s, r.v AS o FROM named x JOIN named r ON r.code = x.code AND r.day = x.day WHERE x.v IS NOT NULL AND r.v IS NOT NULL
  AND (r.product = 'AWS' AND x.product <> 'AWS' OR r.product = 'ASOS' AND x.product NOT IN ('ASOS', 'AWS'))),
k AS (SELECT reference, product, {_kge_sql("s", "o")} FROM pairs GROUP BY 1, 2)
SELECT reference, product, n, round({_KGE}, 4) AS kge, reference = 'AWS' AND product IN ('BC', 'BC_G', 'BC_LR', 'TCA') AS circular FROM k
""")
def reference_switch(spark, sf_dir):
    """Every product against each reference, the reference left out of the list; circular scores are marked."""
    series, out = merged_series(spark, sf_dir), None
    for ref, trained in CIRCULAR.items():
        chosen = series.where(F.col("product").isin(*compared(ref), ref))
        scores = metrics.kge(_against(chosen, ref), ["product"], "v", "ref", 1).where("n > 0").select(F.lit(ref).alias("reference"), "product", "n", "kge", (F.col("product").isin(*trained) if trained else F.lit(False)).alias("circular"))
        out = scores if out is None else out.unionByName(scores)
    return rounded(out)


_FACTS = f"{_MEANS}, vd AS (SELECT code, count(v) AS valid_days FROM bd WHERE product = 'gpm' GROUP BY code)"


def _facts(spark, sf_dir):
    return sinks.basin_facts(a.bridge(spark), basin_series(spark, sf_dir, ("gpm",)))


@query(f"WITH {_FACTS} SELECT tot.code, round(total, 3) AS area_km2, n_cells, round(share, 3) AS max_share_pct, coalesce(valid_days, 0) AS valid_days FROM tot LEFT JOIN vd USING (code)")
def basin_info(spark, sf_dir):
    return rounded(_facts(spark, sf_dir), 3)


@query(f"""
WITH {_FACTS}, all_basins AS (SELECT c AS code FROM range(1, 7) x(c)), j AS (SELECT code, n_cells, coalesce(valid_days, 0) AS days FROM all_basins LEFT JOIN tot USING (code) LEFT JOIN vd USING (code))
SELECT code, CASE WHEN n_cells IS NULL THEN 'no cell' ELSE 'no valid day' END AS reason FROM j WHERE n_cells IS NULL OR days < 25
""")
def excluded_basins(spark, sf_dir):
    return sinks.excluded_basins(spark.range(1, 7).withColumnRenamed("id", "code"), _facts(spark, sf_dir), 25)


@query(f"""
WITH {a.LONG_SQL}, {a.BRIDGE_SQL}, f AS (SELECT code, sum(km2) AS area, count(*) AS n_cells FROM br GROUP BY code), g AS (SELECT cell + 1 AS code, {_kge_sql("sim1", "obs")} FROM ser GROUP BY 1)
SELECT g.code, n, round({_KGE}, 4) AS kge, round(area, 3) AS area_km2, n_cells FROM g JOIN f USING (code)
""")
def scores_with_facts(spark, sf_dir):
    """Scores of the basins that both tables name, with the basins' facts."""
    facts = a.bridge(spark).groupBy("code").agg(F.sum("km2").alias("area_km2"), F.count("*").alias("n_cells"))
    scores = metrics.kge(a.long_series(spark, sf_dir).withColumn("code", F.col("cell") + 1), ["code"], "sim1", "obs", 1)
    return rounded(scores.select("code", "n", "kge").join(facts, "code"))


@query(f"""
WITH {a.LONG_SQL}, l AS (SELECT cell, day, 'sim1' AS product, sim1 AS v FROM ser UNION ALL SELECT cell, day, 'sim2', sim2 FROM ser UNION ALL SELECT cell, day, 'obs', obs FROM ser), o(product, place) AS (VALUES ('obs', 0), ('sim2', 1))
SELECT place, product, cell, count(v) AS n, round(avg(v), 4) AS mean FROM l JOIN o USING (product) WHERE cell IN (SELECT DISTINCT user_id % 4 FROM events) GROUP BY 1, 2, 3
""")
def reorder_by_list(spark, sf_dir):
    """Products of a list in its order, for the cells that another table has too."""
    long = a.long_series(spark, sf_dir).unpivot(["cell", "day"], ["sim1", "sim2", "obs"], "product", "v")
    known = a.table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("cell")).distinct()
    rows = sinks.by_list(long.join(known, "cell", "left_semi"), "product", ["obs", "sim2"])
    return rounded(rows.groupBy("place", "product", "cell").agg(F.count("v").alias("n"), F.avg("v").alias("mean")))


@query(f"""
WITH {a.obs_px_sql(16)} SELECT i, j, printf('%.2f_%.2f', 36::DOUBLE + 0.1::DOUBLE * i, 127::DOUBLE + 0.1::DOUBLE * j) AS name, round(36::DOUBLE + 0.1::DOUBLE * i, 4) AS lat, round(127::DOUBLE + 0.1::DOUBLE * j, 4) AS lon, count(aws) AS valid_days FROM obs GROUP BY i, j HAVING count(aws) >= 1
""")
def cell_coordinates(spark, sf_dir):
    return sinks.cell_table(a.obs_px(spark, sf_dir, 16), F.lit(36.0) + F.lit(0.1) * F.col("i"), F.lit(127.0) + F.lit(0.1) * F.col("j"), "aws")


@query(f"WITH {_WEIGHTS} SELECT code, row_number() OVER (PARTITION BY code ORDER BY w DESC, station) AS place, station, CASE WHEN station < 300 THEN 'ASOS' ELSE 'AWS' END AS network, round(w, 6) AS w FROM tw")
def thiessen_weights_export(spark, sf_dir):
    return rounded(sinks.ordered_weights(_thiessen(spark, sf_dir)), 6)


@query(f"""
WITH {a.obs_px_sql(16)}, d AS (SELECT day, count(aws) AS valid, count(*) AS n FROM obs GROUP BY day)
SELECT (SELECT count(*) FROM d WHERE valid = 0) AS days_without, (SELECT round(100.0 * max(valid) / max(n), 4) FROM d) AS most_valid_pct,
  round(avg(asos) FILTER (WHERE aws IS NOT NULL), 4) AS mean_valid, round(avg(asos) FILTER (WHERE aws IS NULL), 4) AS mean_missing, count(aws) AS n_valid, count(*) - count(aws) AS n_missing FROM obs
""")
def export_diagnostics(spark, sf_dir):
    """The figures of an export's description: empty days, the best day's share, the reference's mean where cells are missing."""
    obs = a.obs_px(spark, sf_dir, 16)
    days = obs.groupBy("day").agg(F.count("aws").alias("valid"), F.count("*").alias("n"))
    days = days.agg(F.count_if(F.col("valid") == 0).alias("days_without"), (F.lit(100.0) * F.max("valid") / F.max("n")).alias("most_valid_pct"))
    there = F.col("aws").isNotNull()
    means = obs.agg(F.avg(F.when(there, F.col("asos"))).alias("mean_valid"), F.avg(F.when(~there, F.col("asos"))).alias("mean_missing"), F.count("aws").alias("n_valid"), F.count_if(~there).alias("n_missing"))
    return rounded(days.crossJoin(means))  # one row each


_STRICT = """ax AS (SELECT t, s, CASE WHEN s = lo THEN 1 - f ELSE f END AS w FROM (SELECT t, CAST(greatest(least(ceil(t / 2.0) - 1, 2), 0) AS BIGINT) AS lo, t / 2.0 - greatest(least(ceil(t / 2.0) - 1, 2), 0) AS f FROM range(0, 7) x(t)) q, LATERAL (SELECT unnest([lo, lo + 1]) AS s) u)"""


def _strict(spark):
    """Axes that reach a step beyond the source's ends."""
    rows = regrid.axis_weights(a.axis(spark, 4, 0.0, 2.0, "i", "lat"), a.axis(spark, 9, -1.0, 1.0, "ti", "tlat"), "i", "lat", "ti", "tlat", beyond=False)
    cols = regrid.axis_weights(a.axis(spark, 4, 0.0, 2.0, "j", "lon"), a.axis(spark, 9, -1.0, 1.0, "tj", "tlon"), "j", "lon", "tj", "tlon", beyond=False)
    return rows, cols


@query(f"""
WITH {a.obs_px_sql(16)}, {_STRICT}, s AS (SELECT y.t + 1 AS ti, x.t + 1 AS tj, o.day, sum(y.w * x.w * o.gpm) AS num, count(o.gpm) AS got, count(*) AS n FROM obs o JOIN ax y ON o.i = y.s JOIN ax x ON o.j = x.s GROUP BY 1, 2, 3)
SELECT ti, tj, day, round(CASE WHEN got = n AND n = 4 THEN num END, 6) AS gpm FROM s
""")
def regrid_strict_hull(spark, sf_dir):
    """No value beyond the source's hull or next to a missing corner."""
    return rounded(regrid.regrid(a.obs_px(spark, sf_dir, 16), *_strict(spark), "gpm", min_cover=None), 6)


@query(f"""
WITH {a.obs_px_sql(16)}, {_STRICT}, s AS (SELECT y.t + 1 AS ti, x.t + 1 AS tj, o.day, sum(y.w * x.w * (o.gpm - 40)) AS num, coalesce(sum(CASE WHEN gpm IS NOT NULL THEN y.w * x.w END), 0) AS den FROM obs o JOIN ax y ON o.i = y.s JOIN ax x ON o.j = x.s GROUP BY 1, 2, 3),
ref AS (SELECT DISTINCT i, j FROM obs WHERE aws > 60)
SELECT ti, tj, day, round(greatest(CASE WHEN den > 0.5 + 1e-9 THEN num / den END, CASE WHEN den > 0.5 + 1e-9 THEN 0 END), 6) + 0.0 AS gpm FROM s WHERE (CAST(floor(ti / 2) AS BIGINT), CAST(floor(tj / 2) AS BIGINT)) IN (SELECT (i, j) FROM ref)
""")
def regrid_masked(spark, sf_dir):
    """Regridded, cut to the cells where the reference product is ever wet, negatives to 0."""
    obs = a.obs_px(spark, sf_dir, 16)
    ref = obs.where("aws > 60").select(F.col("i").alias("ri"), F.col("j").alias("rj")).distinct()
    fine = spark.range(81).select(F.floor(F.col("id") / 9).alias("ti"), (F.col("id") % 9).alias("tj"))
    mask = fine.join(ref, (F.floor(F.col("ti") / 2) == F.col("ri")) & (F.floor(F.col("tj") / 2) == F.col("rj")), "left_semi")
    done = regrid.regrid(obs.withColumn("gpm", F.col("gpm") - 40), *_strict(spark), "gpm", min_cover=0.5 + 1e-9)
    return rounded(regrid.masked(done, mask, "gpm", ("ti", "tj")), 6)


_POINTS = "pt AS (SELECT user_id AS p, 126.95::DOUBLE + (user_id * 37 % 97) * 0.005::DOUBLE AS lon, 35.95::DOUBLE + (user_id * 53 % 89) * 0.005::DOUBLE AS lat FROM (SELECT DISTINCT user_id FROM events))"


def _points(spark, sf_dir):
    """A point for each user of the events, which grow with the scale."""
    u = F.col("user_id")
    users = a.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(u.alias("p"), (F.lit(126.95) + u * 37 % 97 * F.lit(0.005)).alias("lon"), (F.lit(35.95) + u * 53 % 89 * F.lit(0.005)).alias("lat"))


@query(f"""
WITH {_POINTS}, {a.SIDES_SQL}, d AS (SELECT p, code, lon - x1 AS ax, lat - y1 AS ay, x2 - x1 AS dx, y2 - y1 AS dy FROM pt, side), c AS (SELECT *, greatest(least((ax * dx + ay * dy) / (dx * dx + dy * dy), 1), 0) AS t FROM d),
close AS (SELECT DISTINCT p, code FROM c WHERE pow(ax - t * dx, 2) + pow(ay - t * dy, 2) <= 0.0507 * 0.0507),
odd AS (SELECT p, code, ring, is_hole, count(*) % 2 AS odd FROM pt s, side d WHERE (d.y1 > s.lat) <> (d.y2 > s.lat) AND s.lon < (d.x2 - d.x1) * (s.lat - d.y1) / (d.y2 - d.y1) + d.x1 GROUP BY 1, 2, 3, 4),
ins AS (SELECT p, code FROM odd GROUP BY 1, 2 HAVING max(CASE WHEN NOT is_hole THEN odd END) = 1 AND coalesce(max(CASE WHEN is_hole THEN odd END), 0) = 0)
SELECT p, code FROM close UNION SELECT p, code FROM ins
""")
def buffered_mask(spark, sf_dir):
    return geo.near_polygon(_points(spark, sf_dir), geo.edges(a.polygons(spark, sf_dir)), "p", buffer=0.0507)


@query(f"""
WITH {_POINTS}, {a.STATIONS_SQL}, k AS (SELECT p, station, row_number() OVER (PARTITION BY p ORDER BY (pt.lon - stn.lon) * (pt.lon - stn.lon) + (pt.lat - stn.lat) * (pt.lat - stn.lat), station) AS k FROM pt, stn) SELECT p, station FROM k WHERE k = 1
""")
def nearest_station_of_points(spark, sf_dir):
    return geo.nearest(_points(spark, sf_dir), a.stations(spark, sf_dir), ["p"], "lon", "lat", "station", "lon", "lat").select("p", "station")


@query(f"""
WITH {a.SIDES_SQL}, {CELLS_SQL}, pr AS (SELECT code, ring, is_hole, i, j, lat, x1, y1, x2, y2, lat - 0.025 AS lo, lat + 0.025 AS hi, greatest(least(x1, x2), lon - 0.025) AS a, least(greatest(x1, x2), lon + 0.025) AS b FROM side JOIN cl ON x1 <> x2 AND greatest(x1, x2) > lon - 0.025 AND least(x1, x2) < lon + 0.025),
y AS (SELECT *, y1 + (y2 - y1) * (a - x1) / (x2 - x1) AS ya, y1 + (y2 - y1) * (b - x1) / (x2 - x1) AS yb FROM pr WHERE b > a),
h AS (SELECT *, least(greatest(ya - lo, 0), 0.05) AS ha, least(greatest(yb - lo, 0), 0.05) AS hb FROM y),
g AS (SELECT *, ha * ha / 2 + greatest(ya - hi, 0) * 0.05 AS ga, hb * hb / 2 + greatest(yb - hi, 0) * 0.05 AS gb FROM h),
r AS (SELECT code, ring, is_hole, i, j, lat, abs(sum((b - a) * CASE WHEN abs(yb - ya) < 1e-12 THEN ha ELSE (gb - ga) / (yb - ya) END * CASE WHEN x2 > x1 THEN 1 ELSE -1 END)) AS deg2 FROM g GROUP BY ALL),
s AS (SELECT code, i, j, sum(CASE WHEN is_hole THEN -deg2 ELSE deg2 END) * 111.32 * 111.32 * cos(radians(lat)) AS km2 FROM r GROUP BY code, i, j, lat)
SELECT code, i, j, round(km2, 5) AS km2 FROM s WHERE km2 > 1e-6
""")
def basin_cell_overlap(spark, sf_dir):
    return rounded(geo.overlap_areas(a.polygons(spark, sf_dir), grid_cells(spark), 0.05), 5)


_BEST = f"""{a.obs_px_sql(16)}, {THETA_SQL}, {_GRID_SQL}, rr AS (SELECT cell, day, rain, greatest(least(theta, 1 - 1e-6), 1e-6) AS t FROM th WHERE theta IS NOT NULL AND rain IS NOT NULL),
dd AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY cell ORDER BY day), 0) AS d FROM rr), tr AS (SELECT cell, a, b, z, avg((greatest(z * d + a * pow(t, b), 0) - rain) ** 2) AS mse FROM dd, gr GROUP BY 1, 2, 3, 4 HAVING count(*) >= {MIN_N}),
pm AS (SELECT cell, a, b, z FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(mse, 6), a, b, z) AS k FROM tr) WHERE k = 1)"""


def _calibrated(spark, sf_dir):
    grid = spark.createDataFrame(_GRID, "a double, b double, z double")
    return sm2rain.grid_calibrate(theta(spark, sf_dir), ["cell"], "theta", "rain", grid, min_n=MIN_N).select("cell", "a", "b", "z")


@query(f"WITH {_BEST} SELECT 'a' AS param, min(a) AS low, round(avg(a), 4) AS mean, max(a) AS high FROM pm UNION ALL SELECT 'b', min(b), round(avg(b), 4), max(b) FROM pm UNION ALL SELECT 'z', min(z), round(avg(z), 4), max(z) FROM pm")
def parameter_summary(spark, sf_dir):
    return rounded(sm2rain.parameter_summary(_calibrated(spark, sf_dir)))


@query(f"""
WITH {_BEST}, tt AS (SELECT cell, day, CASE WHEN theta IS NOT NULL THEN greatest(least(theta, 1 - 1e-6), 1e-6) END AS t FROM th),
dt AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN CASE WHEN t IS NOT NULL THEN 0 END ELSE t - lag(t) OVER w END AS d, count(t) OVER (PARTITION BY cell) AS n FROM tt WINDOW w AS (PARTITION BY cell ORDER BY day))
SELECT dt.cell, day, round(CASE WHEN n >= {MIN_N} AND d IS NOT NULL AND t IS NOT NULL THEN greatest(z * d + a * pow(t, b), 0) END, 4) + 0.0 AS rain FROM dt JOIN pm USING (cell)
""")
def calibrated_rain(spark, sf_dir):
    """Every pixel's rain by its own calibrated parameters."""
    moist = theta(spark, sf_dir).drop("rain").join(_calibrated(spark, sf_dir), "cell")
    return rounded(sm2rain.forward(moist, ["cell"], "theta", F.col("a"), F.col("b"), F.col("z"), min_n=MIN_N).select("cell", "day", "rain"))


@query(f"WITH {a.obs_px_sql(16)} SELECT 3 - i AS i, j, day, round(gpm, 8) AS gpm FROM obs")
def flip_applied(spark, sf_dir):
    return rounded(regrid.flipped(a.obs_px(spark, sf_dir, 16), "lat", 4, 4).select("i", "j", "day", "gpm"), 8)


@query(f"""
WITH {a.obs_px_sql(16)}, com AS (SELECT cell, day FROM obs WHERE gpm IS NOT NULL AND aws IS NOT NULL AND era5 IS NOT NULL)
SELECT cell, count(*) AS n, round(count(*) / 365.25, 6) AS n_years FROM com GROUP BY cell
""")
def common_valid_years(spark, sf_dir):
    """Days on which every product is valid, as years of record, by pixel."""
    rows = a.obs_px(spark, sf_dir, 16).dropna(subset=["gpm", "aws", "era5"])
    return rounded(rows.groupBy("cell").agg(F.count("*").alias("n"), (F.count("*") / F.lit(365.25)).alias("n_years")), 6)


@query(f"""
WITH {a.obs_px_sql(16)}, seen AS (SELECT DISTINCT cell FROM obs WHERE sm2rain > 20) SELECT obs.cell, count(*) AS n, count(*) FILTER (WHERE seen.cell IS NULL) AS outside FROM obs LEFT JOIN seen ON seen.cell = obs.cell GROUP BY obs.cell
""")
def fixed_mask_fill(spark, sf_dir):
    """Cells outside the product's fixed mask stay missing in the spatial fill."""
    obs = a.obs_px(spark, sf_dir, 16).select("cell", "day", F.col("i").cast("double").alias("y"), F.col("j").cast("double").alias("x"), F.when(F.col("sm2rain") > 20, F.col("sm2rain")).alias("v"))
    done = gapfill.spatial_fill(obs, ["day"], "v", "x", "y", 1, cell="cell")
    held = obs.where("v is not null").select("cell").distinct().withColumn("in_mask", F.lit(True))
    days = done.join(held, "cell", "left")
    return days.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.col("in_mask").isNull() & F.col("filled").isNull()).alias("outside"))


@query(f"WITH {a.obs_px_sql(16)}, u AS (SELECT DISTINCT i, j FROM obs WHERE gpm > 60), v AS (SELECT DISTINCT i, j FROM obs WHERE aws > 60) SELECT coalesce(u.i, v.i) AS i, coalesce(u.j, v.j) AS j FROM u FULL JOIN v ON u.i = v.i AND u.j = v.j WHERE u.i IS NULL OR v.i IS NULL")
def grid_difference(spark, sf_dir):
    obs = a.obs_px(spark, sf_dir, 16)
    return align.same_grid(obs.where("gpm > 60"), obs.where("aws > 60"), ["i", "j"])


_APART = 3


@query(f"""
WITH RECURSIVE {a.LONG_SQL}, rk AS (SELECT cell, day, obs, CAST(day - DATE '1970-01-01' AS INTEGER) AS d, row_number() OVER (PARTITION BY cell ORDER BY obs DESC, day) AS k FROM ser WHERE obs > 0),
walk AS (SELECT DISTINCT cell, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS taken FROM rk
  UNION ALL SELECT w.cell, w.k + 1, CASE WHEN list_has_any(w.taken, range(rk.d - {_APART - 1}, rk.d + {_APART})::INTEGER[]) THEN w.taken ELSE list_append(w.taken, rk.d) END FROM walk w JOIN rk ON rk.cell = w.cell AND rk.k = w.k + 1),
fin AS (SELECT cell, unnest(arg_max(taken, k)) AS d FROM walk GROUP BY cell)
SELECT rk.cell, rk.day, round(rk.obs, 6) AS obs FROM rk JOIN fin ON fin.cell = rk.cell AND fin.d = rk.d
""")
def decluster(spark, sf_dir):
    from ..operators import events

    return rounded(events.decluster(a.long_series(spark, sf_dir), ["cell"], "obs", apart=_APART), 6)


@query(f"WITH {_INSIDE}, {_POINTS} SELECT pt.p, count(*) AS n_basins FROM pt JOIN (SELECT p, code FROM (SELECT p, code, ring, is_hole, count(*) % 2 AS odd FROM pt s, side d WHERE (d.y1 > s.lat) <> (d.y2 > s.lat) AND s.lon < (d.x2 - d.x1) * (s.lat - d.y1) / (d.y2 - d.y1) + d.x1 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2 HAVING max(CASE WHEN NOT is_hole THEN odd END) = 1 AND coalesce(max(CASE WHEN is_hole THEN odd END), 0) = 0) q ON q.p = pt.p GROUP BY pt.p")
def points_in_basins(spark, sf_dir):
    return geo.in_polygon(_points(spark, sf_dir), geo.edges(a.polygons(spark, sf_dir)), "p").groupBy("p").agg(F.count("*").alias("n_basins"))
