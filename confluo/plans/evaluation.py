"""Scores by cell, split, season and intensity; summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import basin, metrics
from ..sources import adapters as a
from .preprocess import rounded
from .registry import query


def _kge_sql(s: str, o: str) -> str:
    """Aggregates n, r, al and be over rows that hold both."""
    return f"count(*) AS n, covar_pop({s}, {o}) / nullif(stddev_pop({s}) * stddev_pop({o}), 0) AS r, stddev_pop({s}) / nullif(stddev_pop({o}), 0) AS al, avg({s}) / nullif(avg({o}), 0) AS be"


_KGE = "1 - sqrt(pow(r - 1, 2) + pow(al - 1, 2) + pow(be - 1, 2))"


@query(f"""
WITH {a.LONG_SQL}, p AS (SELECT cell, sim1 AS s, obs AS o, sim1 - obs AS d FROM ser WHERE sim1 IS NOT NULL AND obs IS NOT NULL),
g AS (SELECT cell, {_kge_sql("s", "o")}, avg(d) AS bias, sqrt(avg(d * d)) AS rmse, stddev_pop(d) AS ub, sum(d * d) AS se, var_pop(o) AS vo, avg(s) AS ms, avg(o) AS mo, sum(s) AS ss, sum(o) AS so,
  count(*) FILTER (WHERE s >= 30 AND o >= 30) AS h, count(*) FILTER (WHERE s < 30 AND o >= 30) AS m, count(*) FILTER (WHERE s >= 30 AND o < 30) AS f FROM p GROUP BY cell)
SELECT cell, n, round(r, 4) AS r, round(bias, 4) AS bias, round(100 * bias / mo, 4) AS rbias, round(rmse, 4) AS rmse, round(ub, 4) AS ubrmse, round(al, 4) AS alpha, round(be, 4) AS beta, round({_KGE}, 4) AS kge,
  round(1 - se / nullif(vo * n, 0), 4) AS nse, round(h / nullif(h + m, 0), 4) AS pod, round(f / nullif(h + f, 0), 4) AS far, round(h / nullif(h + m + f, 0), 4) AS csi,
  round(ms, 4) AS mean_sim, round(mo, 4) AS mean_obs, round(ss, 2) AS sum_sim, round(so, 2) AS sum_obs FROM g
""")
def metrics_full(spark, sf_dir):
    out = metrics.full(a.long_series(spark, sf_dir), ["cell"], "sim1", "obs", wet=30.0)
    return rounded(out.drop("sum_sim", "sum_obs")).join(out.select("cell", F.round("sum_sim", 2).alias("sum_sim"), F.round("sum_obs", 2).alias("sum_obs")), "cell")


@query(f"""
WITH {a.obs_px_sql(16)}, g AS (SELECT cell, {_kge_sql("gpm", "aws")} FROM obs WHERE gpm IS NOT NULL AND aws IS NOT NULL GROUP BY cell)
SELECT cell, n, round(CASE WHEN n >= 5 THEN r END, 4) AS r, round(CASE WHEN n >= 5 THEN {_KGE} END, 4) AS kge FROM g
""")
def kge_by_cell(spark, sf_dir):
    return rounded(metrics.kge(a.obs_px(spark, sf_dir, 16), ["cell"], "gpm", "aws", 5).where("n > 0").select("cell", "n", "r", "kge"))


@query(f"""
WITH {a.LONG_SQL}, g AS (SELECT {_kge_sql("sim1", "obs")}, avg(sim1 - obs) AS bias, sqrt(avg((sim1 - obs) ** 2)) AS rmse FROM ser)
SELECT n, round(r, 4) AS r, round({_KGE}, 4) AS kge, round(bias, 4) AS bias, round(rmse, 4) AS rmse FROM g
""")
def pooled(spark, sf_dir):
    return rounded(metrics.full(a.long_series(spark, sf_dir), [], "sim1", "obs").select("n", "r", "kge", "bias", "rmse"))


@query(f"""
WITH {a.LONG_SQL}, th(threshold) AS (VALUES (30.0::DOUBLE), (50.0::DOUBLE), (80.0::DOUBLE)), c AS (SELECT threshold, count(*) FILTER (WHERE sim1 >= threshold AND obs >= threshold) AS hits,
  count(*) FILTER (WHERE sim1 < threshold AND obs >= threshold) AS misses, count(*) FILTER (WHERE sim1 >= threshold AND obs < threshold) AS false_alarms FROM ser, th GROUP BY 1)
SELECT *, round(hits / nullif(hits + misses, 0), 4) AS pod, round(false_alarms / nullif(hits + false_alarms, 0), 4) AS far, round(hits / nullif(hits + misses + false_alarms, 0), 4) AS csi FROM c
""")
def contingency_thresholds(spark, sf_dir):
    return rounded(metrics.detection(a.long_series(spark, sf_dir), [], "sim1", "obs", [30.0, 50.0, 80.0]))


_SPLIT = "CASE WHEN year(day) <= 1996 THEN 'fit' WHEN year(day) = 1997 THEN 'val' ELSE 'test' END"


@query(f"""
WITH {a.LONG_SQL}, u AS (SELECT {_SPLIT} AS split, 'sim1' AS method, sim1 AS s, obs AS o FROM ser UNION ALL SELECT {_SPLIT}, 'sim2', sim2, obs FROM ser)
SELECT split, 'obs' AS reference, method, count(*) AS n, round(covar_pop(s, o) / nullif(stddev_pop(s) * stddev_pop(o), 0), 4) AS r, round(sqrt(avg((s - o) ** 2)), 4) AS rmse,
  round(stddev_pop(s - o), 4) AS ubrmse, round(avg(s - o), 4) AS bias FROM u GROUP BY 1, 3
""")
def skill_by_split(spark, sf_dir):
    y = F.year("day")
    rows = a.long_series(spark, sf_dir).withColumn("split", F.when(y <= 1996, "fit").when(y == 1997, "val").otherwise("test"))
    return rounded(metrics.skill(rows, ["split"], ["sim1", "sim2"], ["obs"]))


@query(f"""
WITH {a.LONG_SQL}, g AS (SELECT cell, {_kge_sql("sim1", "obs")} FROM ser GROUP BY cell), k AS (SELECT (cell + 1) * 10 % 60 + 13 AS code, {_KGE} AS kge FROM g)
SELECT CASE CAST(floor(code / 10) AS INTEGER) WHEN 1 THEN 'Han' WHEN 2 THEN 'Nakdong' WHEN 3 THEN 'Geum' WHEN 4 THEN 'Seomjin' WHEN 5 THEN 'Yeongsan' WHEN 6 THEN 'Jeju' END AS region,
  round(median(kge), 4) AS kge, count(*) AS n FROM k GROUP BY 1
""")
def group_median_report(spark, sf_dir):
    scores = metrics.kge(a.long_series(spark, sf_dir), ["cell"], "sim1", "obs", 1)
    named = scores.select(scalars.region((F.col("cell") + 1) * 10 % 60 + 13).alias("region"), "kge")
    return rounded(named.groupBy("region").agg(F.median("kge").alias("kge"), F.count("*").alias("n")))


_SEASON = "list_extract(['DJF', 'MAM', 'JJA', 'SON'], CAST(floor(month(day) % 12 / 3) AS INTEGER) + 1)"


@query(f"""
WITH {a.LONG_SQL}, b AS (SELECT {_SEASON} AS season, CAST(year(day) AS INTEGER) AS year, sim1, obs FROM ser), g AS (SELECT season, year, {_kge_sql("sim1", "obs")} FROM b GROUP BY GROUPING SETS ((season), (year), ()))
SELECT season, year, n, round(r, 4) AS r, round({_KGE}, 4) AS kge FROM g
""")
def by_season_year_grouping_sets(spark, sf_dir):
    rows = a.long_series(spark, sf_dir).select(scalars.month_bin(F.col("day")).alias("season"), F.year("day").alias("year"), "sim1", "obs")
    sets = rows.groupingSets([["season"], ["year"], []], "season", "year")
    out = sets.agg(*[v.alias(k) for k, v in metrics.kge_parts("sim1", "obs").items()]).withColumn("kge", metrics.kge_of())
    return rounded(out.select("season", "year", "n", "r", "kge"))


@query(f"""
WITH {a.LONG_SQL}, e AS (SELECT CASE WHEN obs >= 0 AND obs < 1 THEN 0 WHEN obs >= 1 AND obs < 5 THEN 1 WHEN obs >= 5 AND obs < 10 THEN 2 WHEN obs >= 10 AND obs < 20 THEN 3
  WHEN obs >= 20 AND obs < 50 THEN 4 WHEN obs >= 50 AND obs < 80 THEN 5 WHEN obs >= 80 THEN 6 END AS bin, sim1, obs FROM ser)
SELECT bin, count(*) AS n, round(avg(sim1), 4) AS mean_sim, round(avg(obs), 4) AS mean_obs, round(100 * (avg(sim1) - avg(obs)) / nullif(avg(obs), 0), 4) AS rel_bias FROM e WHERE bin IS NOT NULL GROUP BY 1 HAVING count(*) >= 5
""")
def intensity_bins_left(spark, sf_dir):
    rows = a.long_series(spark, sf_dir).withColumn("bin", scalars.bin_left(F.col("obs"), scalars.INTENSITY)).where("bin is not null")
    out = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("sim1").alias("mean_sim"), F.avg("obs").alias("mean_obs")).where("n >= 5")
    return rounded(out.withColumn("rel_bias", 100 * scalars.ratio(F.col("mean_sim") - F.col("mean_obs"), F.col("mean_obs"))))


@query(f"""
WITH {a.LONG_SQL}, e AS (SELECT CASE WHEN obs > -0.01 AND obs <= 0.5 THEN 0 WHEN obs > 0.5 AND obs <= 2 THEN 1 WHEN obs > 2 AND obs <= 5 THEN 2 WHEN obs > 5 AND obs <= 10 THEN 3
  WHEN obs > 10 AND obs <= 20 THEN 4 WHEN obs > 20 AND obs <= 1000 THEN 5 END AS band, sim1, sim2, obs FROM ser)
SELECT band, count(*) AS n, round(sum(sim1) / nullif(sum(obs), 0), 4) AS ratio1, round(sum(sim2) / nullif(sum(obs), 0), 4) AS ratio2 FROM e WHERE band IS NOT NULL GROUP BY 1
""")
def intensity_bins_right(spark, sf_dir):
    rows = a.long_series(spark, sf_dir).withColumn("band", scalars.bin_right(F.col("obs"), scalars.BANDS)).where("band is not null")
    r = lambda s: scalars.ratio(F.sum(s), F.sum("obs"))
    return rounded(rows.groupBy("band").agg(F.count("*").alias("n"), r("sim1").alias("ratio1"), r("sim2").alias("ratio2")))


@query(f"""
WITH {a.obs_px_sql(16)}
SELECT cell, round(100.0 * count(gpm) FILTER (WHERE aws >= 60) / nullif(count(*) FILTER (WHERE aws >= 60), 0), 4) AS cover_wet,
  round(100.0 * count(gpm) FILTER (WHERE aws < 60) / nullif(count(*) FILTER (WHERE aws < 60), 0), 4) AS cover_dry,
  round(avg(aws) FILTER (WHERE gpm IS NOT NULL), 4) AS obs_present, round(avg(aws) FILTER (WHERE gpm IS NULL), 4) AS obs_absent, round(avg(aws) * 365.25, 2) AS annual FROM obs GROUP BY cell
""")
def missing_bias_diagnostics(spark, sf_dir):
    wet, got = F.col("aws") >= 60, F.col("gpm").isNotNull()
    share = lambda c: 100.0 * F.count_if(c & got) / F.nullif(F.count_if(c), F.lit(0))
    return a.obs_px(spark, sf_dir, 16).groupBy("cell").agg(
        F.round(share(wet), 4).alias("cover_wet"), F.round(share(~wet), 4).alias("cover_dry"),
        F.round(F.avg(F.when(got, F.col("aws"))), 4).alias("obs_present"), F.round(F.avg(F.when(~got, F.col("aws"))), 4).alias("obs_absent"), F.round(F.avg("aws") * 365.25, 2).alias("annual"),
    )


@query(f"WITH {a.LONG_SQL}, y AS (SELECT cell, CAST(year(day) AS INTEGER) AS year, sum(obs) AS o, sum(sim1) AS s FROM ser GROUP BY 1, 2) SELECT year, round(avg(o), 3) AS obs, round(avg(s), 3) AS sim1, count(*) AS n FROM y GROUP BY 1")
def annual_totals(spark, sf_dir):
    year = a.long_series(spark, sf_dir).groupBy("cell", F.year("day").alias("year")).agg(F.sum("obs").alias("o"), F.sum("sim1").alias("s"))
    return rounded(year.groupBy("year").agg(F.avg("o").alias("obs"), F.avg("s").alias("sim1"), F.count("*").alias("n")), 3)


@query(f"WITH {a.LONG_SQL} SELECT cell, CAST(date_trunc('month', day) AS DATE) AS month, round(avg(obs), 6) AS obs, round(avg(sim1), 6) AS sim1 FROM ser GROUP BY 1, 2")
def monthly_resample(spark, sf_dir):
    return rounded(a.long_series(spark, sf_dir).groupBy("cell", F.trunc("day", "MM").alias("month")).agg(F.avg("obs").alias("obs"), F.avg("sim1").alias("sim1")), 6)


@query(f"WITH {a.obs_px_sql(16)} SELECT day, round(sum((cell + 1) * gpm) / sum(cell + 1), 4) AS gpm, round(sum((cell + 1) * aws) / sum(cell + 1), 4) AS aws FROM obs WHERE gpm IS NOT NULL AND aws IS NOT NULL GROUP BY day")
def national_mean_weighted(spark, sf_dir):
    rows = a.obs_px(spark, sf_dir, 16).withColumn("area", F.col("cell") + 1)
    return rounded(basin.weighted_mean_of_all(rows, "area", ["gpm", "aws"], ["day"]))


@query(f"WITH {a.obs_px_sql(16)} SELECT day, round(avg(gpm), 4) AS gpm, round(avg(aws), 4) AS aws FROM obs GROUP BY day")
def national_mean_plain(spark, sf_dir):
    return rounded(a.obs_px(spark, sf_dir, 16).groupBy("day").agg(F.avg("gpm").alias("gpm"), F.avg("aws").alias("aws")))


@query(f"WITH {a.LONG_SQL} SELECT cell, day, round(sum(obs) OVER (PARTITION BY cell ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS total FROM ser")
def cumulative(spark, sf_dir):
    return rounded(a.long_series(spark, sf_dir).select("cell", "day", basin.running_sum(["cell"], "obs").alias("total")), 4)


@query(f"""
WITH {a.LONG_SQL}, g AS (SELECT cell, {_kge_sql("sim1", "obs")} FROM ser GROUP BY cell), k AS (SELECT cell, round({_KGE}, 4) AS kge FROM g)
SELECT cell, kge, round(cume_dist() OVER (ORDER BY kge), 4) AS share FROM k
""")
def ecdf_kge(spark, sf_dir):
    scores = metrics.kge(a.long_series(spark, sf_dir), ["cell"], "sim1", "obs", 1).select("cell", F.round("kge", 4).alias("kge"))
    # One row a cell: the distribution is over cells, not over days.
    return scores.select("cell", "kge", F.round(F.cume_dist().over(Window.orderBy("kge")), 4).alias("share"))


@query(f"WITH {a.LONG_SQL} SELECT CAST(floor(obs / 5) AS BIGINT) AS bx, CAST(floor(sim1 / 5) AS BIGINT) AS by_, count(*) AS n FROM ser GROUP BY 1, 2")
def hist2d(spark, sf_dir):
    return a.long_series(spark, sf_dir).groupBy(F.floor(F.col("obs") / 5).alias("bx"), F.floor(F.col("sim1") / 5).alias("by_")).agg(F.count("*").alias("n"))


@query(f"""
WITH {a.obs_px_sql(16)} SELECT CAST(month(day) AS INTEGER) AS month, round(100.0 * count(gpm) / count(*), 4) AS gpm, round(100.0 * count(aws) / count(*), 4) AS aws FROM obs GROUP BY 1
""")
def availability_by_month(spark, sf_dir):
    share = lambda c: (100.0 * F.count(c) / F.count("*")).alias(c)
    return rounded(a.obs_px(spark, sf_dir, 16).groupBy(F.month("day").alias("month")).agg(share("gpm"), share("aws")))


@query(f"""
WITH {a.LONG_SQL}, u AS (SELECT cell, 'sim1' AS product, sim1 AS s, obs AS o FROM ser UNION ALL SELECT cell, 'sim2', sim2, obs FROM ser), g AS (SELECT cell, product, {_kge_sql("s", "o")} FROM u GROUP BY 1, 2), k AS (SELECT product, {_KGE} AS kge FROM g)
SELECT product, round(median(kge), 4) AS median, round(avg(kge), 4) AS mean, round(quantile_cont(kge, 0.25), 4) AS q25, round(quantile_cont(kge, 0.75), 4) AS q75 FROM k GROUP BY 1
""")
def product_distribution(spark, sf_dir):
    ser = a.long_series(spark, sf_dir)
    rows = ser.select("cell", "obs", F.explode(F.create_map(F.lit("sim1"), "sim1", F.lit("sim2"), "sim2")).alias("product", "s"))
    k = metrics.kge(rows, ["cell", "product"], "s", "obs", 1)
    return rounded(k.groupBy("product").agg(F.median("kge").alias("median"), F.avg("kge").alias("mean"), F.percentile("kge", F.lit(0.25)).alias("q25"), F.percentile("kge", F.lit(0.75)).alias("q75")))
