"""Peaks, event periods, annual maxima and return levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import percent_change
from ..operators import basin, events, freq, metrics
from ..sources import adapters as a
from .preprocess import rounded
from .registry import query

_DAILY = "dy AS (SELECT user_id % 4 AS cell, CAST(ts AS DATE) AS day, sum(value) FILTER (WHERE event_type = 'view') AS v, sum(value) FILTER (WHERE event_type = 'click') AS w FROM events GROUP BY 1, 2)"
#: A wet day of the fixture; its daily sums grow with the scale.
_WET = "wet AS (SELECT avg(v) AS wet FROM dy)"
_SPAN = f"""{_DAILY}, {_WET}, fl AS (SELECT *, coalesce(v < wet, TRUE) AS dry FROM dy, wet), rn AS (SELECT *, sum(CASE WHEN dry THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY day) AS run FROM fl),
pk AS (SELECT cell, arg_max(day, (v, -(day - DATE '1970-01-01'))) AS peak FROM dy WHERE v IS NOT NULL GROUP BY cell),
att AS (SELECT rn.cell, peak, run AS prun, dry AS pdry FROM rn JOIN pk ON rn.cell = pk.cell AND rn.day = pk.peak),
sp AS (SELECT att.cell, coalesce(min(day), peak) AS first, peak, coalesce(max(day), peak) AS last FROM att LEFT JOIN rn ON rn.cell = att.cell AND NOT att.pdry AND NOT rn.dry AND rn.run = att.prun GROUP BY att.cell, peak)"""


def _daily(spark, sf_dir):
    total = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("value")))
    return a.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("cell"), F.to_date("ts").alias("day")).agg(total("view").alias("v"), total("click").alias("w"))


def _spans(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    wet = F.broadcast(daily.agg(F.avg("v").alias("wet")))  # one row
    return events.event_span(daily.join(wet, F.lit(True)), ["cell"], "v", wet=F.col("wet"))


@query(f"WITH {_SPAN} SELECT cell, first, peak, last FROM sp")
def event_span(spark, sf_dir):
    return _spans(spark, sf_dir)


_PERIODS = f"""{_SPAN}, pr AS (SELECT cell, 'before' AS period, first, CAST(peak - 1 AS DATE) AS last FROM sp UNION ALL SELECT cell, 'at', peak, peak FROM sp
  UNION ALL SELECT cell, 'after', CAST(peak + 1 AS DATE), last FROM sp UNION ALL SELECT cell, 'whole', first, last FROM sp)"""


@query(f"""
WITH {_PERIODS} SELECT pr.cell, period, round(sum(v), 3) AS v, count(v) AS v_n, round(sum(v) FILTER (WHERE w IS NOT NULL), 3) AS v_c, round(sum(w), 3) AS w, count(w) AS w_n,
  round(sum(w) FILTER (WHERE v IS NOT NULL), 3) AS w_c, round(CASE WHEN sum(v) >= 5 THEN 100 * (sum(w) - sum(v)) / sum(v) END, 3) + 0.0 AS pct
FROM pr JOIN dy ON dy.cell = pr.cell AND dy.day BETWEEN pr.first AND pr.last GROUP BY 1, 2
""")
def event_period_sums(spark, sf_dir):
    periods = events.event_periods(_spans(spark, sf_dir), ["cell"])
    out = basin.period_sums(_daily(spark, sf_dir), periods, ["cell"], ["v", "w"])
    return rounded(out.withColumn("pct", percent_change(F.col("w"), F.col("v"))), 3)


@query(f"WITH {_DAILY}, pk AS (SELECT cell, arg_max(day, (v, -(day - DATE '1970-01-01'))) AS peak FROM dy WHERE v IS NOT NULL GROUP BY cell) SELECT dy.cell, day, day - peak AS \"offset\", round(v, 4) AS v FROM dy JOIN pk ON dy.cell = pk.cell WHERE abs(day - peak) <= 5")
def peak_window(spark, sf_dir):
    return rounded(events.around_peak(_daily(spark, sf_dir).select("cell", "day", "v"), ["cell"], "v").select("cell", "day", "offset", "v"))


_BEST = f"""{a.LONG_SQL}, bs AS (SELECT *, CAST(year(day) AS INTEGER) AS year, row_number() OVER (PARTITION BY cell, year(day) ORDER BY obs DESC, day) AS k FROM ser)"""


@query(f"WITH {_BEST} SELECT cell, year, day AS peak_day, round(obs, 4) AS peak, round(sim1, 4) AS sim1, round(100 * sim1 / obs, 4) AS sim1_pct FROM bs WHERE k = 1")
def annual_max_reproduction(spark, sf_dir):
    return rounded(events.annual_maxima(a.long_series(spark, sf_dir), ["cell"], "obs", ["sim1"]))


@query(f"""
WITH {_BEST}, g AS (SELECT cell, count(*) AS n, covar_pop(sim1, obs) / nullif(stddev_pop(sim1) * stddev_pop(obs), 0) AS r, stddev_pop(sim1) / nullif(stddev_pop(obs), 0) AS al, avg(sim1) / nullif(avg(obs), 0) AS be,
  sqrt(avg((sim1 - obs) ** 2)) AS rmse, sum(sim1) AS acc, sum(obs) AS ref_acc FROM ser GROUP BY cell),
y AS (SELECT cell, year, count(*) AS c FROM bs GROUP BY 1, 2), ap AS (SELECT bs.cell, median(sim1 / obs) AS ratio FROM bs JOIN y ON y.cell = bs.cell AND y.year = bs.year AND c >= 30 WHERE k = 1 AND obs > 0 GROUP BY 1),
mx AS (SELECT cell, arg_max(sim1 / obs, (obs, -(day - DATE '1970-01-01'))) AS peak_ratio FROM ser GROUP BY cell)
SELECT g.cell, n, round(1 - sqrt(pow(r - 1, 2) + pow(al - 1, 2) + pow(be - 1, 2)), 4) AS kge, round(r, 4) AS r, round(rmse, 4) AS rmse, round(acc, 2) AS acc, round(ref_acc, 2) AS ref_acc, round(acc / ref_acc, 4) AS acc_ratio,
  round(peak_ratio, 4) AS peak_ratio, round(ratio, 4) AS annual_peak_ratio FROM g JOIN mx USING (cell) LEFT JOIN ap USING (cell) WHERE n >= 60
""")
def basin_evaluate(spark, sf_dir):
    ser = a.long_series(spark, sf_dir).where("sim1 is not null and obs is not null")
    score = metrics.full(ser, ["cell"], "sim1", "obs", min_n=60).where("n >= 60").select("cell", "n", "kge", "r", "rmse", F.col("sum_sim").alias("acc"), F.col("sum_obs").alias("ref_acc"))
    peak = ser.groupBy("cell").agg(F.max_by(F.col("sim1") / F.col("obs"), F.struct("obs", -F.unix_date("day"))).alias("peak_ratio"))
    long_years = ser.groupBy("cell", F.year("day").alias("year")).agg(F.count("*").alias("c")).where("c >= 30").select("cell", "year")
    yearly = events.annual_maxima(ser, ["cell"], "obs", ["sim1"]).join(long_years, ["cell", "year"]).where("peak > 0")
    yearly = yearly.groupBy("cell").agg(F.median(F.col("sim1") / F.col("peak")).alias("annual_peak_ratio"))
    out = score.join(peak, "cell").join(yearly, "cell", "left").withColumn("acc_ratio", F.col("acc") / F.col("ref_acc"))
    two = {"acc", "ref_acc"}
    return out.select(*[F.round(c, 2 if c in two else 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query()
def pot_gpd_levels(spark, sf_dir):
    ser = a.long_series(spark, sf_dir).dropna(subset=["obs", "sim1"])  # days on which every product is valid
    ser = ser.select("cell", "day", F.explode(F.create_map(F.lit("obs"), "obs", F.lit("sim1"), "sim1")).alias("product", "v"))
    spans = ser.groupBy("cell", "product").agg((F.count("v") / 365.25).alias("n_years"))
    return freq.return_levels(events.decluster(ser, ["cell", "product"], "v"), spans, ["cell", "product"], "v")


@query()
def return_level_ratio(spark, sf_dir):
    return freq.compare_levels(pot_gpd_levels(spark, sf_dir), "product", "obs")
