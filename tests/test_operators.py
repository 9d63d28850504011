"""Degenerate cases: empty groups, too few rows, constant series, ties, gaps."""

import datetime as dt
from math import isclose

import numpy as np
import pytest
from pyspark.sql import functions as F

from confluo.functions import scalars
from confluo.functions.projection import TransverseMercator
from confluo.operators import basin, boost, events, freq, gapfill, geo, metrics, regress, regrid, sm2rain, tca, time

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def series(spark, values, cell=0):
    return spark.createDataFrame([(cell, day(k), v) for k, v in enumerate(values)], "cell int, day date, v double")


def test_null_safe_expressions(spark):
    df = spark.createDataFrame([(None, 1.0), (-2.0, 0.0), (3.0, float("nan"))], "v double, w double")
    got = df.select(scalars.clip(F.col("v"), 0.0), scalars.ratio(F.col("v"), F.col("w")), scalars.missing(F.col("w")), scalars.percent_change(F.lit(6.0), F.col("w"))).collect()
    assert [tuple(r)[0] for r in got] == [None, 0.0, 3.0]
    assert got[1][1] is None and got[2][2] is None and got[0][2] == 1.0 and got[0][3] is None


def test_bins_and_labels(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (80.0,), (-1.0,), (None,)], "v double")
    got = df.select(scalars.bin_left(F.col("v"), scalars.INTENSITY), scalars.bin_right(F.col("v"), scalars.BANDS), scalars.level(F.col("v"), [1.0, 5.0])).collect()
    assert [r[0] for r in got] == [0, 1, 6, None, None]
    assert [r[1] for r in got] == [0, 1, 5, None, None]
    assert [r[2] for r in got][:3] == [1.0, 1.0, 5.0]


def test_constant_series_has_no_score(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)] * 40 + [(2, None, 1.0)] * 5, "cell int, s double, o double")
    got = {r.cell: r for r in metrics.full(df, ["cell"], "s", "o").collect()}
    assert got[1].n == 40 and got[1].r is None and got[1].kge is None and got[1].bias == -1.0
    assert got[2].n == 0 and got[2].bias is None


@pytest.mark.parametrize("n, there", [(29, False), (30, True)])
def test_least_rows_of_scores(spark, n, there):
    df = spark.createDataFrame([(1, float(k), float(k % 7)) for k in range(n)], "cell int, s double, o double")
    r = metrics.full(df, ["cell"], "s", "o").first()
    assert r.n == n and (r.kge is not None) == there


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(1)
    s, o = rng.gamma(2, 3, 200), rng.gamma(2, 3, 200)
    r = metrics.full(spark.createDataFrame([(1, *map(float, p)) for p in zip(s, o)], "cell int, s double, o double"), ["cell"], "s", "o").first()
    c = np.corrcoef(s, o)[0, 1]
    assert isclose(r.kge, 1 - np.sqrt((c - 1) ** 2 + (s.std() / o.std() - 1) ** 2 + (s.mean() / o.mean() - 1) ** 2), rel_tol=1e-9)
    assert isclose(r.nse, 1 - ((s - o) ** 2).sum() / ((o - o.mean()) ** 2).sum(), rel_tol=1e-9)
    assert isclose(r.ubrmse, (s - o).std(), rel_tol=1e-9)


def test_deaccumulation_needs_consecutive_days(spark):
    rows = [(0, day(0), h, 1.0 * h) for h in range(24)] + [(0, day(2), h, 1.0 * h) for h in range(24)]
    got = {(r.day, r.hour): r.amount for r in time.deaccumulate(spark.createDataFrame(rows, "cell int, day date, hour int, tp double"), ["cell"], "tp").collect()}
    assert got[day(0), 0] == 1.0 and got[day(0), 5] == 1.0 and got[day(0), 23] is None and got[day(2), 23] is None


def test_incomplete_day_is_left_out(spark):
    rows = [(0, day(0), h, 1.0) for h in range(24)] + [(0, day(1), h, 1.0) for h in range(23)]
    got = time.complete_days(spark.createDataFrame(rows, "cell int, day date, hour int, v double"), ["cell"], "v").collect()
    assert [(r.day, r.total) for r in got] == [(day(0), 24.0)]


def test_gaps_hold_the_edges(spark):
    got = time.interpolate_gaps(series(spark, [None, 2.0, None, None, 8.0, None]), ["cell"], "v").orderBy("day").collect()
    assert [r.filled for r in got] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]
    assert [r.filled for r in time.interpolate_gaps(series(spark, [None, 2.0]), ["cell"], "v").orderBy("day").collect()] == [None, 2.0]
    assert time.never_valid(series(spark, [None, None]), ["cell"], "v").count() == 1


def test_difference_at_start_and_after_gap(spark):
    got = series(spark, [1.0, 3.0, None, 4.0]).select("day", time.difference(["cell"], "v").alias("d")).orderBy("day").collect()
    assert [r.d for r in got] == [0.0, 2.0, None, None]


def test_collocation_recovers_errors(spark):
    rng = np.random.default_rng(2)
    t = rng.normal(0, 3, 4000)
    x, y, z = t + rng.normal(0, 1, 4000), 2 * t + rng.normal(0, 1, 4000), t + rng.normal(0, 2, 4000)
    df = spark.createDataFrame([(1, *map(float, r)) for r in zip(x, y, z)], "cell int, x double, y double, z double")
    r = tca.weights(tca.error_variances(df, ["cell"], "x", "y", "z")).first()
    assert abs(r.ex - 1) < 0.3 and abs(r.ey - 0.25) < 0.15 and abs(r.ez - 4) < 0.6 and isclose(r.wx + r.wy + r.wz, 1)
    assert tca.error_variances(df.limit(99), ["cell"], "x", "y", "z").first().ex is None


def test_negative_variance_takes_the_median(spark):
    df = spark.createDataFrame([(1, -1.0, 1.0, 1.0), (2, 2.0, 1.0, 1.0), (3, 4.0, -1.0, -2.0)], "cell int, ex double, ey double, ez double")
    got = {r.cell: r for r in tca.repair(df).collect()}
    assert got[1].ex == 3.0 and got[3].ey == 1.0 and got[3].ez == 1.0


def test_soil_moisture_rain(spark):
    theta = [0.1, 0.5, 0.4, None, 0.6]
    df = series(spark, theta).withColumnRenamed("v", "t")
    got = [r.rain for r in sm2rain.forward(df, ["cell"], "t", F.lit(20.0), F.lit(10.0), F.lit(20.0), min_n=1).orderBy("day").collect()]
    assert isclose(got[1], 20 * 0.4 + 20 * 0.5**10) and got[2] == 0.0 and got[3] is None and got[4] is None
    assert all(r.rain is None for r in sm2rain.forward(df, ["cell"], "t", F.lit(20.0), F.lit(10.0), F.lit(20.0)).collect())


def test_calibration_finds_parameters(spark):
    rng = np.random.default_rng(3)
    theta = np.clip(np.cumsum(rng.normal(0, 0.1, 120)) % 1, 0.01, 0.99)
    rain = sm2rain.basic_rain(theta, np.array([30.0, 4.0, 25.0]))
    df = spark.createDataFrame([(1, day(k), float(t), float(p)) for k, (t, p) in enumerate(zip(theta, rain))], "cell int, day date, t double, p double")
    r = sm2rain.calibrate(df, ["cell"], "t", "p").first()
    assert r.mse < 0.5 * rain.var() and all(lo <= v <= hi for v, (lo, hi) in zip(r.params, sm2rain.BOUNDS))
    assert sm2rain.calibrate(df.limit(29), ["cell"], "t", "p").first().params is None


def test_infiltration_calibration_lowers_its_objective(spark):
    rng = np.random.default_rng(4)
    theta = np.clip(np.cumsum(rng.normal(0, 0.1, 120)) % 1, 0.01, 0.99)
    rain = sm2rain.infiltration_rain(theta, np.array([0.1, 3.0, 20.0, 3.0, 60.0]))
    df = spark.createDataFrame([(1, day(k), float(t), float(p)) for k, (t, p) in enumerate(zip(theta, rain))], "cell int, day date, t double, p double")
    r = sm2rain.calibrate(df, ["cell"], "t", "p", "infiltration").first()
    goal = lambda x: np.mean((sm2rain.infiltration_rain(theta, x) - rain) ** 2) + 1e-6 * (x[0] ** 2 + x[3] ** 2 + (x[4] / 100) ** 2)
    assert isclose(r.mse, goal(np.array(r.params)), rel_tol=1e-9) and r.mse < 0.5 * min(goal(np.array(s, float)) for s in sm2rain.GA_STARTS)
    assert all(lo <= v <= hi for v, (lo, hi) in zip(r.params, sm2rain.GA_BOUNDS)) and r.mse < 0.5 * rain.var()


def test_calibration_queries_take_sixteen_cells(spark, sf_dir):
    from confluo.plans import fusion

    for query, size in ((fusion.calibrate_optimizer, 3), (fusion.calibrate_infiltration, 5)):
        got = query(spark, sf_dir).collect()
        assert len(got) > 4 and {len(r.params) for r in got if r.params} == {size}


def test_parameters_without_any_calibrated_pixel(spark):
    need = spark.createDataFrame([(0, 0), (3, 3)], "i long, j long")
    none = spark.createDataFrame([], "i long, j long, a double, b double, z double")
    assert {r.flag for r in sm2rain.transfer_parameters(need, none).collect()} == {0}
    one = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0)], "i long, j long, a double, b double, z double")
    assert {(r.i, r.flag, r.a) for r in sm2rain.transfer_parameters(need, one).collect()} == {(0, 1, 1.0), (3, 2, 1.0)}


def test_regression_thresholds_and_collinearity(spark):
    df = spark.createDataFrame([(1, float(k), 2.0 * k, 3.0 * k + 1) for k in range(60)], "cell int, x double, x2 double, y double")
    r = regress.ols_single(df, ["cell"], "x", "y").first()
    assert isclose(r.slope, 3) and isclose(r.intercept, 1) and regress.ols_single(df.limit(59), ["cell"], "x", "y").count() == 0
    m = regress.ols_multi(df, ["cell"], ["x", "x2"], "y").first()
    assert isclose(m.coef[1], 2 * m.coef[0], rel_tol=1e-6) and isclose(m.coef[0] + 2 * m.coef[1], 3, rel_tol=1e-6)


def test_owner_tie_goes_to_the_first(spark):
    df = spark.createDataFrame([(0, 0, 2, 5.0), (0, 0, 1, 5.0), (0, 1, 2, 6.0), (0, 1, 1, 5.0)], "i int, j int, code int, km2 double")
    assert {(r.j, r.code) for r in regress.dominant_owner(df, ["i", "j"]).collect()} == {(0, 1), (1, 2)}


def test_axis_weights_clamp_and_descending_source(spark):
    src = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 1.0)], "i int, lat double")
    tgt = spark.createDataFrame([(0, 0.5), (1, 2.25), (2, 9.0), (3, 2.0)], "ti int, tlat double")
    got = {}
    for r in regrid.axis_weights(src, tgt, "i", "lat", "ti", "tlat").collect():
        if r.w_ti:
            got.setdefault(r.ti, {})[r.i] = r.w_ti
    assert got == {0: {2: 1.0}, 1: {1: 0.75, 0: 0.25}, 2: {0: 1.0}, 3: {1: 1.0}}


def test_ratio_fill_cases(spark):
    wet = [(0, 0, c, 10.0 if c < 3 else None, 5.0) for c in range(4)]
    dry = [(1, 0, 0, None, 0.1), (1, 0, 1, None, None), (1, 0, 2, None, 5.0), (1, 0, 3, 4.0, 5.0)]
    df = spark.createDataFrame([(d, float(x), float(y), y, v, g) for d, x, y, v, g in wet + dry], "day int, x double, y double, cell int, v double, g double")
    got = {(r.day, r.cell): (r.how, r.filled) for r in gapfill.ratio_fill(df, "v", "g", "x", "y").collect()}
    assert got[0, 3] == ("ratio", 10.0) and got[1, 0] == ("dry", 0.0) and got[1, 1] == ("none", None) and got[1, 2] == ("none", None) and got[1, 3][0] == "own"


def test_spatial_fill_is_linear_inside(spark):
    pts = [(0, 0), (0, 4), (4, 0), (4, 4), (2, 1), (1, 3)]
    rows = [(1, float(x), float(y), float(x + 2 * y)) for x, y in pts] + [(1, 2.0, 2.0, None), (1, 9.0, 9.0, None)]
    got = {(r.x, r.y): r.filled for r in gapfill.spatial_fill(spark.createDataFrame(rows, "day int, x double, y double, v double"), ["day"], "v", "x", "y").collect()}
    assert isclose(got[2.0, 2.0], 6.0, abs_tol=1e-6) and got[9.0, 9.0] == 12.0


def test_projection_origin(spark):
    x, y = TransverseMercator().forward(F.lit(127.5), F.lit(38.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert isclose(r.x, 1e6, abs_tol=1e-6) and isclose(r.y, 2e6, abs_tol=1e-6)


def test_polygon_vertex_hole_and_area(spark):
    rings = [(False, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (True, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)])]
    polygons = spark.createDataFrame([("A", rings)], f"code string, rings {geo.RINGS}")
    sides = geo.edges(polygons)
    pts = spark.createDataFrame([(1, 1.5, 1.5), (2, 3.0, 3.0), (3, 5.0, 1.0), (4, 0.5, 1.0)], "p int, lon double, lat double")
    assert {r.p for r in geo.in_polygon(pts, sides, "p").collect()} == {2, 4}
    assert isclose(geo.shoelace(sides).first().area, 15.0)
    cells = spark.createDataFrame([(0, 0, 1.5, 1.5), (0, 1, 3.5, 3.5), (0, 2, 9.0, 9.0)], "i int, j int, lon double, lat double")
    got = {r.j: r.km2 for r in geo.overlap_areas(polygons, cells, 1.0).collect()}
    assert set(got) == {1}


def test_nearest_tie(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0)], "p int, x double, y double")
    st = spark.createDataFrame([(7, 1.0, 0.0), (3, -1.0, 0.0)], "station int, lon double, lat double")
    assert geo.nearest(pts, st, ["p"], "x", "y", "station", "lon", "lat").first().station == 3


def test_basin_half_valid_area(spark):
    bridge = spark.createDataFrame([("A", 0, 0, 50.0), ("A", 0, 1, 50.0), ("B", 0, 1, 51.0), ("B", 0, 0, 49.0)], "code string, i int, j int, km2 double")
    cube = spark.createDataFrame([(0, 0, day(0), 4.0), (0, 1, day(0), None)], "i int, j int, day date, v double")
    assert {r.code: r.v for r in basin.area_mean(cube, bridge, ["i", "j"], "v").collect()} == {"A": 4.0, "B": None}


def test_event_span_and_windows(spark):
    df = series(spark, [0.0, 2.0, 5.0, 9.0, 1.0, 0.5, 3.0])
    r = events.event_span(df, ["cell"], "v").first()
    assert (r["first"], r.peak, r["last"]) == (day(1), day(3), day(4))
    lone = events.event_span(series(spark, [0.2, 0.9, 0.1]), ["cell"], "v").first()
    assert lone["first"] == lone.peak == lone["last"] == day(1)
    assert events.around_place(df, ["cell"], "v", rows=1).count() == 3


def test_decluster(spark):
    got = events.decluster(series(spark, [5.0, 9.0, 4.0, 0.0, 8.0, 0.0, 7.0]), ["cell"], "v").collect()
    assert sorted(r.v for r in got) == [8.0, 9.0]


def test_pareto_recovers_shape(spark):
    u = (np.arange(4000) + 0.5) / 4000
    shape, scale = freq.fit_pareto(5.0 / 0.2 * ((1 - u) ** -0.2 - 1))
    assert abs(shape - 0.2) < 0.03 and abs(scale - 5) < 0.2
    assert isclose(freq.return_level(10, 0.0, 2.0, 3.0, 10), 10 + 2 * np.log(30))
    few = spark.createDataFrame([(1, float(k)) for k in range(7)], "cell int, v double")
    spans = spark.createDataFrame([(1, 2.0)], "cell int, n_years double")
    assert freq.return_levels(few, spans, ["cell"], "v").count() == 0


def test_k_nearest_is_exact(spark):
    rng = np.random.default_rng(3)
    p = np.vstack([rng.uniform(0, 10, (60, 2)), [[1.0, 1.0], [500.0, -300.0]]])
    s = np.vstack([rng.uniform(0, 3, (60, 2)), rng.normal(2, 1e-4, (300, 2)), rng.uniform(0, 10, (10, 2)), np.ones((70, 2))])
    points = spark.createDataFrame([(i, *map(float, v), 1.0 + i % 3, 2.0) for i, v in enumerate(p)], "p int, x double, y double, kx double, ky double")
    stations = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(s)], "station int, sx double, sy double")
    for k, weights in ((1, None), (3, ("kx", "ky")), (1000, None)):
        got = geo.k_nearest(points, stations, ["p"], "x", "y", "station", "sx", "sy", k, weights).collect()
        for i, v in enumerate(p):
            d2 = (((s - v) * ([1.0 + i % 3, 2.0] if weights else [1.0, 1.0])) ** 2).sum(1)
            mine = sorted((r["rank"], r.station) for r in got if r.p == i)
            want = np.lexsort((np.arange(len(s)), d2))[:k]
            assert [r for r, _ in mine] == list(range(1, len(want) + 1)) and [x for _, x in mine] == want.tolist()


def test_nearest_without_coordinates(spark):
    """Points without coordinates stay, with no station, whatever the number of stations."""
    rows = [(1, 0.0, 0.0), (2, None, 0.0), (3, 1.0, float("nan")), (None, 5.0, 5.0), (5, float("inf"), 0.0)]
    points = spark.createDataFrame(rows, "p int, x double, y double")
    for n in (0, 3, 3000):
        stations = spark.createDataFrame([(i, i % 60 * 1.0, i // 60 * 1.0) for i in range(n)] + [(-1, None, 1.0), (-2, float("nan"), 0.0)], "station int, sx double, sy double")
        got = {r.p: (r.station, r.distance) for r in geo.nearest(points, stations, ["p"], "x", "y", "station", "sx", "sy").collect()}
        assert set(got) == {1, 2, 3, None, 5} and {p: v for p, v in got.items() if p not in (1, None)} == {2: (None, None), 3: (None, None), 5: (None, None)}
        assert got[1] == ((0, 0.0) if n else (None, None))
        assert got[None] == {0: (None, None), 3: (2, (3**2 + 5**2) ** 0.5), 3000: (305, 0.0)}[n]


def test_buffer_and_overlap_of_a_holed_square(spark):
    rings = [(False, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), (True, [(0.5, 0.5), (0.5, 1.5), (1.5, 1.5), (1.5, 0.5)])]
    shape = spark.createDataFrame([("a", rings)], "code string, rings array<struct<is_hole: boolean, pts: array<struct<x: double, y: double>>>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.55, 1.0), (3, 2.05, 1.0), (4, 2.2, 1.0), (5, 2.05, 2.05), (6, 2.08, 2.08)], "p int, lon double, lat double")
    assert sorted(r.p for r in geo.near_polygon(points, geo.edges(shape), "p", buffer=0.1).collect()) == [2, 3, 5]
    cells = spark.createDataFrame([(i, j, i + 0.5, j + 0.5) for i in range(3) for j in range(3)], "i int, j int, lat double, lon double")
    got = {(r.i, r.j): r.km2 / (111.32**2 * np.cos(np.radians(r.i + 0.5))) for r in geo.overlap_areas(shape, cells, 1.0).collect()}
    assert sorted(got) == [(0, 0), (0, 1), (1, 0), (1, 1)] and all(isclose(v, 0.75, abs_tol=1e-9) for v in got.values())


def test_strict_axes_have_no_points_beyond(spark):
    src = spark.createDataFrame([(0, 2.0), (1, 4.0)], "i int, x double")
    to = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0), (4, 5.0)], "t int, x2 double")
    assert sorted({r.t for r in regrid.axis_weights(src, to, "i", "x", "t", "x2", beyond=False).collect()}) == [1, 2, 3]


def test_cells_outside_the_fixed_mask_stay_missing(spark):
    cells = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 1.0), (4, 0.5, 0.5), (5, 9.0, 9.0)]
    rows = [(d, c, x, y, None if c == 5 or (c == 4 and d == 0) else 2 * x + y) for d in (0, 1) for c, x, y in cells]
    df = spark.createDataFrame(rows, "day int, cell int, x double, y double, v double")
    got = {(r.day, r.cell): r.filled for r in gapfill.spatial_fill(df, ["day"], "v", "x", "y", cell="cell").collect()}
    assert got[0, 5] is None and got[1, 5] is None and isclose(got[0, 4], 1.5) and len(got) == 12


def test_saved_parameters_need_the_same_pixels(spark):
    a = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0), (0, 1, 3.0, 2.0, 5.0)], "i int, j int, a double, b double, z double")
    assert sm2rain.reusable(a, a) and not sm2rain.reusable(a.where("j = 0"), a) and not sm2rain.reusable(a, a.where("j = 0"))
    assert {r.param: (r.low, r.mean, r.high) for r in sm2rain.parameter_summary(a).collect()} == {"a": (1.0, 2.0, 3.0), "b": (2.0, 2.0, 2.0), "z": (3.0, 4.0, 5.0)}


def test_short_series_have_no_infiltration_rain(spark):
    few = sm2rain.forward_infiltration(series(spark, [0.2, 0.4] * 14), ["cell"], "v", 0.05, 2, 10, 5, 100)
    enough = sm2rain.forward_infiltration(series(spark, [0.2, 0.4] * 15), ["cell"], "v", 0.05, 2, 10, 5, 100)
    assert few.where("rain is not null").count() == 0 and enough.where("rain is not null").count() == 30


def test_importances_name_the_feature_that_matters(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(y), float(3 * x + 1)) for x, y in rng.uniform(1, 9, (200, 2))]
    df = spark.createDataFrame(rows, "x double, y double, t double")
    got = regress.importances(df, ["x", "y"], ["x", "y"], "t", F.lit(True), trees=3)
    assert got.first().feature == "x" and isclose(sum(r.importance for r in got.collect()), 1.0, abs_tol=1e-9)


def test_pareto_fit_is_no_less_likely_than_any_of_a_grid():
    x = np.random.default_rng(2).pareto(4, 60) * 5
    like = lambda k, s: -len(x) * np.log(s) - (1 + 1 / k) * np.log1p(k * x / s).sum() if s > 0 and (1 + k * x / s > 0).all() else -np.inf
    k, s = freq.fit_pareto(x)
    assert like(k, s) >= max(like(a, b) for a in np.linspace(-0.4, 1.2, 161) if a for b in np.linspace(0.2, 9, 200)) - 1e-3


def test_negative_and_masked_cells(spark):
    cube = spark.createDataFrame([(0, 0, -1.0), (0, 1, 2.0), (1, 1, 3.0)], "i int, j int, v double")
    mask = spark.createDataFrame([(0, 0), (0, 1)], "i int, j int")
    assert sorted((r.i, r.j, r.v) for r in regrid.masked(cube, mask, "v").collect()) == [(0, 0, 0.0), (0, 1, 2.0)]
    assert regrid.masked(cube, None, "v").count() == 3
    assert sorted((r.i, r.j) for r in regrid.flipped(cube, "both", 2, 2).collect()) == [(0, 0), (1, 0), (1, 1)]


def test_triangulation_is_delaunay():
    r = np.random.default_rng(7)
    lattice = np.array([(i, j) for i in range(9) for j in range(7)], float)
    for places in (r.uniform(0, 1, (120, 2)), lattice, lattice[r.permutation(63)[:40]] * [0.1, 0.25] + 36, np.vstack([lattice[:20], lattice[:5]]), r.normal(0, 1, (60, 2)).round(1)):
        mesh = gapfill.Triangulation(places)
        p, tri = np.array(mesh.p, float), mesh.triangles()
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        areas = [turn(*p[list(t)]) / 2 for t in tri]
        assert min(areas) > 0 and {k for t in tri for k in t} == {min(k for k, q in enumerate(mesh.p) if q == v) if mesh.p.count(v) == 1 else next(k for t in tri for k in t if mesh.p[k] == v) for v in mesh.p}
        hull = sorted(set(mesh.p))
        chains = []
        for some in (hull, hull[::-1]):
            chain = []
            for q in some:
                while len(chain) > 1 and turn(chain[-2], chain[-1], q) <= 0:
                    chain.pop()
                chain.append(q)
            chains += chain[:-1]
        assert isclose(sum(areas), sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(chains, chains[1:] + chains[:1])) / 2, rel_tol=1e-12)
        for a, b, c in tri:
            rows = [[(x - qx, y - qy, (x - qx) ** 2 + (y - qy) ** 2) for x, y in (mesh.p[a], mesh.p[b], mesh.p[c])] for qx, qy in set(mesh.p)]
            for (ax, ay, az), (bx, by, bz), (cx, cy, cz) in rows:
                assert ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx) <= 0
    assert gapfill.Triangulation(np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])).triangles() == []


def test_weights_on_a_grid_of_tenths():
    """Cells on the hull's sides and corners of a decimal grid count as inside; time is near that of a sort."""
    grid = np.array([(34.0 + 0.1 * i, 126.0 + 0.1 * j) for i in range(40) for j in range(30)])
    gone = np.random.default_rng(1).random(len(grid)) < 0.3
    gone[[0, 29, 1170, 1199]] = False
    to, by, w = gapfill.mask_weights(grid[~gone], grid[gone])
    field = grid @ [3.0, -2.0]
    got = np.bincount(to, w * field[~gone][by])
    assert np.allclose(got, field[gone], atol=1e-5) and len(got) == gone.sum()


def test_days_of_one_mask_share_a_triangulation(spark, monkeypatch):
    grid = [(i, j) for i in range(12) for j in range(12)]
    rows = [(d, float(i), float(j), None if (i * 7 + j * 3 + d % 3) % 5 == 0 else 2.0 * i - j + d) for d in range(30) for i, j in grid]
    rows += [(99, 0.0, 0.0, 1.0), (99, 1.0, 0.0, float("nan")), (98, None, 1.0, None), (97, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "day int, x double, y double, v double")
    tables, real = [], gapfill.stored
    monkeypatch.setattr(gapfill, "stored", lambda t, tag: tables.append(real(t, tag)) or tables[-1])
    got = {(r.day, r.x, r.y): r.filled for r in gapfill.spatial_fill(df, ["day"], "v", "x", "y").collect()}
    assert tables[0][1]().select("_mask").distinct().count() == 3 and len(got) == len(rows)
    near_edge = 0
    for d, x, y, v in rows[:-4]:
        if v is None and not isclose(got[d, x, y], 2 * x - y + d, abs_tol=1e-6):
            near_edge += 1
            assert min(x, y) == 0 or max(x, y) == 11
    assert near_edge < 30 * 8 and got[99, 1.0, 0.0] is None and got[98, None, 1.0] is None and got[97, 0.0, 0.0] is None


def test_least_squares_by_one_aggregate(spark):
    r = np.random.default_rng(2)
    rows = []
    for k in range(6):
        x = r.normal(50, 5, (40, 3)) * [1, 100, 0.01]
        if k == 4:
            x[:, 2] = 2 * x[:, 0]
        if k == 5:
            x[:, 1] = 7.0
        rows += [(k, "t", *map(float, v), float(v @ [0.5, -0.02, 9.0] + 3 + e)) for v, e in zip(x, r.normal(0, 0.1, 40), strict=True)]
    rows += [(7, "t", 1.0, 2.0, 3.0, 4.0), (0, "t", None, 1.0, 1.0, 1.0), (0, "t", 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "k int, s string, a double, b double, c double, y double")
    got = {r.k: r for r in regress.ols_multi(df, ["k", "s"], ["a", "b", "c"], "y", 10).collect()}
    assert set(got) == set(range(6))
    for k in range(6):
        m = np.array([v[2:] for v in rows[:-3] if v[0] == k])
        want = np.linalg.lstsq(np.column_stack([m[:, :3], np.ones(40)]), m[:, 3], rcond=1e-9)[0]
        assert np.allclose([*got[k].coef, got[k].intercept], want, rtol=1e-5, atol=1e-6) and got[k].n_fit == 40


def test_minima_within_bounds():
    rng = np.random.default_rng(5)
    centre, weight = rng.uniform(-1, 3, (200, 3)), rng.uniform(0.1, 50, (200, 3))
    x, v = sm2rain.minimise(lambda k, y: (weight[k] * (y - centre[k]) ** 2).sum(1), np.full((200, 3), 0.3), np.zeros(3), np.full(3, 2.0))
    assert np.allclose(x, np.clip(centre, 0, 2), atol=1e-3) and np.allclose(v, (weight * (np.clip(centre, 0, 2) - centre) ** 2).sum(1), atol=1e-4)
    valley = lambda k, y: (1 - y[:, 0]) ** 2 + 100 * (y[:, 1] - y[:, 0] ** 2) ** 2
    assert sm2rain.minimise(valley, np.array([[-1.2, 1.0]]), np.full(2, -2.0), np.full(2, 2.0))[1][0] < 1e-3


def test_many_pixels_are_calibrated_together(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(643):
        n = 20 if k == 5 else int(rng.integers(40, 90))
        t = np.clip(np.cumsum(rng.normal(0, 0.1, n)) % 1, 0.01, 0.99)
        true = np.array([rng.uniform(5, 60), rng.uniform(2, 12), rng.uniform(5, 60)])
        rows += [(k, day(i), float(a), float(b)) for i, (a, b) in enumerate(zip(t, sm2rain.basic_rain(t, true), strict=True))]
    df = spark.createDataFrame(rows, "cell int, day date, t double, p double").withColumn("t", F.when(F.col("cell") != 6, F.col("t")))
    got = {r.cell: r for r in sm2rain.calibrate(df, ["cell"], "t", "p").collect()}
    assert set(got) == set(range(643)) - {6} and got[5].params is None and got[5].n == 20
    spread = {r.cell: r.s for r in df.groupBy("cell").agg(F.var_pop("p").alias("s")).collect()}
    ratio = np.array([got[k].mse / spread[k] for k in got if k != 5])
    assert np.median(ratio) < 1e-4 and (ratio < 0.05).mean() > 0.95


def wavy(spark, n=3000, seed=1):
    r = np.random.default_rng(seed)
    x = r.uniform(0, 10, (n, 3))
    y = 20 + 5 * np.sin(x[:, 0]) + np.where(x[:, 1] > 3, 8, 0) * (x[:, 0] > 5) + r.normal(0, 0.5, n)
    return spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y, strict=True)], "a double, b double, noise double, y double")


def test_leafwise_trees(spark):
    df = wavy(spark)
    s = boost.Settings(trees=40, rate=0.1, columns=1.0)
    one = boost.fit(df, ["a", "b", "noise"], "y", s)
    sizes = np.diff(np.append(one.roots, len(one.feature)))
    assert len(one.roots) == 40 and sizes.max() <= 2 * 31 - 1
    x, y = np.array(df.select("a", "b", "noise").collect()), np.array([r.y for r in df.select("y").collect()])
    assert ((one.predict(x) - y) ** 2).mean() < 0.05 * y.var()
    # Several tasks sum their histograms to the same trees.
    many = boost.fit(df, ["a", "b", "noise"], "y", s, rows_a_task=900)
    assert np.array_equal(many.feature, one.feature) and np.allclose(many.threshold, one.threshold) and np.allclose(many.value, one.value)
    # No leaf is smaller than the least; splits by noise gain little.
    reach = np.zeros(len(one.feature), int)
    for root in one.roots:
        at = np.full(len(x), root)
        while (inner := one.feature[at] >= 0).any():
            at[inner] = np.where(x[inner, one.feature[at[inner]]] <= one.threshold[at[inner]], one.left[at[inner]], one.right[at[inner]])
        reach += np.bincount(at, minlength=len(reach))
    assert reach[one.feature < 0].min() >= 30
    found = {r.feature: r for r in boost.importances(df, one).collect()}
    assert found["a"].gain > found["b"].gain > 20 * found["noise"].gain


def test_leafwise_is_nearer_than_levelwise(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    df, new = wavy(spark), wavy(spark, 800, 9)
    model = boost.fit(df, ["a", "b", "noise"], "y", boost.Settings(trees=25, rate=0.2))
    mine = boost.predicted(new, model, F.lit(True)).agg(F.avg((F.col("pred") - F.col("y")) ** 2).alias("m")).first().m
    pack = VectorAssembler(inputCols=["a", "b", "noise"], outputCol="x").transform
    level = GBTRegressor(featuresCol="x", labelCol="y", maxIter=25, stepSize=0.2, maxDepth=5, minInstancesPerNode=30, seed=1).fit(pack(df))
    assert mine < level.transform(pack(new)).agg(F.avg((F.col("prediction") - F.col("y")) ** 2).alias("m")).first().m


def test_leafwise_with_few_or_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 1.0)], "a double, y double")
    few = boost.fit(df, ["a"], "y", boost.Settings(trees=3))
    assert few.base == 3.0 and [r.pred for r in boost.predicted(df, few, F.col("a").isNotNull()).orderBy("y").collect()] == [None, 3.0, 3.0]
    none = boost.fit(df.limit(0), ["a"], "y")
    assert none.base is None and {r.pred for r in boost.predicted(df, none, F.col("a") > 0).collect()} == {None}


def test_pairs_of_points_and_polygons_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(geo, "TOGETHER", 4)
    square = lambda k, hole: [(hole, [(0.0, 0.0), (k, 0.0), (k, k), (0.0, k)])]
    shapes = [("a", square(1.0, False)), ("b", square(2.0, False) + square(1.0, True)), ("c", [*square(1.0, False), (False, [(3.0, 3.0), (4.0, 3.0), (4.0, 4.0)])])]
    shapes = spark.createDataFrame(shapes, "code string, rings array<struct<is_hole: boolean, pts: array<struct<x: double, y: double>>>>")
    places = {0: (0.5, 0.5), 1: (1.5, 1.5), 2: (3.9, 3.5), 3: (3.1, 3.5), 4: (None, 1.0), 5: (float("nan"), 0.5)}
    points = spark.createDataFrame([(6 * n + k, x, y) for n in range(50) for k, (x, y) in places.items()], "p long, lon double, lat double")
    for got in (geo.in_polygon(points, geo.edges(shapes), "p", band=0.3), geo.near_polygon(points, geo.edges(shapes), "p", buffer=1e-3)):
        assert sorted((r.p, r.code) for r in got.collect()) == sorted((6 * n + k, c) for n in range(50) for k, c in ((0, "a"), (0, "c"), (1, "b"), (2, "c")))
        above = got._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
        assert "Aggregate" not in above and "Exchange" not in above


def test_lattice_points_inside_are_made_once_and_nearest_needs_no_second_join(spark):
    shape = spark.createDataFrame([(c, [(False, [(d, 0.0), (d + 1.0, 0.1), (d + 0.8, 1.0), (d, 0.9)]), (True, [(d + 0.3, 0.3), (d + 0.6, 0.3), (d + 0.4, 0.6)])]) for c, d in (("a", 0.0), ("b", 0.45))], "code string, rings array<struct<is_hole: boolean, pts: array<struct<x: double, y: double>>>>")
    sides = geo.edges(shape)
    boxes = sides.groupBy("code").agg(F.min("x1").alias("x0"), F.min("y1").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    points = geo.lattice(boxes, "code", 0.07).withColumn("px", F.col("px") + 0.01).withColumn("py", F.col("py") + 0.02).withColumn("p", F.struct("pa", "pb"))
    want = {(r.code, *r.p) for r in geo.in_polygon(points, sides, "p", "px", "py", own=True).collect()}
    inside = geo.inside_lattice(boxes, sides, "code", 0.07, 0.01, 0.02, 0.15)
    got = [tuple(r) for r in inside.select("code", "pa", "pb").collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == want
    stations = spark.createDataFrame([(1, 0.2, 0.2), (2, 1.2, 0.7)], "station long, lon double, lat double")
    twice = inside.union(inside).union(spark.createDataFrame([("c", 0, 0, None, 1.0)], inside.schema))
    near = geo.nearest(twice, stations, ["code"], "px", "py", "station", "lon", "lat")
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert near.count() == 2 * len(got) + 1 and [r.code for r in near.where("station is null").collect()] == ["c"]
