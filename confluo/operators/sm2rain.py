"""Rain from soil moisture: the basic and the infiltration model, objectives and calibration."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..sources import views
from . import geo
from .time import difference

# Starts and bounds of the published calibrations.
STARTS = ((20.0, 10.0, 20.0), (5.0, 5.0, 10.0), (50.0, 15.0, 40.0), (1.0, 2.0, 5.0))
BOUNDS = ((0.01, 500.0), (0.01, 30.0), (1.0, 150.0))
GA_STARTS = ((0.05, 2, 10, 5, 100), (0.01, 1, 10, 2, 50), (0.1, 3, 30, 5, 150), (0.05, 5, 50, 10, 300))
GA_BOUNDS = ((1e-4, 10.0), (0.1, 30.0), (1.0, 200.0), (0.01, 200.0), (20.0, 1000.0))
EDGE = 1e-6


def wetness(v: str) -> Column:
    return clip(F.col(v), EDGE, 1 - EDGE)


def forward(df: DataFrame, keys: Sequence[str], theta: str, a: Column, b: Column, z: Column, day: str = "day", min_n: int = 30) -> DataFrame:
    """Adds rain = max(0, z * dtheta + a * theta^b), dtheta being the change since the row before; NULL for series of
    fewer than min_n values."""
    df = df.withColumn("_t", wetness(theta))
    df = df.withColumn("_d", difference(keys, "_t", day)).withColumn("_n", F.count("_t").over(Window.partitionBy(*keys)))
    rain = F.when(F.col("_n") >= min_n, clip(z * F.col("_d") + a * F.pow("_t", b), 0.0))
    return df.withColumn("rain", rain).drop("_t", "_d", "_n")


def forward_infiltration(df: DataFrame, keys: Sequence[str], theta: str, a: float, c: float, z: float, ks: float, psi: float, day: str = "day", min_n: int = 30) -> DataFrame:
    """Adds rain by infiltration capacity: residual and saturated wetness are a key's 5th and 95th percentiles. NULL for
    series of fewer than min_n values."""
    df = df.withColumn("_t", wetness(theta))
    limits = df.groupBy(*keys).agg(F.percentile("_t", F.lit(0.05)).alias("_lo"), F.percentile("_t", F.lit(0.95)).alias("_hi"), F.count("_t").alias("_n"))
    df = df.withColumn("_d", difference(keys, "_t", day)).join(limits, list(keys))
    room = clip(F.col("_hi") - F.col("_lo"), 0.03, 0.60)
    depth = z * clip(F.col("_t") - F.col("_lo"), 0.1 / z)
    rate = ks * (1 + psi * room / clip(depth, 0.1))
    rain = clip((z * F.col("_d") + a * rate) / clip(1 - F.pow("_t", F.lit(c)), 0.02), 0.0, 500.0)
    return df.withColumn("rain", F.when(F.col("_n") >= min_n, rain)).drop("_t", "_d", "_lo", "_hi", "_n")


def grid_calibrate(df: DataFrame, keys: Sequence[str], theta: str, target: str, grid: DataFrame, day: str = "day", min_n: int = 30) -> DataFrame:
    """The parameters (a, b, z) of grid with the least mean squared error, by key: gaps are closed up before the change
    is taken. grid is a small table of candidates."""
    rows = df.dropna(subset=[theta, target]).withColumn("_t", wetness(theta))
    rows = rows.withColumn("_d", difference(keys, "_t", day))
    rain = F.greatest(F.col("z") * F.col("_d") + F.col("a") * F.pow("_t", F.col("b")), F.lit(0.0))
    error = F.avg(F.pow(rain - F.col(target), F.lit(2.0)))
    tried = rows.crossJoin(F.broadcast(grid)).groupBy(*keys, "a", "b", "z").agg(error.alias("mse"), F.count("*").alias("n")).where(F.col("n") >= min_n)
    best = tried.groupBy(*keys).agg(F.min(F.struct("mse", "a", "b", "z")).alias("p"))
    return best.select(*keys, "p.a", "p.b", "p.z", "p.mse")


def basic_rain(theta: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rain of the basic model; theta and parameters of one series, or of many (series in rows, parameters in columns)."""
    t = np.clip(theta, EDGE, 1 - EDGE)
    a, b, z = (np.asarray(p[..., k])[..., None] for k in range(3))
    return np.maximum(z * np.diff(t, prepend=t[..., :1]) + a * t**b, 0)


def infiltration_rain(theta: np.ndarray, p: np.ndarray, limits: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Rain of the infiltration model, as basic_rain; limits are the 5th and 95th percentiles where rows are padded."""
    t = np.clip(theta, EDGE, 1 - EDGE)
    lo, hi = limits or np.percentile(t, (5, 95), axis=-1)
    lo, hi = np.asarray(lo)[..., None], np.asarray(hi)[..., None]
    a, c, z, ks, psi = (np.asarray(p[..., k])[..., None] for k in range(5))
    depth = z * np.maximum(t - lo, 0.1 / z)
    rate = ks * (1 + psi * np.clip(hi - lo, 0.03, 0.6) / np.maximum(depth, 0.1))
    return np.clip((z * np.diff(t, prepend=t[..., :1]) + a * rate) / np.maximum(1 - t**c, 0.02), 0, 500)


def minimise(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 800, least: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Bounded quasi-Newton minima of many problems at once: places (rows) and values. f(rows, x) gives the values of the
    problems named by rows at the places x.

    Each problem keeps an estimate of its inverse curvature (a small matrix). Steps go along it in the coordinates that no
    bound holds, are cut off at the bounds and halved until the value falls enough. A problem ends when its value falls by
    less than a share of least in each of two rounds, also from the plain gradient; the others go on alone.
    """
    span, p = high - low, len(low)
    u, rows = (start - low) / span, np.arange(len(start))
    value = lambda k, x: f(k, low + x * span)
    best = value(rows, u)

    def slope(k, x, at):
        out = np.empty_like(x)
        for i in range(p):
            step = np.where(x[:, i] < 0.5, 1e-7, -1e-7)
            y = x.copy()
            y[:, i] += step
            out[:, i] = (value(k, y) - at) / step
        return out

    curve, stalled = np.tile(np.eye(p), (len(rows), 1, 1)), np.zeros(len(rows), int)
    g = slope(rows, u, best)
    for _ in range(rounds):
        if not len(rows):
            break
        x, h, v = u[rows], curve[rows], best[rows]
        free = ~((x <= 0) & (g > 0) | (x >= 1) & (g < 0))
        d = -np.einsum("kij,kj->ki", h * free[:, :, None] * free[:, None], g * free)
        back = np.einsum("ki,ki->k", d, g) >= 0
        d[back] = -(g * free)[back]
        size = np.abs(d).max(1, initial=1e-300)
        scale = np.where(back | (stalled[rows] > 0), np.minimum(1.0, 0.1 / size), np.minimum(1.0, 1 / size))
        new, got, todo = x.copy(), v.copy(), np.arange(len(rows))
        for _ in range(30):
            y = np.clip(x[todo] + scale[todo, None] * d[todo], 0, 1)
            w = value(rows[todo], y)
            fell = w <= v[todo] + 1e-4 * np.einsum("ki,ki->k", g[todo], y - x[todo])
            fell &= w < v[todo]
            new[todo[fell]], got[todo[fell]] = y[fell], w[fell]
            todo = todo[~fell]
            if not len(todo):
                break
            scale[todo] *= 0.5
        u[rows], best[rows] = new, got
        after = slope(rows, new, got)
        s, y = new - x, after - g
        sy = np.einsum("ki,ki->k", s, y)
        good = sy > 1e-14
        if good.any():
            r = 1 / sy[good]
            left = np.eye(p) - r[:, None, None] * s[good][:, :, None] * y[good][:, None]
            h[good] = left @ h[good] @ left.transpose(0, 2, 1) + r[:, None, None] * s[good][:, :, None] * s[good][:, None]
        still = v - got <= least * np.maximum(np.abs(v), 1e-12)
        h[still] = np.eye(p)  # once more from the plain gradient
        curve[rows] = h
        stalled[rows] = np.where(still, stalled[rows] + 1, 0)
        going = stalled[rows] < 2
        rows, g = rows[going], after[going]
    return low + u * span, best


#: Values of series (times starts) that are worked on at once.
AT_ONCE = 1 << 20


def calibrate(df: DataFrame, keys: Sequence[str], theta: str, target: str, model: str = "basic", day: str = "day", min_n: int = 30, candidates: Sequence[Sequence[float]] = ()) -> DataFrame:
    """Bounded multi-start calibration of every key's series: parameters as an array, mse (the objective) and n; null
    parameters where a series has fewer than min_n days with both values.

    The model is basic (a, b, z) or infiltration (a, c, z, ks, psi; its objective adds a small penalty). Starts are the
    published ones and, where candidates are given, the best of these; so no candidate is better than the result. Each
    series is one row of arrays, and a batch of rows is calibrated together: its length is the number of days.
    """
    starts, bounds = (STARTS, BOUNDS) if model == "basic" else (GA_STARTS, GA_BOUNDS)
    low, high = np.array(bounds, float).T
    kinds = dict(df.dtypes)
    rows = df.dropna(subset=[theta, target]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(theta).cast("double").alias("t"), F.col(target).cast("double").alias("p")))).alias("_s"))
    rows = rows.select(*keys, F.col("_s.t").alias("_t"), F.col("_s.p").alias("_p"))

    def solve(some_t: list[np.ndarray], some_p: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(t) for t in some_t])
        width = int(n.max())
        t, p = (np.array([np.pad(x, (0, width - len(x)), "edge") for x in some]) for some in (some_t, some_p))
        held = np.arange(width) < n[:, None]
        limits = np.array([np.percentile(np.clip(x, EDGE, 1 - EDGE), (5, 95)) for x in some_t]).T

        def goal(k: np.ndarray, x: np.ndarray) -> np.ndarray:
            rain = basic_rain(t[k], x) if model == "basic" else infiltration_rain(t[k], x, (limits[0][k], limits[1][k]))
            out = np.einsum("ki,ki->k", (rain - p[k]) ** 2, held[k]) / n[k]
            return out if model == "basic" else out + 1e-6 * (x[:, 0] ** 2 + x[:, 3] ** 2 + (x[:, 4] / 100) ** 2)

        m = len(n)
        first = np.tile(np.array(starts, float), (m, 1, 1))
        if candidates:
            tried = np.array([goal(np.arange(m), np.tile(np.array(c, float), (m, 1))) for c in candidates])
            first = np.concatenate([first, np.array(candidates, float)[tried.argmin(0)][:, None]], axis=1)
        k = first.shape[1]
        x, v = minimise(lambda r, y: goal(r // k, y), first.reshape(m * k, -1), low, high)
        v = v.reshape(m, k)
        return x.reshape(m, k, -1)[np.arange(m), v.argmin(1)], v.min(1)

    def fit(parts):
        for part in parts:
            n = part["_t"].map(len)
            params, mse = [None] * len(part), [None] * len(part)
            todo = np.flatnonzero(n.to_numpy() >= max(min_n, 1))
            todo = todo[np.argsort(n.to_numpy()[todo], kind="stable")]
            while len(todo):
                take = max(1, AT_ONCE // ((len(starts) + 1) * int(n.iloc[todo[-1]])))
                some, todo = todo[-take:], todo[:-take]
                x, v = solve([part["_t"].iloc[i] for i in some], [part["_p"].iloc[i] for i in some])
                for i, xi, vi in zip(some, x.tolist(), v.tolist(), strict=True):
                    params[i], mse[i] = xi, vi
            yield part[list(keys)].assign(params=params, mse=mse, n=n)

    return rows.mapInPandas(fit, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "params array<double>", "mse double", "n long"]))


def transfer_parameters(need: DataFrame, calibrated: DataFrame, keys: Sequence[str] = ("i", "j"), params: Sequence[str] = ("a", "b", "z")) -> DataFrame:
    """Parameters for every pixel of need: its own (flag 1), else the nearest calibrated pixel's by index distance
    (flag 2; ties to the smaller pixel), else none (flag 0)."""
    k = list(keys)
    own = need.join(calibrated, k).select(*k, *params, F.lit(1).alias("flag"))
    rest = need.select(*k).join(calibrated.select(*k), k, "left_anti")
    sites = calibrated.select(F.struct(*k).alias("_site"), *[F.col(c).cast("double").alias(f"_{c}") for c in k])
    near = geo.nearest(rest, sites, k, *k, "_site", *[f"_{c}" for c in k])
    given = calibrated.select(F.struct(*k).alias("_site"), *params)
    found = near.join(given, "_site", "left").select(*k, *params, F.when(F.col("_site").isNotNull(), 2).otherwise(0).alias("flag"))
    return own.unionByName(found)


def reusable(saved: DataFrame, grid: DataFrame, keys: Sequence[str] = ("i", "j")) -> bool:
    """Whether saved parameters belong to this grid: both have the same pixels."""
    k = list(keys)
    return saved.select(*k).distinct().join(grid.select(*k).distinct().withColumn("_g", F.lit(1)), k, "full").where("_g is null").isEmpty() and grid.select(*k).join(saved.select(*k), k, "left_anti").isEmpty()


def saved_or_calibrated(grid: DataFrame, paths: Sequence[str], calibrate: Callable[[], DataFrame], keys: Sequence[str] = ("i", "j")) -> DataFrame:
    """Parameters of the first saved table that has the grid's pixels; if none has, they are calibrated and saved at the
    first path."""
    spark = grid.sparkSession
    saved = views.first_fitting(spark, paths, lambda df: set(keys) <= set(df.columns) and reusable(df, grid, keys))
    if saved is None:
        calibrate().write.mode("overwrite").parquet(paths[0])
        saved = spark.read.parquet(paths[0])
    return saved


def parameter_summary(params: DataFrame, names: Sequence[str] = ("a", "b", "z")) -> DataFrame:
    """param, low, mean and high of each parameter over all pixels."""
    long = params.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("param", "v"))
    return long.groupBy("param").agg(F.min("v").alias("low"), F.avg("v").alias("mean"), F.max("v").alias("high"))
