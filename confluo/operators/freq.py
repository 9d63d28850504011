"""Peaks over threshold with a generalised Pareto distribution."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIODS = (2, 5, 10, 20, 50, 100)


def fit_pareto(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of greatest likelihood, location 0, by the profile in one parameter t = shape / scale."""
    top, mean = float(excess.max()), float(excess.mean())

    def profile(t: float) -> tuple[float, float, float]:
        if abs(t) < 1e-9:
            return -len(excess) * (log(mean) + 1), 0.0, mean
        shape = float(np.log1p(t * excess).mean())
        scale = shape / t
        return (-len(excess) * (log(scale) + shape + 1), shape, scale) if scale > 0 else (-np.inf, shape, scale)

    low, high = -1 / top + 1e-6 / top, 10 / mean
    tries = np.concatenate([np.linspace(low, 0, 60), np.linspace(0, high, 120)[1:]])
    value = [profile(t)[0] for t in tries]
    # The likelihood grows without bound as the end point nears the largest value: take the best inner maximum.
    peaks = [k for k in range(1, len(tries) - 1) if value[k] >= value[k - 1] and value[k] >= value[k + 1]] or [int(np.argmax(value))]
    k = max(peaks, key=lambda i: value[i])
    a, b = tries[max(k - 1, 0)], tries[min(k + 1, len(tries) - 1)]
    for _ in range(60):
        c, d = a + 0.382 * (b - a), a + 0.618 * (b - a)
        a, b = (a, d) if profile(c)[0] > profile(d)[0] else (c, b)
    _, shape, scale = profile((a + b) / 2)
    return shape, scale


def return_level(u: float, shape: float, scale: float, rate: float, years: float) -> float:
    if abs(shape) < 1e-6:
        return u + scale * log(rate * years)
    return u + scale / shape * ((rate * years) ** shape - 1)


def return_levels(peaks: DataFrame, spans: DataFrame, keys: Sequence[str], value: str, per_year: float = 3.0, least: int = 8, least_excess: int = 6, periods: Sequence[int] = PERIODS) -> DataFrame:
    """Levels for every period by key: threshold u, rate, shape, scale, years, level. peaks are declustered; spans gives
    each key's n_years. Keys with fewer than least peaks or least_excess positive excesses have no rows."""
    types = dict(peaks.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "u double, rate double, shape double, scale double, years int, level double"])
    names = [*keys, "u", "rate", "shape", "scale", "years", "level"]

    def levels(g: pd.DataFrame) -> pd.DataFrame:
        n_years = float(g["n_years"].iloc[0])
        k = min(max(least, round(per_year * n_years)), len(g))
        top = np.sort(g[value].to_numpy(float))[::-1][:k]
        excess = top - top[-1] if k else top
        excess = excess[excess > 0]
        if k < least or len(excess) < least_excess:
            return pd.DataFrame(columns=names)
        shape, scale = fit_pareto(excess)
        head = [*g.iloc[0][list(keys)], float(top[-1]), k / n_years, shape, scale]
        return pd.DataFrame([[*head, t, return_level(float(top[-1]), shape, scale, k / n_years, t)] for t in periods], columns=names)

    return peaks.join(spans, list(keys)).groupBy(*keys).applyInPandas(levels, schema)


def compare_levels(levels: DataFrame, product: str, reference: str) -> DataFrame:
    """Each product's level over the reference's, by the other keys and years."""
    keys = [c for c in levels.columns if c not in (product, "u", "rate", "shape", "scale", "level")]
    ref = levels.where(F.col(product) == reference).select(*keys, F.col("level").alias("ref_level"))
    return levels.where(F.col(product) != reference).join(ref, keys).withColumn("ratio", F.col("level") / F.col("ref_level"))
