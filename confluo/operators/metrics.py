"""Skill scores as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import corr, ratio


def _pairs(sim: Column, obs: Column) -> tuple[Column, Column]:
    both = sim.isNotNull() & obs.isNotNull()
    return F.when(both, sim), F.when(both, obs)


def kge_parts(sim: str, obs: str) -> dict[str, Column]:
    """Aggregates n, r, alpha and beta over rows with both values."""
    s, o = _pairs(F.col(sim), F.col(obs))
    return {"n": F.count(s), "r": corr(s, o), "alpha": ratio(F.stddev_pop(s), F.stddev_pop(o)), "beta": ratio(F.avg(s), F.avg(o))}


def kge_of(r: str = "r", alpha: str = "alpha", beta: str = "beta") -> Column:
    return 1 - F.sqrt(sum((F.pow(F.col(c) - 1, F.lit(2.0)) for c in (alpha, beta)), F.pow(F.col(r) - 1, F.lit(2.0))))


def kge(df: DataFrame, keys: Sequence[str], sim: str, obs: str, min_n: int = 60) -> DataFrame:
    """n, r, alpha, beta and kge by key; the scores are NULL for fewer than min_n pairs or a constant series."""
    out = df.groupBy(*keys).agg(*[v.alias(k) for k, v in kge_parts(sim, obs).items()]).withColumn("kge", kge_of())
    return out.select(*keys, "n", *[F.when(F.col("n") >= min_n, F.col(c)).alias(c) for c in ("r", "alpha", "beta", "kge")])


def detection(df: DataFrame, keys: Sequence[str], sim: str, obs: str, thresholds: Sequence[float]) -> DataFrame:
    """Hits, misses, false alarms, POD, FAR and CSI by key and threshold; NULL on empty denominators."""
    s, o, th = F.col(sim), F.col(obs), F.col("threshold")
    rows = df.where(s.isNotNull() & o.isNotNull()).select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    counts = rows.groupBy(*keys, "threshold").agg(
        F.count_if((s >= th) & (o >= th)).alias("hits"), F.count_if((s < th) & (o >= th)).alias("misses"), F.count_if((s >= th) & (o < th)).alias("false_alarms")
    )
    return counts.withColumns(_shares())


def _shares() -> dict[str, Column]:
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    return {"pod": share(h, h + m), "far": share(f, h + f), "csi": share(h, h + m + f)}


def full(df: DataFrame, keys: Sequence[str], sim: str, obs: str, wet: float = 1.0, min_n: int = 30) -> DataFrame:
    """Every score by key in one aggregate: n, r, bias, rbias, rmse, ubrmse, alpha, beta, kge, nse, pod, far, csi and the
    means and sums of both; with fewer than min_n pairs n alone."""
    s, o = _pairs(F.col(sim), F.col(obs))
    d = s - o
    sums = df.groupBy(*keys).agg(
        *[v.alias(k) for k, v in kge_parts(sim, obs).items()],
        F.avg(d).alias("bias"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.stddev_pop(d).alias("ubrmse"),
        F.sum(d * d).alias("_se"),
        F.var_pop(o).alias("_vo"),
        F.avg(s).alias("mean_sim"),
        F.avg(o).alias("mean_obs"),
        F.sum(s).alias("sum_sim"),
        F.sum(o).alias("sum_obs"),
        F.count_if((s >= wet) & (o >= wet)).alias("hits"),
        F.count_if((s < wet) & (o >= wet)).alias("misses"),
        F.count_if((s >= wet) & (o < wet)).alias("false_alarms"),
    )
    out = sums.withColumns({
        "rbias": F.when(F.col("mean_obs") > 0, 100 * F.col("bias") / F.col("mean_obs")),
        "kge": kge_of(),
        "nse": 1 - F.col("_se") / F.nullif(F.col("_vo") * F.col("n"), F.lit(0.0)),
        **_shares(),
    })
    names = ("r", "bias", "rbias", "rmse", "ubrmse", "alpha", "beta", "kge", "nse", "pod", "far", "csi", "mean_sim", "mean_obs", "sum_sim", "sum_obs")
    return out.select(*keys, "n", *[F.when(F.col("n") >= min_n, F.col(c)).alias(c) for c in names])


def skill(df: DataFrame, keys: Sequence[str], methods: Sequence[str], references: Sequence[str]) -> DataFrame:
    """n, r, rmse, ubrmse and bias by key, reference and method, from columns of values."""
    pairs = [F.struct(F.lit(m).alias("method"), F.lit(r).alias("reference"), F.col(m).alias("s"), F.col(r).alias("o")) for r in references for m in methods]
    rows = df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.*")
    s, o = _pairs(F.col("s"), F.col("o"))
    return rows.groupBy(*keys, "reference", "method").agg(
        F.count(s).alias("n"), corr(s, o).alias("r"), F.sqrt(F.avg((s - o) * (s - o))).alias("rmse"), F.stddev_pop(s - o).alias("ubrmse"), F.avg(s - o).alias("bias")
    )
