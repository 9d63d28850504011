"""Per-pixel regression, neighbour coefficients and gradient boosting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..sources.scratch import Scratch

#: Rows of a boosting that one task holds.
ROWS_A_TASK = 1 << 16


def ols_single(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 60) -> DataFrame:
    """slope, intercept and n_fit of y on x by key; no row for fewer than min_n pairs, NULL where x is constant."""
    both = df.dropna(subset=[x, y]).groupBy(*keys)
    out = both.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n_fit"))
    return out.where(F.col("n_fit") >= min_n)


#: Least ratio of a correlation matrix's eigenvalues, and of a matrix of products', above which predictors are independent.
INDEPENDENT, RANK = 1e-10, 1e-12


def _least_squares(mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Coefficients and intercept (rows) from means and covariances of predictors and target, for many keys at once."""
    p = mu.shape[1] - 1
    a, b = cov[:, :p, :p], cov[:, :p, p]
    scale = np.sqrt(np.einsum("kii->ki", a))
    scale[scale == 0] = 1.0
    w, v = np.linalg.eigh(a / (scale[:, :, None] * scale[:, None]))
    free = w[:, 0] > INDEPENDENT
    w[~free] = 1.0
    coef = np.einsum("kij,kj->ki", v, np.einsum("kji,kj->ki", v, b / scale) / w) / scale
    out = np.column_stack([coef, mu[:, p] - np.einsum("ki,ki->k", coef, mu[:, :p])])
    for k in np.flatnonzero(~free):
        # Collinear predictors: of all best fits that of least norm, the intercept counted in.
        m = np.append(mu[k, :p], 1.0)
        g = np.pad(a[k], (0, 1)) + np.outer(m, m)
        w1, v1 = np.linalg.eigh(g)
        keep = w1 > RANK * w1[-1]
        out[k] = v1[:, keep] @ ((v1[:, keep].T @ (np.append(b[k], 0.0) + mu[k, p] * m)) / w1[keep])
    return out


def ols_multi(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, min_n: int = 60) -> DataFrame:
    """Least squares with intercept on several predictors by key, of least norm if they are collinear: coef (array),
    intercept, n_fit; no row for fewer than min_n rows with all values.

    One aggregate takes means and covariances by key, partial before the shuffle; a row a key is solved, whatever the
    length of its series."""
    xs = list(xs)
    names = [*xs, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    full = df.dropna(subset=names).groupBy(*keys)
    sums = full.agg(F.count("*").alias("n_fit"), F.array(*[F.avg(c) for c in names]).alias("_mu"), F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("_cov"))
    sums = sums.where(F.col("n_fit") >= min_n)
    kinds = dict(df.dtypes)

    def solve(parts):
        for part in parts:
            if len(part):
                cov = np.empty((len(part), len(names), len(names)))
                for (i, j), c in zip(pairs, np.stack(part["_cov"].to_numpy()).T, strict=True):
                    cov[:, i, j] = cov[:, j, i] = c
                found = _least_squares(np.stack(part["_mu"].to_numpy()), cov)
                yield part[list(keys)].assign(coef=found[:, :-1].tolist(), intercept=found[:, -1], n_fit=part["n_fit"])

    return sums.mapInPandas(solve, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "coef array<double>", "intercept double", "n_fit long"]))


def predict(df: DataFrame, coefs: DataFrame, keys: Sequence[str], terms: dict[str, Column]) -> DataFrame:
    """Adds pred = intercept + sum of coefficient * predictor, not under 0; NULL where a predictor is missing. terms gives
    each predictor's coefficient as a column of coefs."""
    total = F.col("intercept")
    for x, c in terms.items():
        total = total + c * F.col(x)
    return df.join(coefs, list(keys)).withColumn("pred", clip(total, 0.0))


def neighbour_means(coefs: DataFrame, values: Sequence[str], i: str = "i", j: str = "j") -> DataFrame:
    """For every pixel the mean of its four neighbours' values and how many there are; none without a neighbour."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    sent = coefs.select("*", step.alias("_s")).select((F.col(i) + F.col("_s.a")).alias(i), (F.col(j) + F.col("_s.b")).alias(j), *values)
    means = sent.groupBy(i, j).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n_neighbors"))
    return coefs.select(i, j).join(means, [i, j])


def dominant_owner(bridge: DataFrame, cell: Sequence[str], owner: str = "code", area: str = "km2", order: str | None = None) -> DataFrame:
    """The owner of the largest overlap of every cell; ties to the first in order."""
    best = F.max_by(owner, F.struct(F.col(area), -F.col(order or owner)))
    return bridge.groupBy(*cell).agg(best.alias(owner))


def valid_rows(features: Sequence[str], positive: Sequence[str]) -> Column:
    """All features present and the products strictly positive."""
    keep = F.lit(True)
    for c in features:
        keep = keep & F.col(c).isNotNull()
    for c in positive:
        keep = keep & (F.col(c) > 0)
    return keep


def importances(df: DataFrame, features: Sequence[str], positive: Sequence[str], target: str, fit: Column, **settings) -> DataFrame:
    """feature and importance (their sum is 1) of the model that boosted fits, the greatest first."""
    _, fitted = _fitted(df, features, positive, target, fit, **settings)
    rows = sorted(zip(features, map(float, fitted.featureImportances.toArray()), strict=True), key=lambda r: -r[1])
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def _fitted(df: DataFrame, features: Sequence[str], positive: Sequence[str], target: str, fit: Column, trees: int = 500, rate: float = 0.03, seed: int = 42):
    assembled = VectorAssembler(inputCols=list(features), outputCol="_x")
    model = GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="_p", maxIter=trees, stepSize=rate, maxDepth=5, minInstancesPerNode=30, subsamplingRate=0.9, seed=seed)
    valid = df.where(valid_rows(features, positive))
    # Every level of every tree is a job over all partitions: they are as few as the rows call for, and what df is made
    # from is not read for them.
    with Scratch(df.sparkSession) as old:
        fitted = old.write(valid.where(fit & (F.col(target) > 0)).select(*{c: None for c in (*features, target)}), "boosting-rows")
        tasks = max(1, -(-fitted().count() // ROWS_A_TASK))
        return assembled.transform(valid), model.fit(assembled.transform(fitted().coalesce(tasks)))


def boosted(df: DataFrame, features: Sequence[str], positive: Sequence[str], target: str, fit: Column, trees: int = 500, rate: float = 0.03, seed: int = 42) -> DataFrame:
    """Adds pred of a gradient-boosted model fitted on valid rows with a positive target where fit holds; NULL in rows
    that are not valid. Trees grow by level, so results differ from leaf-wise libraries."""
    good = valid_rows(features, positive)
    rows, fitted = _fitted(df, features, positive, target, fit, trees, rate, seed)
    done = fitted.transform(rows).withColumn("pred", clip(F.col("_p"), 0.0)).drop("_x", "_p")
    return done.unionByName(df.where(~F.coalesce(good, F.lit(False))).withColumn("pred", F.lit(None).cast("double")))
