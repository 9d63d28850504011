"""Every query with SQL gives the SQL's rows in DuckDB."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from confluo.functions.scalars import exact_mean
from confluo.operators import regress
from confluo.plans import registry

registry.load()


def plain(v):
    if isinstance(v, datetime.datetime | datetime.date):
        return str(v)[:10]
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(a - b) <= 2e-3 * max(1, abs(a)) or a == b
    return a == b


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    df = registry.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert all(all(map(close, a, b)) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf_dir, name):
    registry.QUERIES[name](spark, sf_dir).collect()


@pytest.mark.parametrize(("name", "more"), [("gbt_bias_correct", []), ("gbt_gauge_fusion", ["aws"])])
def test_boosting_has_all_trees_and_features(spark, sf_dir, name, more):
    fits, real = [], regress.GBTRegressor.fit

    def fit(self, rows):
        fits.append((self.getMaxIter(), self.getStepSize(), rows.count()))
        fits.append(real(self.setMaxIter(2), rows))
        return fits[-1]

    with pytest.MonkeyPatch.context() as m:
        m.setattr(regress.GBTRegressor, "fit", fit)
        got = registry.QUERIES[name](spark, sf_dir).collect()
    assert fits[0][:2] == (500, 0.03) and fits[0][2] > 0
    products = ["sm2rain", "era5", "gpm", "tca"]
    features = [*products, "lon", "lat", *more]
    assert fits[1].numFeatures == len(features) and any(r.pred is not None for r in got)
    assert all((r.pred is not None) == (all(r[c] is not None for c in features) and all(r[c] > 0 for c in products)) for r in got)


def test_flagship(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_a_mean_on_a_bins_edge_does_not_depend_on_the_order(spark, tmp_path):
    rows = [(38, 6), (46, 2), (28, 8), (36, 4), (4, 1), (11, 4), (43, 0), (40, 3), (26, 7), (46, 9), (30, 2), (20, 9), (36, 6), (48, 6), (16, 2), (4, 7), (12, 4), (23, 10), (23, 3), (45, 9), (4, 3), (4, 2), (34, 2), (8, 1), (32, 3)]
    assert sum(q * (100 - d) for q, d in rows) == 25 * 100 * len(rows)
    line = "l_suppkey long, l_shipdate timestamp, l_quantity double, l_discount double, l_tax double"
    day = datetime.datetime(1996, 3, 28)
    for k, some in enumerate((rows, rows[::-1], sorted(rows))):
        spark.createDataFrame([(3, day, float(q), d / 100, 0.0) for q, d in some], line).coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        assert [tuple(r) for r in registry.QUERIES["hist2d"](spark, f"{tmp_path}/{k}").select("bx", "by_", "n").collect()] == [(5, 5, 1)]


def test_exact_means(spark):
    for v in ([0.1] * 10, [1e9 + 0.1, -1e9, 0.3], [None, 2.5, None], [None], [-0.1, -0.2, 1e-3], [1e300, 1e300], [float("inf"), 1.0]):
        known = [x for x in v if x is not None]
        got = spark.createDataFrame([(x,) for x in v], "v double").agg(exact_mean(F.col("v"))).first()[0]
        assert got == (math.fsum(known) / len(known) if known else None)


def test_boosting_reads_its_rows_from_few_partitions(spark, sf_dir):
    seen, real = [], regress.GBTRegressor.fit

    def fit(self, rows):
        seen.append((rows.rdd.getNumPartitions(), [f for f in rows.inputFiles() if "events" in f]))
        return real(self.setMaxIter(1), rows)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(regress.GBTRegressor, "fit", fit)
        registry.QUERIES["gbt_bias_correct"](spark, sf_dir).collect()
    assert seen == [(1, [])]
