"""Shapes, attribute tables and cubes read by many tasks, from files written here."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThan
from test_io import dbf, shp

from confluo.operators import time
from confluo.sources import cubes, files, readers, shapes


def shx(data):
    """The index of an SHP file."""
    at, out = 100, b"\0" * 100
    while at < len(data):
        length = struct.unpack_from(">2i", data, at)[1]
        out += struct.pack(">2i", at // 2, length)
        at += 8 + 2 * length
    return out


@pytest.fixture
def many_polygons(tmp_path):
    box = lambda a, n: [(a, a), (a, a + n), (a + n, a + n), (a + n, a), (a, a)]
    data = shp([[box(float(k), 1.0 + k % 5), box(k + 0.2, 0.5)[::-1]] if k % 7 else [] for k in range(300)])
    (tmp_path / "b.shp").write_bytes(data)
    (tmp_path / "b.shx").write_bytes(shx(data))
    rows = [(b"*" if k % 50 == 3 else b" ", (f"{k:03d}", "한강")) for k in range(300)]
    (tmp_path / "b.dbf").write_bytes(dbf(rows, [("SBSN_CD", 6), ("NAME", 8)]))
    return tmp_path


def test_shapes_by_many_tasks(spark, many_polygons):
    path = str(many_polygons / "b.shp")
    want = sorted(readers.read_polygons(spark, path).select("record", "rings").collect(), key=lambda r: r.record)
    got = shapes.load(spark, "shp", path, bytes_per_task=4000)
    size = files.size_of(path)
    assert got.rdd.getNumPartitions() == -(-size // 4000) > 10
    assert sorted(got.select("record", "rings").collect(), key=lambda r: r.record) == want and len(want) == 300
    (many_polygons / "b.shx").unlink()
    alone = shapes.load(spark, "shp", str(many_polygons), bytes_per_task=4000)
    assert alone.rdd.getNumPartitions() == 1
    assert sorted(alone.select("record", "rings").collect(), key=lambda r: r.record) == want


def test_attributes_by_many_tasks(spark, many_polygons):
    path = str(many_polygons / "b.dbf")
    got = shapes.load(spark, "dbf", f"file:{path}", bytes_per_task=500)
    assert got.rdd.getNumPartitions() > 5
    key = lambda r: r.record
    assert sorted(got.select("record", "fields").collect(), key=key) == sorted(readers.read_dbf(spark, path).select("record", "fields").collect(), key=key)
    some = shapes.basins(spark, str(many_polygons / "b"), bytes_per_task=1000).collect()
    assert len(some) == 294 and {len(r.rings) for r in some} == {0, 2} and "003" not in {r.code for r in some}


def test_no_such_file(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFound"):
        shapes.load(spark, "shp", str(tmp_path / "none.shp")).count()


# Cubes


def padded(b):
    return b + b"\0" * (-len(b) % 4)


def classic(path, dims, variables, version=1, unlimited=None):
    """A classic file: dims (name: size), variables (name: dims, array, attributes); unlimited is the record dimension."""
    count, offset = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")
    number = lambda n, form=count: struct.pack(form, n)
    name = lambda s: number(len(s.encode())) + padded(s.encode())
    kinds = {"i2": 3, "i4": 4, "f4": 5, "f8": 6}

    def attributes(some):
        out = number(12 if some else 0, ">i") + number(len(some))
        for k, v in some.items():
            out += name(k) + (number(2, ">i") + number(len(v.encode())) + padded(v.encode()) if isinstance(v, str) else number(6, ">i") + number(1) + struct.pack(">d", v))
        return out

    ids = list(dims)
    records = next((a.shape[0] for d, a, _ in variables.values() if d[:1] == (unlimited,)), 0)
    size = lambda d, a: -(-a[0 : 1 if d[:1] == (unlimited,) else None].nbytes // 4) * 4
    lone = sum(d[:1] == (unlimited,) for d, _, _ in variables.values()) == 1

    def head(begins):
        out = b"CDF" + bytes([version]) + number(records) + number(10, ">i") + number(len(dims))
        out += b"".join(name(k) + number(0 if k == unlimited else n) for k, n in dims.items()) + attributes({"title": "made"})
        out += number(11, ">i") + number(len(variables))
        for (k, (d, a, more)), begin in zip(variables.items(), begins, strict=True):
            out += name(k) + number(len(d)) + b"".join(number(ids.index(x)) for x in d) + attributes(more)
            out += number(kinds[a.dtype.str[1:]], ">i") + number(size(d, a)) + number(begin, offset)
        return out

    at, begins = len(head([0] * len(variables))), []
    for d, a, _ in variables.values():
        if d[:1] != (unlimited,):
            begins.append(at)
            at += size(d, a)
        else:
            begins.append(None)
    for k, (d, a, _) in enumerate(variables.values()):
        if begins[k] is None:
            begins[k] = at
            at += size(d, a)
    big = lambda a: a.astype(a.dtype.newbyteorder(">")).tobytes()
    data = head(begins) + b"".join(padded(big(a)) for d, a, _ in variables.values() if d[:1] != (unlimited,))
    for r in range(records):
        data += b"".join((lambda x: x if lone else padded(x))(big(a[r : r + 1])) for d, a, _ in variables.values() if d[:1] == (unlimited,))
    path.write_bytes(data)


LAT, LON, DAYS = np.array([38.0, 37.5, 37.0, 36.5]), np.array([126.0, 126.5, 127.0]), np.arange(40, dtype="f8")


def field(seed=0, shape=(40, 4, 3)):
    v = np.random.default_rng(seed).uniform(-1, 9, shape).astype("f4")
    v.flat[::11] = -9999.9
    v.flat[5] = np.nan
    return v


def wanted(v, lat=LAT, lon=LON):
    """Rows of a cube of time, lat, lon: by (day, i, j)."""
    i_of, j_of = {x: i for i, x in enumerate(sorted(lat))}, {x: j for j, x in enumerate(sorted(lon))}
    out = {}
    for (t, a, b), x in np.ndenumerate(v):
        day = dt.date(2021, 1, 1) + dt.timedelta(days=t)
        out[day, i_of[lat[a]], j_of[lon[b]]] = (lat[a], lon[b], None if not x >= 0 else float(x))
    return out


def rows(df):
    got = {(r.day, r.i, r.j): (r.lat, r.lon, r.v) for r in df.collect()}
    assert len(got) == df.count()
    return got


@pytest.mark.parametrize(("version", "unlimited"), [(1, None), (2, "time"), (5, "time")])
def test_cube(spark, tmp_path, version, unlimited):
    v = field()
    time = {"units": "days since 2021-01-01 00:00:00"}
    some = {"latitude": (("latitude",), LAT, {}), "longitude": (("longitude",), LON, {}), "time": (("time",), DAYS, time), "tp": (("time", "latitude", "longitude"), v, {"_FillValue": -9999.9, "units": "mm"})}
    classic(tmp_path / "a.nc", {"latitude": 4, "longitude": 3, "time": 40}, some, version, unlimited)
    got = cubes.load(spark, str(tmp_path / "a.nc"), bytes_per_task=700)
    assert got.rdd.getNumPartitions() > 2 and got.first().variable == "tp"
    assert rows(got) == wanted(v)
    some = got.where((F.col("day") >= dt.date(2021, 1, 20)) & (F.col("day") < dt.date(2021, 2, 3)) & (F.col("lat") <= 37.2) & (F.col("lon") > 126.2))
    assert rows(some) == {k: x for k, x in wanted(v).items() if dt.date(2021, 1, 20) <= k[0] < dt.date(2021, 2, 3) and x[0] <= 37.2 and x[1] > 126.2}
    assert cubes.load(spark, str(tmp_path / "a.nc"), negatives="kept").where("v < 0").count() > 0


def test_filters_choose_what_is_read(tmp_path):
    """Before Spark filters, the reader gives only the box and days; and it reads few bytes of the file."""
    v = np.ones((40, 40, 30), "f4")
    lat, lon = np.linspace(38, 34, 40), np.linspace(126, 129, 30)
    some = {"lat": (("y", "x"), np.repeat(lat[:, None], 30, 1), {}), "lon": (("y", "x"), np.repeat(lon[None], 40, 0), {}), "time": (("time",), DAYS * 24, {"units": "hours since 2021-01-01"}), "sm": (("time", "y", "x"), v, {})}
    classic(tmp_path / "a.nc", {"y": 40, "x": 30, "time": 40}, some)
    reader = cubes.CubeReader({"path": str(tmp_path / "a.nc")})
    filters = [GreaterThanOrEqual(("day",), dt.date(2021, 1, 30)), LessThan(("lat",), 34.3), GreaterThanOrEqual(("lon",), 128.0), GreaterThanOrEqual(("v",), 0.5)]
    assert list(reader.pushFilters(filters)) == filters
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == 11 * int((lat < 34.3).sum()) * int((lon >= 128).sum())
    assert {r["i"] for r in got} == {0, 1, 2} and min(r["j"] for r in got) == int((lon < 128).sum())

    class Counted:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, n):
            self.n += n
            return self.f.read(n)

        def seek(self, at):
            self.f.seek(at)

    with files.opened(str(tmp_path / "a.nc")) as f:
        c, counted = cubes.cube(f, cubes.header(f), "sm"), Counted(f)
        list(reader._rows("a", counted, c, 0, 1))
    assert counted.n == 4 * len(got)


def test_variable_by_part_of_its_name_in_any_order_of_dimensions(spark, tmp_path):
    v = field(3)
    some = {"x": (("x",), LON, {}), "y": (("y",), LAT, {}), "time": (("time",), DAYS * 86400, {"units": "seconds since 2021-01-01T00:00:00Z"})}
    some |= {"idw_asos": (("y", "x", "time"), np.ascontiguousarray(np.transpose(field(4), (1, 2, 0))), {"missing_value": -9999.9}), "idw_AWS": (("x", "time", "y"), np.ascontiguousarray(np.transpose(v, (2, 0, 1))), {"missing_value": -9999.9})}
    for name in ("a.nc", "b.nc"):
        classic(tmp_path / name, {"x": 3, "y": 4, "time": 40}, some)
    got = cubes.load(spark, str(tmp_path), "aws")
    assert got.select("file", "variable").distinct().count() == 2 and got.rdd.getNumPartitions() == 1
    assert rows(got.where(F.col("file").endswith("a.nc"))) == wanted(v)
    assert rows(cubes.load(spark, str(tmp_path / "a.nc"), "aso")) == wanted(field(4))
    with pytest.raises(Exception, match="no variable"):
        cubes.load(spark, str(tmp_path), "era5").count()


def test_packed_values_and_other_formats(spark, tmp_path):
    raw = np.arange(-3, 9, dtype="i2").reshape(1, 4, 3)
    some = {"lat": (("lat",), LAT, {}), "lon": (("lon",), LON, {}), "precipitation": (("time", "lat", "lon"), raw, {"scale_factor": 0.5, "add_offset": 1.0, "_FillValue": 4.0})}
    classic(tmp_path / "p.nc", {"lat": 4, "lon": 3, "time": 1}, some, 2, "time")
    got = sorted(r.v if r.v is not None else -1 for r in cubes.load(spark, str(tmp_path / "p.nc")).collect())
    assert got == [-1, -1, 0, 0.5, 1, 1.5, 2, 2.5, 3.5, 4, 4.5, 5]
    (tmp_path / "h.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
    with pytest.raises(Exception, match="not a classic"):
        cubes.load(spark, str(tmp_path / "h.nc")).count()


def test_day_files_of_running_totals(spark, tmp_path):
    """Two day files in metres to hourly amounts in a box; the last hour comes from the next day's first total."""
    hourly = np.random.default_rng(8).uniform(0, 3, (48, 4, 3))
    for d in (0, 1):
        total = np.empty((24, 4, 3))
        for h in range(24):
            total[h] = hourly[24 * d : 24 * d + h].sum(0) if h else (hourly[:24].sum(0) if d else 0)
        some = {"latitude": (("latitude",), LAT, {}), "longitude": (("longitude",), LON, {}), "time": (("time",), np.arange(24.0) + 24 * d, {"units": "hours since 2021-01-01"}), "tp": (("time", "latitude", "longitude"), total / 1000, {})}
        classic(tmp_path / f"day{d}.nc", {"latitude": 4, "longitude": 3, "time": 24}, some, 2, "time")
    rows = cubes.accumulated_hours(spark, str(tmp_path), (36.9, 37.6), (126.4, 127.1))
    got = {((r.day - dt.date(2021, 1, 1)).days * 24 + r.hour, r.i, r.j): r.amount for r in time.deaccumulate(rows, ["i", "j"], "mm").collect()}
    assert len(got) == 48 * 2 * 2 and {k[1:] for k in got} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    for (h, i, j), x in got.items():
        assert x is None if h == 47 else abs(x - hourly[h, 3 - i, j]) < 1e-6
