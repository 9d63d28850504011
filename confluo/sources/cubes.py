"""Data source `cube`: variables of classic NetCDF files as long rows, by slabs of time, with days and a box pushed down."""

from __future__ import annotations

import datetime as dt
import itertools
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import files

#: Bytes of files that one task reads, about.
BYTES_A_TASK = 32 << 20
#: Values that become rows at once.
VALUES_AT_ONCE = 1 << 18
# The format's external types.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
SCHEMA = "file string, variable string, time timestamp_ntz, day date, i int, j int, lat double, lon double, v double"
ROWS = pa.schema([("file", pa.string()), ("variable", pa.string()), ("time", pa.timestamp("us")), ("day", pa.date32()), ("i", pa.int32()), ("j", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("v", pa.float64())])
UNITS = {"sec": 1, "min": 60, "hou": 3600, "day": 86400}


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    attributes: dict
    dtype: np.dtype
    begin: int
    #: Bytes from one record to the next, for a variable along the record dimension.
    stride: int | None = None


class Short(Exception):
    """The header goes on beyond the bytes given."""


class Header:
    """Dimensions and variables of a classic file: 32-bit, 64-bit offsets or 64-bit data."""

    def __init__(self, data: bytes, size: int):
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.data, self.at = data, 4
        self.count = ">q" if data[3] == 5 else ">i"
        self.offset = ">i" if data[3] == 1 else ">q"
        records = self._number(self.count)
        dims = [(self._name(), self._number(self.count)) for _ in self._list()]
        self.attributes = self._attributes()
        self.variables: dict[str, Variable] = {}
        along = []
        for _ in self._list():
            name = self._name()
            ids = [self._number(self.count) for _ in range(self._number(self.count))]
            attributes = self._attributes()
            dtype = np.dtype(TYPES[self._number(">i")])
            length, begin = self._number(self.count), self._number(self.offset)
            v = self.variables[name] = Variable(name, tuple(dims[i][0] for i in ids), tuple(dims[i][1] for i in ids), attributes, dtype, begin)
            if ids and dims[ids[0]][1] == 0:
                along.append((v, length))
        # One variable alone is stored without padding between its records.
        stride = along[0][0].dtype.itemsize * int(np.prod(along[0][0].shape[1:])) if len(along) == 1 else sum(n for _, n in along)
        if along and records < 0:
            records = max(0, size - min(v.begin for v, _ in along)) // max(stride, 1)
        for v, _ in along:
            v.stride, v.shape = stride, (records, *v.shape[1:])

    def _take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Short
        self.at += n
        return self.data[self.at - n : self.at]

    def _number(self, form: str) -> int:
        return struct.unpack(form, self._take(struct.calcsize(form)))[0]

    def _padded(self, n: int) -> bytes:
        return self._take(-(-n // 4) * 4)[:n]

    def _name(self) -> str:
        return self._padded(self._number(self.count)).decode()

    def _list(self) -> range:
        self._number(">i")
        return range(self._number(self.count))

    def _attributes(self) -> dict:
        out = {}
        for _ in self._list():
            name, kind, n = self._name(), self._number(">i"), self._number(self.count)
            raw = self._padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
        return out


def header(f: pa.NativeFile) -> Header:
    size, n = f.size(), 1 << 16
    while True:
        f.seek(0)
        try:
            return Header(f.read(n), size)
        except Short:
            if n >= size:
                raise ValueError("the header is cut off") from None
            n *= 4


def slab(f: pa.NativeFile, v: Variable, ranges: Sequence[tuple[int, int]]) -> np.ndarray:
    """The values in a range (from, to) of each dimension: one read for each stretch that lies together in the file."""
    shape = [b - a for a, b in ranges]
    out = np.empty(shape, v.dtype.newbyteorder("="))
    if not out.size:
        return out
    lead = 1 if v.stride is not None else 0
    k = len(shape)
    while k > lead and all(r == (0, n) for r, n in zip(ranges[k:], v.shape[k:], strict=True)):
        k -= 1
    # Dimensions before k are walked; at k a range is contiguous, and all after it are whole.
    step = [int(np.prod(v.shape[d + 1 :])) * v.dtype.itemsize for d in range(len(shape))]
    if lead:
        step[0] = v.stride
    together = int(np.prod(shape[k:])) if k < len(shape) else 1
    flat = out.reshape(-1)
    for n, at in enumerate(itertools.product(*[range(a, b) for a, b in ranges[:k]])):
        place = v.begin + sum(i * s for i, s in zip(at, step, strict=False)) + (ranges[k][0] * step[k] if k < len(shape) else 0)
        f.seek(place)
        flat[n * together : (n + 1) * together] = np.frombuffer(f.read(together * v.dtype.itemsize), v.dtype)
    return out


def whole(f: pa.NativeFile, v: Variable) -> np.ndarray:
    return slab(f, v, [(0, n) for n in v.shape])


def moments(v: Variable, values: np.ndarray) -> np.ndarray:
    """Times of a time axis, in microseconds since 1970, by its units (`days since 2021-01-01`)."""
    unit, _, since = v.attributes.get("units", "days since 1970-01-01").partition(" since ")
    since = since.strip().replace("T", " ").removesuffix("Z").removesuffix(" UTC").split(".")[0]
    day, _, clock = since.partition(" ")
    base = dt.datetime(*map(int, day.split("-"))) + dt.timedelta(seconds=sum(int(x) * s for x, s in zip(clock.split(":"), (3600, 60, 1), strict=False) if x))
    start = np.int64((base - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1))
    return start + np.rint(values.astype(float) * UNITS[unit.strip().lower()[:3]] * 1e6).astype(np.int64)


@dataclass
class Cube:
    """A variable with its axes: names of dimensions, ascending coordinates, and their places in the file."""

    variable: Variable
    time: str
    lat: str
    lon: str
    axes: dict[str, np.ndarray] = field(default_factory=dict)
    reverse: dict[str, bool] = field(default_factory=dict)


def cube(f: pa.NativeFile, head: Header, wanted: str | None) -> Cube:
    """The first variable with three dimensions whose name holds wanted, and its axes. Dimensions are known by their names
    (lat or y, lon or x, time), or else the longest is time; two-dimensional coordinates give their first column or row."""
    some = [v for v in head.variables.values() if sum(n != 1 for n in v.shape) <= 3 and len(v.shape) >= 3 and (wanted or "").lower() in v.name.lower()]
    if not some:
        raise ValueError(f"no variable of three dimensions named like {wanted!r}; there are {sorted(head.variables)}")
    v = some[0]
    names = {"lat": lambda d: "lat" in d or d == "y", "lon": lambda d: "lon" in d or d == "x", "time": lambda d: "time" in d}
    dims = {kind: next((d for d in v.dims if is_it(d.lower())), None) for kind, is_it in names.items()}
    if None in dims.values():
        by_size = dict(zip(v.dims, v.shape, strict=True))
        rest = [d for d in v.dims if d != max(by_size, key=by_size.get)][-2:]
        dims = {"time": max(by_size, key=by_size.get), "lat": rest[0], "lon": rest[1]}
    out = Cube(v, **dims)
    for kind, d in dims.items():
        n = v.shape[v.dims.index(d)]
        exact = [c for c in head.variables.values() if c.name.lower() == d.lower()]
        near = [c for c in head.variables.values() if kind in c.name.lower() and c is not v and len(c.shape) <= 3]
        axis = np.arange(n, dtype=float)
        for c in exact + near:
            got = np.squeeze(whole(f, c))
            got = got if got.ndim < 2 else got[:, 0] if kind == "lat" else got[0]
            if got.size == n:
                axis = moments(c, got.reshape(-1)) if kind == "time" else got.reshape(-1).astype(float)
                break
        out.reverse[kind] = kind != "time" and n > 1 and axis[0] > axis[-1]
        out.axes[kind] = axis[::-1] if out.reverse[kind] else axis
    return out


@dataclass
class Share(InputPartition):
    """Parts (file, k, n): the k-th of n equal shares of a file's times."""

    parts: list[tuple[str, int, int]]


class CubeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.variable = options["path"], options.get("variable")
        self.per_task = int(options.get("bytes_per_task", BYTES_A_TASK))
        self.keep_negative = options.get("negatives", "missing") != "missing"
        self.limits: dict[str, list[tuple[str, object]]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Limits of day, time, lat and lon choose what is read; Spark still applies all filters to the rows."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in signs and f.attribute in (("day",), ("time",), ("lat",), ("lon",)):
                self.limits.setdefault(f.attribute[0], []).append((signs[type(f)], f.value))
            yield f

    def _kept(self, column: str, values: np.ndarray) -> np.ndarray:
        keep = np.ones(len(values), bool)
        for sign, limit in self.limits.get(column, []):
            if sign == "in":
                keep &= np.isin(values, [_plain(x, values) for x in limit if x is not None])
            else:
                x = _plain(limit, values)
                keep &= {"=": values == x, ">": values > x, ">=": values >= x, "<": values < x, "<=": values <= x}[sign]
        return keep

    def partitions(self) -> Sequence[InputPartition]:
        """Planning lists files and their sizes: a large file is several tasks, small ones share a task."""
        out, held = [], 0
        for file, size in files.found(self.path, ".nc"):
            n = max(1, -(-size // self.per_task))
            if n > 1:
                out += [Share([(file, k, n)]) for k in range(n)]
            elif out and held and held + size <= self.per_task:
                out[-1].parts.append((file, 0, 1))
                held += size
            else:
                out.append(Share([(file, 0, 1)]))
                held = size
            held = 0 if n > 1 else held
        return out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for file, k, n in partition.parts:
            with files.opened(file) as f:
                yield from self._rows(file, f, cube(f, header(f), self.variable), k, n)

    def _rows(self, file: str, f: pa.NativeFile, c: Cube, k: int, n: int) -> Iterator[pa.RecordBatch]:
        times = c.axes["time"].astype("datetime64[us]")
        keep = self._kept("time", times) & self._kept("day", times.astype("datetime64[D]"))
        share = np.flatnonzero(keep[len(times) * k // n : len(times) * (k + 1) // n]) + len(times) * k // n
        at = {kind: np.flatnonzero(self._kept(kind, c.axes[kind])) for kind in ("lat", "lon")}
        if not all(len(x) for x in (share, *at.values())):
            return
        v, attributes = c.variable, c.variable.attributes
        spans = {}
        for kind, places in at.items():
            low, high, size = int(places[0]), int(places[-1]) + 1, len(c.axes[kind])
            spans[getattr(c, kind)] = (size - high, size - low) if c.reverse[kind] else (low, high)
        missing = [x for name in ("_FillValue", "missing_value") for x in _listed(attributes.get(name))]
        scale, shift = (_listed(attributes.get(name)) or [d] for name, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
        area = [int(p[-1] - p[0] + 1) for p in at.values()]
        step = max(1, VALUES_AT_ONCE // (area[0] * area[1]))
        runs = np.split(share, np.flatnonzero(np.diff(share) != 1) + 1)
        for a, b in ((int(r[i]), int(r[min(i + step, len(r)) - 1]) + 1) for r in runs for i in range(0, len(r), step)):
            raw = slab(f, v, [(a, b) if d == c.time else spans.get(d, (0, 1)) for d in v.dims])
            order = [v.dims.index(d) for d in (c.time, c.lat, c.lon)]
            raw = np.transpose(raw, order + [d for d in range(raw.ndim) if d not in order]).reshape(b - a, *area)
            for axis, kind in enumerate(("lat", "lon"), 1):
                raw = np.flip(raw, axis) if c.reverse[kind] else raw
            gone = np.isin(raw, missing) if missing else np.zeros(raw.shape, bool)
            values = raw.astype(float) * scale[0] + shift[0]
            gone |= ~np.isfinite(values) | ((values < 0) & (not self.keep_negative))
            whole_axes = {kind: np.arange(p[0], p[-1] + 1) for kind, p in at.items()}
            t, i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(a, b), whole_axes["lat"], whole_axes["lon"], indexing="ij"))
            kept = np.isin(i, at["lat"]) & np.isin(j, at["lon"])
            t, i, j = t[kept], i[kept], j[kept]
            moment = times[t]
            columns = [
                pa.repeat(file, len(t)),
                pa.repeat(v.name, len(t)),
                pa.array(moment),
                pa.array(moment.astype("datetime64[D]")),
                pa.array(i.astype(np.int32)),
                pa.array(j.astype(np.int32)),
                pa.array(c.axes["lat"][i]),
                pa.array(c.axes["lon"][j]),
                pa.array(values.reshape(-1)[kept], mask=gone.reshape(-1)[kept]),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=ROWS)


def _plain(x, values: np.ndarray):
    return np.datetime64(x).astype(values.dtype) if values.dtype.kind == "M" else x


def _listed(x) -> list:
    return [] if x is None or isinstance(x, str) else list(x)


class CubeSource(DataSource):
    """`spark.read.format("cube").option("variable", "aws").load(path)`, path a file or a folder of .nc files."""

    @classmethod
    def name(cls) -> str:
        return "cube"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CubeReader(dict(self.options))


def load(spark: SparkSession, path: str, variable: str | None = None, **options) -> DataFrame:
    """Rows (file, variable, time, day, i, j, lat, lon, v) of the first variable of three dimensions whose name holds
    `variable`; i and j count along ascending lat and lon.

    Fill values, NaN and (unless negatives="kept") negatives are null. A file is read in shares of its times, about
    bytes_per_task each; comparisons of day, time, lat and lon with values choose the times, rows and columns that are read
    from the file. A time dimension of any place in the variable is taken. Files of other formats fail.
    """
    spark.dataSource.register(CubeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("cube").options(**({"variable": variable} if variable else {}), **options).load(path)


def accumulated_hours(spark: SparkSession, path: str, lat: tuple[float, float], lon: tuple[float, float], variable: str = "tp", **options) -> DataFrame:
    """Running totals of a day's hours in a box, from day files in metres: i, j, lat, lon, day, hour, mm, ready for
    `operators.time.deaccumulate`, which takes hours that don't follow each other as missing. Only the box is read."""
    rows = load(spark, path, variable, **options).where(F.col("lat").between(*lat) & F.col("lon").between(*lon))
    return rows.select("i", "j", "lat", "lon", "day", F.hour("time").alias("hour"), (F.col("v") * 1000).alias("mm"))
