"""Readers of the foreign formats: station CSVs, DBF attribute tables and SHP polygons."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DBF = "file string, record int, fields map<string,string>"
SHP = "file string, record int, rings array<struct<is_hole: boolean, shell: int, pts: array<struct<x: double, y: double>>>>"


def csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8", columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with a header under an explicit schema; columns prunes the scan."""
    df = spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE").schema(schema).csv(path)
    return df.select(*columns) if columns else df


def recode(column: F.Column, encoding: str = "cp949") -> F.Column:
    """Text of an encoding that Spark's CSV reader lacks, in a column read as iso-8859-1; what isn't in that encoding is
    taken as UTF-8."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            if v is None:
                return None
            raw = v.encode("latin-1")
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                return raw.decode("utf-8", "replace")

        return s.map(one)

    return decode(column)


def gauges(spark: SparkSession, path: str) -> DataFrame:
    """Hourly gauge rain; times that don't parse are NULL. Only the header can hold other characters than digits, and the
    schema is given, so the bytes are read as they are."""
    raw = csv(spark, path, "ts string, station int, lat double, lon double, rain double", "iso-8859-1")
    return raw.withColumn("ts", F.expr("try_to_timestamp(ts)").cast("timestamp_ntz"))


def with_stations(daily: DataFrame, meta: DataFrame) -> DataFrame:
    """Station coordinates joined on; stations without any keep NULLs."""
    return daily.join(meta, "station", "left")


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key, the first in order: a deterministic drop of duplicates."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def by_year(spark: SparkSession, path: str, years: Sequence[int], day_before: bool = False) -> DataFrame:
    """A table parted by year, pruned to years; day_before adds 31 December of the year before the first."""
    df = spark.read.parquet(path)
    keep = F.col("year").isin(list(years))
    if day_before:
        keep = keep | ((F.col("year") == min(years) - 1) & (F.month("day") == 12) & (F.dayofmonth("day") == 31))
    return df.where(keep)


def start_of_file(path: F.Column, pattern: str = r"(\d{8}-S\d{6})", form: str = "yyyyMMdd'-S'HHmmss") -> F.Column:
    """UTC start time in a file's name."""
    return F.to_timestamp_ntz(F.regexp_extract(path, pattern, 1), F.lit(form))


def dbf_fields(head: bytes) -> list[tuple[str, int]]:
    """Name and width of every field, from an attribute table's head."""
    fields, at = [], 32
    while head[at] != 0x0D:
        fields.append((head[at : at + 11].split(b"\0")[0].decode("ascii"), head[at + 16]))
        at += 32
    return fields


def dbf_row(record: bytes, fields: Sequence[tuple[str, int]], encoding: str) -> dict[str, str]:
    row, at = {}, 1
    for name, width in fields:
        row[name] = record[at : at + width].decode(encoding, "replace").strip()
        at += width
    return row


def _dbf_rows(data: bytes, encoding: str) -> Iterator[tuple[int, dict[str, str]]]:
    """Number and fields of every record that isn't deleted."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields = dbf_fields(data)
    for k in range(count):
        record = data[head + k * size : head + (k + 1) * size]
        if record[:1] != b"*":
            yield k, dbf_row(record, fields, encoding)


def read_dbf(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Attribute tables, one row a record that isn't deleted: file, record (from 0), fields. A file is a task's unit of
    work, read by Spark from whatever store it knows; `shapes` reads a file in many tasks."""

    def parse(parts):
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                rows = [(file, i, r) for i, r in _dbf_rows(data, encoding)]
                yield pd.DataFrame(rows, columns=["file", "record", "fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, DBF)


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False)) / 2


def rings_of(content: bytes) -> list[dict]:
    """The rings of one record; none for other shapes."""
    if len(content) < 44 or struct.unpack_from("<i", content)[0] % 10 != 5:
        return []
    n_parts, n_points = struct.unpack_from("<2i", content, 36)
    firsts = [*struct.unpack_from(f"<{n_parts}i", content, 44), n_points]
    flat = struct.unpack_from(f"<{2 * n_points}d", content, 44 + 4 * n_parts)
    points = list(zip(flat[::2], flat[1::2], strict=True))
    rings = [points[a:b] for a, b in zip(firsts, firsts[1:], strict=False)]
    # Shells run clockwise, holes the other way round; the repeated last point is left out, as are rings of no area.
    return assigned_rings([r for r in rings if len(r) >= 4 and _area(r) != 0])


def _polygons(data: bytes) -> Iterator[list[dict]]:
    at = 100
    while at + 8 <= len(data):
        length = struct.unpack_from(">i", data, at + 4)[0] * 2
        yield rings_of(data[at + 8 : at + 8 + length])
        at += 8 + length


def _holds(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    crossed = [(x2 - x1) * (y - y1) / (y2 - y1) + x1 > x for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False) if (y1 > y) != (y2 > y)]
    return sum(crossed) % 2 == 1


def _within(ring: list[tuple[float, float]]) -> tuple[float, float]:
    """A place within a closed ring: half way between the first two crossings of a level line, which meets no corner."""
    levels = sorted({y for _, y in ring})
    y = max(((a + b) / 2 for a, b in zip(levels, levels[1:], strict=False)), key=lambda m: min(abs(m - v) for v in levels))
    cuts = sorted((x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False) if (y1 > y) != (y2 > y))
    return (cuts[0] + cuts[1]) / 2, y


def assigned_rings(rings: list[list[tuple[float, float]]]) -> list[dict]:
    """Closed rings with is_hole and shell: a hole's is the place of the smallest shell that holds a place within the hole;
    a hole in no shell is a shell itself. A shell's is its own place."""
    shells = [k for k, r in enumerate(rings) if _area(r) < 0]
    out = []
    for k, r in enumerate(rings):
        inner = _within(r) if _area(r) > 0 else None
        around = [s for s in shells if inner and abs(_area(rings[s])) > abs(_area(r)) and _holds(rings[s], *inner)]
        shell = min(around, key=lambda s: abs(_area(rings[s])), default=k)
        out.append({"is_hole": shell != k, "shell": shell, "pts": [{"x": x, "y": y} for x, y in r[:-1]]})
    return out


def shx_offsets(data: bytes) -> list[tuple[int, int]]:
    """Byte offset and length of every record of an SHP file, from its SHX index."""
    words = [struct.unpack_from(">2i", data, at) for at in range(100, len(data) - 7, 8)]
    return [(2 * offset, 2 * length) for offset, length in words]


def wide_csv(spark: SparkSession, path: str, row: str = "date", column: str = "code", value: str = "v", keep: Sequence[str] | None = None) -> DataFrame:
    """A wide CSV (a column for each basin) as rows (row, column, value); keep prunes its columns, empty fields stay NULL."""
    names = [c for c in csv_columns(spark, path) if c != row]
    df = spark.read.option("header", True).schema(", ".join(f"`{c}` {'string' if c == row else 'double'}" for c in csv_columns(spark, path))).csv(path)
    return df.select(F.to_date(row).alias(row), *[F.col(f"`{c}`") for c in names if keep is None or c in keep]).unpivot(row, [F.col(f"`{c}`") for c in names if keep is None or c in keep], column, value)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header's columns; no row is read."""
    return spark.read.option("header", True).csv(path).columns


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of SHP files, one row a record: file, record (from 0), rings (a hole with its shell); other shapes have
    none. A file is a task's unit of work."""

    def parse(parts):
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(file, i, r) for i, r in enumerate(_polygons(data))], columns=["file", "record", "rings"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, SHP)


def read_basins(spark: SparkSession, stem: str, code_field: str = "SBSN_CD", encoding: str = "utf-8") -> DataFrame:
    """code and rings of stem.shp and stem.dbf, joined on the record's place."""
    attributes = read_dbf(spark, f"{stem}.dbf", encoding).select("record", F.col("fields")[code_field].alias("code"))
    return read_polygons(spark, f"{stem}.shp").select("record", "rings").join(attributes, "record").select("code", "rings")
