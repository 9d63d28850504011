"""Data sources `shp` and `dbf`: a file is read by many tasks, each a range of records."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files, readers

#: Bytes of a file that one task reads, about; and of records that are read and turned into rows at once.
BYTES_A_TASK, BYTES_AT_ONCE = 32 << 20, 4 << 20
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
RINGS = pa.list_(pa.struct([("is_hole", pa.bool_()), ("shell", pa.int32()), ("pts", pa.list_(POINT))]))
SHAPES = pa.schema([("file", pa.string()), ("record", pa.int32()), ("rings", RINGS)])
FIELDS = pa.schema([("file", pa.string()), ("record", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])


@dataclass
class Records(InputPartition):
    """A range of a file's records; no count: all that follow."""

    file: str
    first: int = 0
    count: int | None = None


def _ranges(file: str, records: int, size: int, per_task: int) -> list[Records]:
    """Equal ranges of records that fill a task each on average."""
    parts = max(1, min(records, -(-size // per_task)))
    cuts = [records * k // parts for k in range(parts + 1)]
    return [Records(file, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.per_task = int(options.get("bytes_per_task", BYTES_A_TASK))
        self.encoding = options.get("encoding", "utf-8")


class ShapeReader(_Reader):
    """The index beside a file (.shx) says how many records it has, in eight bytes each, and where they stand: planning
    looks at sizes only, and a task reads its part of the index and then its range of bytes. A file without an index is
    one task's, read from record to record."""

    def partitions(self) -> Sequence[InputPartition]:
        out: list[Records] = []
        for file, size in files.found(self.path, ".shp"):
            index = files.size_of(_index(file))
            out += [Records(file)] if index is None else _ranges(file, max(0, (index - 100) // 8), size, self.per_task)
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        with files.opened(partition.file) as f:
            places = _walked(f) if partition.count is None else _indexed(partition)
            rows, held = [], 0
            for record, content in _contents(f, places):
                rows.append({"file": partition.file, "record": record, "rings": readers.rings_of(content)})
                held += len(content)
                if held >= BYTES_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, SHAPES)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, SHAPES)


def _index(file: str) -> str:
    return file[:-1] + ("X" if file.endswith("P") else "x")


def _indexed(part: Records) -> Iterator[tuple[int, int, int]]:
    """Record, place of its content and length, from the index."""
    with files.opened(_index(part.file)) as f:
        f.seek(100 + 8 * part.first)
        index = f.read(8 * part.count)
    for k, (offset, length) in enumerate(readers.shx_offsets(b"\0" * 100 + index)):
        yield part.first + k, offset + 8, length


def _walked(f: pa.NativeFile) -> Iterator[tuple[int, int, int]]:
    at, k, end = 100, 0, f.size()
    while at + 8 <= end:
        f.seek(at)
        length = 2 * struct.unpack(">2i", f.read(8))[1]
        yield k, at + 8, length
        at, k = at + 8 + length, k + 1


def _contents(f: pa.NativeFile, places: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, bytes]]:
    """The records' contents; those that follow each other are read together, up to a bound."""
    run: list[tuple[int, int, int]] = []

    def read():
        begin = run[0][1]
        f.seek(begin)
        data = f.read(run[-1][1] + run[-1][2] - begin)
        return [(k, data[at - begin : at - begin + n]) for k, at, n in run]

    for place in places:
        if run and not (0 <= place[1] - run[-1][1] - run[-1][2] <= 64 and place[1] + place[2] - run[0][1] <= BYTES_AT_ONCE):
            yield from read()
            run = []
        run.append(place)
    if run:
        yield from read()


class AttributeReader(_Reader):
    """Records have one width, so a range of them is a range of bytes."""

    def partitions(self) -> Sequence[InputPartition]:
        out: list[Records] = []
        for file, size in files.found(self.path, ".dbf"):
            with files.opened(file) as f:
                out += _ranges(file, struct.unpack("<I", f.read(8)[4:])[0], size, self.per_task)
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        with files.opened(partition.file) as f:
            _, head, width = struct.unpack("<IHH", f.read(12)[4:])
            f.seek(0)
            fields = readers.dbf_fields(f.read(head))
            f.seek(head + partition.first * width)
            step = max(1, BYTES_AT_ONCE // width)
            for a in range(0, partition.count, step):
                data = f.read(min(step, partition.count - a) * width)
                rows = [(k, data[i * width : (i + 1) * width]) for k, i in enumerate(range(len(data) // width), partition.first + a)]
                kept = [{"file": partition.file, "record": k, "fields": list(readers.dbf_row(r, fields, self.encoding).items())} for k, r in rows if r[:1] != b"*"]
                if kept:
                    yield pa.RecordBatch.from_pylist(kept, FIELDS)


class ShapeSource(DataSource):
    """Polygons of SHP files: `spark.read.format("shp").load(path)`, path a file or a folder."""

    @classmethod
    def name(cls) -> str:
        return "shp"

    def schema(self) -> str:
        return readers.SHP

    def reader(self, schema) -> DataSourceReader:
        return ShapeReader(dict(self.options))


class AttributeSource(DataSource):
    """Attribute tables of DBF files: `spark.read.format("dbf").option("encoding", "cp949").load(path)`."""

    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self) -> str:
        return readers.DBF

    def reader(self, schema) -> DataSourceReader:
        return AttributeReader(dict(self.options))


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """The rows of `shp` or `dbf` files; option bytes_per_task is what a task reads at most, about."""
    for source in (ShapeSource, AttributeSource):
        spark.dataSource.register(source)
    return spark.read.format(kind).options(**options).load(path)


def basins(spark: SparkSession, stem: str, code_field: str = "SBSN_CD", encoding: str = "utf-8", **options) -> DataFrame:
    """code and rings of stem.shp and stem.dbf, joined on the record's number; deleted records have no basin."""
    codes = load(spark, "dbf", f"{stem}.dbf", encoding=encoding, **options).select("record", F.col("fields")[code_field].alias("code"))
    return load(spark, "shp", f"{stem}.shp", **options).select("record", "rings").join(codes, "record").select("code", "rings")
