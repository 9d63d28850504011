"""Token-id files: a concatenated id array with Elias-Fano coded document ids and boundaries."""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, qualified, write
from .pretokens import PieceCache, text_runs

MAGIC = b"EFIDS001"
#: Magic, documents without an id, token ids, bytes a token id.
HEAD = struct.Struct("<8sQQB")
#: Every so many values the position of a value's high bit is stored, as uint32 from the start.
SELECT_STEP = 256


class EliasFano:
    """A rising sequence in about 2 + log2(largest / length) bits a value.

    A value's low bits stand in a packed array; its high part h sets bit h + i of a bit string, i being its place.
    select(i) starts at the stored position nearest before the i-th set bit and counts set bits from there.
    """

    HEAD = struct.Struct("<QQBQQ")

    def __init__(self, n: int, least: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.least, self.low_bits, self.low, self.high, self.samples = n, least, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        least = int(values[0]) if n else 0
        offset = (values.astype(np.int64) - least).astype(np.uint64)
        top = int(offset[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (offset >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        marks[high] = 1
        low = ((offset[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, least, bits, np.packbits(low.ravel()), np.packbits(marks), high[::SELECT_STEP].astype("<u4"))

    def tobytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.least & (2**64 - 1), self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, least, bits, low, high = cls.HEAD.unpack_from(data, at)
        at += cls.HEAD.size
        parts = []
        for kind, count in ((np.uint8, low), (np.uint8, high), ("<u4", -(-n // SELECT_STEP))):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, least - (least >> 63 << 64), bits, *parts), at

    def _low(self, first: int, count: int) -> np.ndarray:
        a, b = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)])[a % 8 : a % 8 + b - a].reshape(count, self.low_bits)
        return (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def run(self, i: int, count: int) -> np.ndarray:
        """The values i to i + count - 1: only the high bits between the stored positions around them are looked at."""
        at = int(self.samples[i // SELECT_STEP])
        after = -(-(i + count) // SELECT_STEP)
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[at // 8 : end])) + at // 8 * 8
        places = places[np.searchsorted(places, at) + i % SELECT_STEP :][:count]
        return self.least + ((places - np.arange(i, i + count)) << self.low_bits) + self._low(i, count)

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.run(i, 1)[0])

    def values(self) -> np.ndarray:
        return self.run(0, self.n) if self.n else np.zeros(0, np.int64)


def pack(doc_ids: list[int | None], ids: list[np.ndarray], largest: int) -> bytes:
    """One file: magic, counts, ids, boundaries, document ids. Documents without an id come first."""
    nulls = sum(d is None for d in doc_ids)
    kind = "<u2" if largest < 1 << 16 else "<u4"
    flat = np.concatenate(ids).astype(kind) if ids else np.zeros(0, kind)
    bounds = EliasFano.build(np.concatenate([[0], np.cumsum([len(x) for x in ids])]))
    keys = EliasFano.build(np.array(doc_ids[nulls:], np.int64))
    return HEAD.pack(MAGIC, nulls, len(flat), flat.itemsize) + flat.tobytes() + bounds.tobytes() + keys.tobytes()


class TokenFile:
    """A token-id file, read in place: the boundaries and document ids are held coded, ids are fetched by their offsets."""

    def __init__(self, f):
        self.f = f
        magic, self.nulls, n, width = HEAD.unpack(f.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.kind = np.dtype(f"<u{width}")
        f.seek(HEAD.size + n * width)
        tail = f.read()
        self.bounds, at = EliasFano.read(tail, 0)
        self.keys, _ = EliasFano.read(tail, at)
        self.n_docs = self.bounds.n - 1

    def documents(self, first: int, count: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """Ids of documents, where their token ids start in the file (and the end of the last), and these token ids."""
        bounds = self.bounds.run(first, count + 1)
        self.f.seek(HEAD.size + int(bounds[0]) * self.kind.itemsize)
        flat = np.frombuffer(self.f.read(int(bounds[-1] - bounds[0]) * self.kind.itemsize), self.kind)
        nulls = min(max(self.nulls - first, 0), count)
        keys = self.keys.run(first + nulls - self.nulls, count - nulls).tolist() if count > nulls else []
        return [None] * nulls + keys, bounds, flat


@lru_cache(1)
def _byte_chars() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it shows, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    model, chars = t.model, _byte_chars()

    def encode(pieces: list[str]) -> list[bytes]:
        shown = [p.encode().decode("latin-1").translate(chars) for p in pieces]
        return [array("I", [x.id for x in model.tokenize(p)]).tobytes() for p in shown]

    added = [a.content for a in t.get_added_tokens_decoder().values()]
    return t, PieceCache(encode), regex.compile("|".join(map(regex.escape, added))) if added else None


def _encode(path: str, texts: list[str], end_id: int) -> list[np.ndarray]:
    """The ids of each text as the library gives them, and the end id.

    The library's model encodes each distinct piece once: merges stay within pieces. A text that holds a string of an
    added token, which the library cuts out before all else, goes through the library as a whole.
    """
    t, cache, added = _tokenizer(path)
    whole = [added is not None and added.search(x) is not None for x in texts]
    flat, bounds = cache(["" if w else x for w, x in zip(whole, texts, strict=True)])
    out = np.split(np.insert(flat, bounds[1:], end_id), (bounds[1:] + np.arange(1, len(bounds)))[:-1])
    for i in np.flatnonzero(whole):
        out[i] = np.array([*t.encode(texts[i], add_special_tokens=False).ids, end_id], flat.dtype)
    return out


def _file_system(path: str):
    """pyarrow's file system and its path for a qualified path."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def write_token_files(
    docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, ids_a_file: int = 1 << 22
) -> DataFrame:
    """Encode texts and write their ids, in ascending order of document id, as files of about ids_a_file ids.

    Returns the manifest: file, n_docs, n_ids, start (ids in the files before it): one row a file. Null texts count as
    empty and hold the end id alone; rows with a null id come first; equal ids and repeated rows stand in any order; other
    columns are ignored, whatever their names; an empty table gives an empty manifest and no file. A task holds the ids of
    one file and the texts of one run; a text longer than either is held whole. Each task writes its files under another
    name and renames them, so a repeated task does no harm. path is shared by all executors, in a file system that
    pyarrow opens too; a path without scheme is taken from Spark's default file system.

    Ids are the library's, without the special tokens of its template. The tokenizer must split texts by the byte-level
    pattern of pretokens.py.
    """
    path = qualified(docs.sparkSession, path)

    def run(parts):
        from pyspark import TaskContext

        fs, root = _file_system(path)
        task = TaskContext.get()
        largest = _tokenizer(tokenizer_path)[0].get_vocab_size()
        keys, ids, held, made = [], [], 0, 0

        def flush():
            nonlocal keys, ids, held, made
            name = f"ids-{task.partitionId():06d}-{made:05d}.tok"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/.{name}.{task.taskAttemptId()}") as f:
                f.write(pack(keys, ids, largest))
            fs.move(f"{root}/.{name}.{task.taskAttemptId()}", f"{root}/{name}")
            row = pa.record_batch([pa.array([task.partitionId()], pa.int32()), [name], [len(keys)], [held]], names=["task", "file", "n_docs", "n_ids"])
            keys, ids, held, made = [], [], 0, made + 1
            return row

        for part in parts:
            for some, texts in text_runs(part.column(0), part.column(1)):
                codes = _encode(tokenizer_path, texts, end_id)
                keys += some
                ids += [c.astype("<u2") if largest < 1 << 16 else c for c in codes]
                held += sum(map(len, codes))
                if held >= ids_a_file:
                    yield flush()
        if keys:
            yield flush()

    # The random second key splits the rows of one document id too; a written order is the sort below.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.rand(5).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = write(ordered.select("doc_id", "text").mapInArrow(run, "task int, file string, n_docs long, n_ids long"), "token-files-made")
    # Ids before a task's files: a row a task; before a file: among those of its task.
    of_tasks = files().groupBy("task").agg(F.sum("n_ids").alias("held"))
    before = of_tasks.select("task", F.coalesce(F.sum("held").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("task").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files().withColumn("inside", inside).join(before, "task").select("file", "n_docs", "n_ids", (F.col("before") + F.col("inside")).alias("start"))


def _read(path: str, step: int = 256):
    """For each row (file, start) of a manifest, blocks of its documents: ids, starts and the end, token ids."""

    def blocks(part):
        fs, root = _file_system(path)
        for name, start in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            with fs.open_input_file(f"{root}/{name}") as f:
                held = TokenFile(f)
                for a in range(0, held.n_docs, step):
                    keys, bounds, flat = held.documents(a, min(step, held.n_docs - a))
                    yield keys, bounds + start, flat

    return blocks


def _dealt(manifest: DataFrame) -> DataFrame:
    """A task reads some 16 files."""
    return manifest.select("file", "start").repartition(max(1, manifest.count() // 16 + 1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The documents of token-id files: doc_id, start, ids (array of int). Reads nothing but the files and the manifest.

    Each task opens its files in place and fetches blocks of documents by offsets that select gives; a file that the
    manifest names and that isn't there fails the job."""
    blocks = _read(qualified(spark, path))

    def run(parts):
        for part in parts:
            for keys, bounds, flat in blocks(part):
                ids = pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(bounds[:-1], pa.int64()), ids], names=["doc_id", "start", "ids"])

    return _dealt(manifest).mapInArrow(run, "doc_id long, start long, ids array<int>")


def token_file_digests(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """As read_token_files, but for each document the number of its ids and their checksum in place of the ids."""
    blocks = _read(qualified(spark, path))

    def run(parts):
        for part in parts:
            for keys, bounds, flat in blocks(part):
                cuts = bounds - bounds[0]
                crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                columns = [keys, bounds[:-1], np.diff(bounds), crc]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _dealt(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read

    path = fresh_path(spark, "token-files")
    manifest = write_token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_file_digests(spark, path, manifest)
