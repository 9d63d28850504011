"""Periodic run detection: every lag's comparison of a document's word ids with themselves, and its stretches of equality.

Short documents are scanned a batch at a time: their ids stand side by side, longest first and parted by ids that occur
once, so a lag is compared in all documents long enough for it at once. The lags of a long document are dealt to tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key
from .pretokens import text_runs

#: Lags of a document that one task scans.
LAGS_A_TASK = 1 << 15
RUNS = "array<struct<start: long, length: long, period: long>>"
KEY = "struct<a: long, b: long>"


def split_words(text: str | None, doc_id: int | None = None) -> list[bytes]:
    """The words of a text: runs without ASCII white space."""
    return (text or "").encode().split()


def _smallest_period(ids: np.ndarray, q: int) -> int:
    """The smallest period of ids, which have period q and are at least twice as long: it divides q."""
    rest, p = q, 2
    while rest > 1:
        if rest % p:
            p = p + 1 if p * p <= rest else rest
            continue
        rest //= p
        if np.array_equal(ids[: len(ids) - q // p], ids[q // p :]):
            q //= p
    return q


class _Found:
    """Runs found so far, and which places they cover."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int], int] = {}
        self.table = np.zeros((0, 3), np.int64)

    def add(self, begin: int, end: int, period: int) -> None:
        self.period[begin, end] = period

    def covers(self, at: np.ndarray, span: int, q: int) -> np.ndarray:
        """Whether at to at + span lie in one run whose period divides q: a stretch at lag q there is that run again."""
        if len(self.table) < len(self.period):
            self.table = np.array(sorted((*r, p) for r, p in self.period.items()), np.int64)
        some = self.table[q % self.table[:, 2] == 0] if len(self.table) else self.table
        if not len(some):
            return np.zeros(len(at), bool)
        last = np.searchsorted(some[:, 0], at, side="right") - 1
        return (last >= 0) & (np.maximum.accumulate(some[:, 1])[last] > at + span)


def scan(sizes: np.ndarray, ids: np.ndarray, low: int, high: int, min_exp: int, min_length: int) -> np.ndarray:
    """Runs (rows of begin, end, smallest period) found at the lags from low to high, high left out.

    ids: the word ids of documents of these sizes, greatest first, each followed by an id that occurs once. A stretch of
    min_exp * q words of period q holds min_exp equal words q apart on whatever grid of step q: where a lag's grid has no
    such chain, the lag has no run; else all words are compared with those at the lag, and the stretches measured.
    """
    found = _Found()
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    lags = np.arange(low, high)
    reach = ends[np.searchsorted(-sizes, -np.maximum(min_exp * lags, min_length), side="right")]
    chain = b"\1" * (min_exp - 1)
    for q, m in zip(lags.tolist(), reach.tolist(), strict=True):
        if not m:
            break
        grid = ids[:m:q]
        same = grid[1:] == grid[:-1]
        if same.tobytes().find(chain) < 0:
            continue
        last = len(same) - min_exp + 2
        hit = same[:last].copy()
        for k in range(1, min_exp - 1):
            hit &= same[k : last + k]
        if found.covers(np.flatnonzero(hit) * q, (min_exp - 1) * q, q).all():
            continue
        equal = np.zeros(m - q + 2, np.int8)
        equal[1:-1] = ids[: m - q] == ids[q:m]
        edge = np.diff(equal)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
        long = end - begin >= max(min_length, min_exp * q)
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            if (a, b) not in found.period:
                found.add(a, b, _smallest_period(ids[a:b], q))
    return np.array([(*r, p) for r, p in found.period.items()], np.int64).reshape(-1, 3)


def find_runs(texts: list[list[bytes]], low: int, high: int | None, min_exp: int, min_length: int) -> list[np.ndarray]:
    """The runs (rows of start, length, period, in that order) of each of these word lists at lags from low to high."""
    sizes = np.array([len(w) for w in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    kinds: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts = []
    for i in order.tolist():
        parts += [np.fromiter(map(kinds.__getitem__, texts[i]), np.int32, len(texts[i])), np.array([-1 - i], np.int32)]
    ids, sizes = np.concatenate([np.zeros(0, np.int32), *parts]), sizes[order]
    most = int(sizes[0]) // min_exp + 1 if len(sizes) else 1
    rows = scan(sizes, ids, low, min(most, high or most), min_exp, min_length)
    first = np.cumsum(sizes + 1) - sizes - 1
    which = np.searchsorted(first, rows[:, 0], side="right") - 1
    runs = np.column_stack([rows[:, 0] - first[which], rows[:, 1] - rows[:, 0], rows[:, 2]]) if len(rows) else rows
    by_place = np.lexsort((runs[:, 2], runs[:, 0], which))
    bounds = np.searchsorted(which[by_place], np.arange(len(texts) + 1))
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    for k, i in enumerate(order.tolist()):
        out[i] = runs[by_place[bounds[k] : bounds[k + 1]]]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> str:
    """The words, one space between two, of each run only the first period."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return b" ".join(words).decode()


def strongest(runs: np.ndarray) -> dict | None:
    """The run of greatest length / period; of equals the first, then that of the smallest period."""
    if not len(runs):
        return None
    best = min(runs.tolist(), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return dict(zip(("start", "length", "period"), best, strict=True))


def _described(ids: pa.Array, words: list[list[bytes]], runs: list[np.ndarray]) -> pa.RecordBatch:
    """A row a document: its runs, the strongest of them, and its text with runs collapsed."""
    flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
    fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    columns = [
        ids,
        pa.array([len(w) for w in words], pa.int64()),
        pa.ListArray.from_arrays(pa.array(bounds), fields),
        pa.array([strongest(r) for r in runs], fields.type),
        pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.string()),
    ]
    return pa.record_batch(columns, names=["doc_id", "n_words", "runs", "strongest", "collapsed"])


def periodic_runs(
    docs: DataFrame,
    min_exp: int = 4,
    min_length: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_of: Callable[[str | None, int | None], list[bytes]] = split_words,
    lags_a_task: int = LAGS_A_TASK,
) -> DataFrame:
    """The periodic runs of every whole text: doc_id, n_words, runs (array of start, length, period, by start, then period),
    strongest (the run of greatest length / period, of equals the first; null without runs) and collapsed (the words one
    space apart, of each run only the first period).

    words_of gives a document's words from text and id, at most one for two bytes; by default runs without ASCII white
    space. They are numbered from 0. A run is a stretch of words with smallest period q and of
    at least max(min_length, min_exp * q) words that no neighbour extends with that period; min_exp is 2 or more. Words
    are compared by ids that a task gives them, not by hashes.

    A map over documents of at most about 4 * min_exp * lags_a_task bytes; the lags of longer ones are dealt to tasks, a
    copy of the text for so many lags, and what they find is put together by document: fewer runs than words. Null and
    empty texts have no words and no runs; null ids and repeated rows stay as they are; other input columns are ignored;
    an empty table gives an empty result.
    """
    if min_exp < 2:
        raise ValueError("min_exp must be 2 or more")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tasks = F.ceil((F.octet_length("text") + 1) / (2 * min_exp * lags_a_task)).cast("int")
    kind = f"doc_id long, n_words long, runs {RUNS}, strongest struct<start: long, length: long, period: long>, collapsed string"

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for ids, texts in text_runs(part.column(0), part.column(1)):
                words = [words_of(t, i) for t, i in zip(texts, ids, strict=True)]
                yield _described(pa.array(ids, pa.int64()), words, find_runs(words, 1, None, min_exp, min_length))

    def some_lags(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(len(part)):
                n = part.column(2)[i].as_py()
                runs = find_runs([words_of(part.column(1)[i].as_py(), part.column(3)[i].as_py())], max(1, n * lags_a_task), (n + 1) * lags_a_task, min_exp, min_length)[0]
                keys = part.column(0).take(pa.array(np.full(len(runs), i)))
                yield pa.record_batch([keys, *(pa.array(runs[:, k]) for k in range(3))], names=["row_key", "start", "length", "period"])

    def collapsed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(len(part)):
                found = part.column(2)[i].as_py() or []
                runs = np.array([(r["start"], r["length"], r["period"]) for r in found], np.int64).reshape(-1, 3)
                yield _described(part.column(0).slice(i, 1), [words_of(part.column(1)[i].as_py(), part.column(0)[i].as_py())], [runs])

    short = rows.where(F.coalesce(tasks, F.lit(0)) <= 1).mapInArrow(whole, kind)
    long = rows.where(tasks > 1).withColumn("row_key", row_key("doc_id", "text"))
    dealt = long.dropDuplicates(["row_key"]).select("row_key", "text", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("part"), "doc_id")
    dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_key", "part")
    found = dealt.mapInArrow(some_lags, f"row_key {KEY}, start long, length long, period long")
    found = found.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("start", "length", "period"))).alias("runs"))
    return short.union(long.join(found, "row_key", "left").select("doc_id", "text", "runs").mapInArrow(collapsed, kind))


def planted_words(text: str | None, doc_id: int | None) -> list[bytes]:
    """The words of a text, with a run planted in every tenth document, by the checksum h of its decimal id: from the word
    a = g % n on (g = h / 10, n words), words repeat with period 1 + (n - a) / (3 + g % 8), divisions rounded down."""
    words = split_words(text)
    h = zlib.crc32(str(doc_id).encode())
    if not words or doc_id is None or h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    best = lambda c: F.col(f"strongest.{c}")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return periodic_runs(read(spark, sf_dir, "documents"), words_of=planted_words).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best(c).alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best("length") / best("period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
