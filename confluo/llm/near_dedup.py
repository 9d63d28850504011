"""MinHash near-deduplication with tensored banding.

Two small collections of half keys are computed, and every pair of a left and a right half is a table key: m * m tables
from 2 * m half keys. A half that only one document holds can be in no shared key and is left out before pairing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Scratch, row_key, unused, write
from .linking import PLACES, described, link_similar, may_hold, placed_keys, same_before, set_bits, shared_rows
from .pretokens import text_runs

#: Half keys a side, and minwise hashes a half key: a pair of similarity 0.75 shares no key with a chance of 1 in 10,000.
HALVES, ROWS = 12, 2
#: Words a shingle.
SHINGLE = 5
#: Sets of so many shingles at most are told apart by the shingles themselves, greater ones by the hashes of all of them.
SMALL = 64
ID = "struct<a: long, b: long>"


def shingle_set(text: str) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text; fewer words are one shingle."""
    w = hashing.word_texts(text)
    return set(zip(*(w[i:] for i in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else {tuple(w)} if w else set()


def _digest(text: str, hashes: np.ndarray) -> np.ndarray:
    """128 bits of a set."""
    said = b"\n".join(sorted(b" ".join(x) for x in shingle_set(text))) if len(hashes) <= SMALL else hashes.tobytes()
    return np.frombuffer(hashlib.blake2b(said, digest_size=16).digest(), np.int64)


def _signatures(parts):
    for part in parts:
        at = 0
        for some, texts in text_runs(part.column(1), part.column(1)):
            sets = hashing.word_shingles(texts, SHINGLE)
            size = np.array([len(s) for s in sets])
            full = np.flatnonzero(size)
            halves = np.zeros((len(sets), 2 * HALVES), np.int64)
            if len(full):
                first = np.concatenate([[0], np.cumsum(size[full])])
                halves[full] = placed_keys(hashing.keys(hashing.minwise(np.concatenate([sets[i] for i in full]), first, 2 * HALVES * ROWS), ROWS, 7))
            digest = np.array([_digest(t, s) for t, s in zip(texts, sets, strict=True)]).reshape(-1, 2)
            columns = [part.column(0).slice(at, len(some)), pa.array(size, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
            columns.append(pa.FixedSizeListArray.from_arrays(pa.array(halves.ravel()), 2 * HALVES).cast(pa.list_(pa.int64())))
            yield pa.record_batch(columns, names=["row_key", "n", "d1", "d2", "halves"])
            at += len(some)


def _shared_halves(items: Callable[[], DataFrame]) -> DataFrame:
    return shared_rows(items().select("id", F.explode("halves").alias("key")), items().count() * 2 * HALVES)


def _shared_tables(held: Callable[[], DataFrame], old: Scratch) -> DataFrame:
    """Rows of shared_rows for the table keys: pairs of a left and a right half, each held by other documents too."""
    place = F.col("key").bitwiseAND(F.lit(PLACES - 1))
    left, right = (F.collect_list(F.when(side, F.col("key"))) for side in (place < HALVES, place >= HALVES))
    sides = old.write(held().groupBy("id").agg(left.alias("l"), right.alias("r")), "half-sides")
    count = sides().agg(F.coalesce(F.sum(F.size("l").cast("long") * F.size("r")), F.lit(0))).first()[0]
    pairs = sides().select("id", F.explode("l").alias("l"), "r").select("id", "l", F.explode("r").alias("r"))
    table = F.col("l").bitwiseAND(F.lit(PLACES - 1)) * HALVES + F.col("r").bitwiseAND(F.lit(PLACES - 1)) - HALVES
    rows = pairs.select(F.xxhash64("l", "r").bitwiseAND(F.lit(-PLACES)).bitwiseOR(table).alias("key"), "id")
    return shared_rows(rows, count)


def _first_met(x: np.ndarray, y: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether no earlier table, by its left and by its right half, is shared by two documents."""
    left, right = np.divmod(place, HALVES)
    return ~(same_before(x[:, :HALVES], y[:, :HALVES], left) | same_before(x[:, HALVES:], y[:, HALVES:], right))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by 100 * common >= percent * union over their distinct 5-word shingles.

    Words are runs without ASCII white space, with A-Z lower-cased; a shorter text is one shingle; an empty or null text
    has none and is linked with nothing. Returns doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id
    = component_id), row_key (tells rows apart; equal rows share it) and first_key (the row key of the group's least id).

    Texts with equal sets are one class from the start, by a 128-bit digest, so thousands of copies cost one row each.
    Links are confirmed on the shingles themselves. Rows with a null id are linked like others and have the least id of
    their group, null if all are null; repeated rows stay; other columns are ignored, whatever their names; an empty
    table gives an empty result. Texts of any length are taken whole: a task holds one long text beside a run of short ones.
    """
    old = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"))
    marks = old.write(named.select("row_key", "text").mapInArrow(_signatures, f"row_key {ID}, n long, d1 long, d2 long, halves array<long>"), "signatures")
    classes = old.write(marks().where("n > 0").groupBy("d1", "d2").agg(F.min("row_key").alias("id")), "classes")
    items = marks().join(classes().select("id"), F.col("row_key") == F.col("id"), "left_semi").dropDuplicates(["row_key"])
    items = old.write(items.select(F.col("row_key").alias("id"), "halves"), "class-halves")
    halves = old.write(_shared_halves(items), "shared-halves")
    live = old.write(_shared_tables(halves, old), "shared-tables")

    def sets_of(ids: DataFrame) -> DataFrame:
        bits = set_bits(ids)

        def run(parts):
            for part in parts:
                yield part.filter(pa.array(may_hold(bits, part.column(0).field("a").to_numpy())))

        # Texts that the filter stops are not moved.
        moved = named.select(F.col("row_key").alias("id"), F.col("text").alias("set")).mapInArrow(run, f"id {ID}, set string")
        wanted = moved.join(ids, "id", "left_semi").dropDuplicates(["id"])
        return described(wanted, lambda texts: hashing.word_shingles(texts, SHINGLE))

    linked = link_similar(live, sets_of, halves().select("id", "key"), 2 * HALVES, _first_met, shingle_set, percent, old)
    owners = named.select("doc_id", "row_key")
    placed = owners.join(marks().select("row_key", "n", "d1", "d2").distinct(), "row_key").join(classes(), ["d1", "d2"], "left").join(linked, "id", "left")
    placed = placed.select("doc_id", F.col("n").alias("n_shingles"), "row_key", F.coalesce("component", "id", "row_key").alias("root"))
    placed = write(placed, "placed")
    old.clear()
    first = F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first_key")
    least = placed().groupBy("root").agg(F.min("doc_id").alias("component_id"), first)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return placed().join(least, "root").select("doc_id", "n_shingles", "component_id", kept, "row_key", "first_key")


def keep_one(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which one stays of each group of near_duplicates: the least id's; of
    equal rows one stays. Else as near_duplicates."""
    found, key = near_duplicates(docs, percent, id_col, text_col), unused(docs, "row_key")
    keys = found.groupBy(F.col("row_key").alias(key)).agg(F.min("first_key").alias("first"), F.count("*").alias("c"))
    keys = write(keys.where((F.col(key) != F.col("first")) | (F.col("c") > 1)), "row-groups")
    named = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    once = named.join(keys().select(key), key, "left_anti")
    again = named.join(keys().where(F.col(key) == F.col("first")).select(key), key, "left_semi").dropDuplicates([key])
    return once.unionByName(again).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return near_duplicates(read(spark, sf_dir, "documents")).drop("row_key", "first_key")
