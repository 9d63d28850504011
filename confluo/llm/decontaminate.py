"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the words in a window and ignore the rest; test items and documents are hashed under every
mask, joined on the hashes, and every hit is verified word by word along its diagonal, substitutions allowed. The masks
are chosen so that no window within the tolerance can miss all of them.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Scratch, row_key, unused, write
from .pretokens import text_runs

#: Words of a window and substitutions allowed in it; an item of fewer words is one window with its share of them.
WINDOW, SUBSTITUTIONS = 16, 3
#: An item of fewer words is no evidence inside a text: only a document of these words and no others holds it.
LEAST_WORDS = 5
ID = "struct<a: long, b: long>"
#: Bits of the filter that drops document hashes no test item has: its size is fixed, whatever the benchmark's.
FILTER_BITS = 26
#: Places beside each other at which an item may stand are looked at together, so many words at most beyond the item's.
STRETCH = 1 << 12
#: Bytes of stretches that a task gives at once.
GIVEN = 1 << 23


def tolerance(words: int) -> tuple[int, int]:
    """Window and substitutions for an item of so many words."""
    window = min(words, WINDOW)
    return window, SUBSTITUTIONS * window // WINDOW


@lru_cache(32)
def masks(window: int, substitutions: int) -> list[tuple[int, ...]]:
    """Word offsets of masks of which at least one fits unharmed into every window with so many substitutions: chosen
    one by one, each time the mask that fits into most of the patterns left."""
    if not substitutions:
        return [tuple(range(window))]
    weight = max(1, (window - substitutions) // 2)
    harm = np.array([sum(1 << i for i in c) for c in combinations(range(window), substitutions)])
    tried = [(0, *inner, span - 1)[: weight if weight > 1 else 1] for span in range(weight, window + 1) for inner in combinations(range(1, span - 1), max(0, weight - 2))]
    tried = [m for m in dict.fromkeys(tried) if len(m) == weight]
    fits = []
    for m in tried:
        bits = sum(1 << i for i in m)
        fits.append(np.any([(harm & (bits << at)) == 0 for at in range(window - m[-1])], axis=0))
    left, chosen = np.ones(len(harm), bool), []
    while left.any():
        best = int(np.argmax([(f & left).sum() for f in fits]))
        left &= ~fits[best]
        chosen.append(tried[best])
    return chosen


def _seed_hashes(h: np.ndarray, first: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in it and hash of every position where the mask fits into a text."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.full(n, hashing.mix([sum(1 << o for o in mask)])[0])
    for j, o in enumerate(mask):
        total += h[o : o + n] * hashing.WORD[j]
    total = hashing.mix(total)
    text = np.searchsorted(first, np.arange(n), side="right") - 1
    inside = np.arange(n) + mask[-1] < first[text + 1]
    return text[inside], (np.arange(n) - first[text])[inside], total.view(np.int64)[inside]


def _spans(item: np.ndarray, text: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Runs (start and end in the text's words, equal words) of windows within the tolerance, the item lying at shift."""
    window, substitutions = tolerance(len(item))
    a, b = max(0, shift), min(len(text), shift + len(item))
    if b - a < window:
        return []
    equal = np.concatenate([[0], np.cumsum(text[a:b] == item[a - shift : b - shift])])
    good = np.flatnonzero(equal[window:] - equal[:-window] >= window - substitutions)
    if not len(good):
        return []
    cuts = np.flatnonzero(np.diff(good) > window)
    return [(a + int(s), a + int(e) + window, int(equal[e + window] - equal[s])) for s, e in zip(good[np.r_[0, cuts + 1]], good[np.r_[cuts, len(good) - 1]], strict=True)]


def _stretches(shifts: np.ndarray, words: int, most: int) -> list[tuple[int, int, np.ndarray]]:
    """Parts (start, end, shifts from the start) of a text of most words in which an item of so many words may stand at these
    shifts. Shifts further apart than the item is long have parts of their own, which don't overlap."""
    shifts = np.sort(shifts)
    new = np.concatenate([[True], np.diff(shifts) > words])
    block = (shifts - shifts[new][np.cumsum(new) - 1]) // STRETCH
    new[1:] |= block[1:] != block[:-1]
    first = np.append(np.flatnonzero(new), len(shifts))
    out = []
    for a, b in zip(first, first[1:], strict=False):
        start = max(0, int(shifts[a]))
        out.append((start, min(most, int(shifts[b - 1]) + words), shifts[a:b] - start))
    return out


def _named(words: list[bytes], names: dict[bytes, int]) -> np.ndarray:
    """Words as numbers; -1 stands for words that have none."""
    return np.array([names.get(w, -1) for w in words], np.int64)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with the test passages it holds: doc_id, doc_key, contaminated, item_ids (array of long), spans
    (array of item_id, start, end, equal: places among the document's words).

    Words are runs without ASCII white space, A-Z lower-cased. A passage is a window of 16 words of an item (all of a
    shorter item) that a document repeats with at most 3 substituted words (its share in a shorter item); no such window
    is missed. An item of fewer than 5 words is held by a document that has these words and no others. Hashes only find
    candidates: windows are compared word by word. benchmark has item_id and text.

    Null and empty texts hold nothing; rows with null ids are searched like others; a null item_id stands as -1 in the
    result; repeated items each count; rows of the same id and text share doc_key and have the same result; other columns
    are ignored, whatever their names; empty tables give empty or clean results. Texts of any length are taken whole.

    One pass hashes whole documents and keeps what a filter of fixed size lets through; only these hashes are shuffled,
    and only the texts that have hits are moved, once, with the places to look at: a row is a text and its hits. Stretches
    around the hits are then cut out and meet their items: a row is an item and little more of the text than its length.
    """
    old = Scratch(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = old.write(items.select(row_key("item_id", "text").alias("item"), "item_id", "text").distinct(), "bench-items")

    def test_seeds(parts):
        for part in parts:
            for i, text in enumerate(part.column(1).to_pylist()):
                h, first = hashing.words([text])
                if not len(h):
                    continue
                window = tolerance(len(h))[0]
                for m, mask in enumerate(masks(*tolerance(len(h)))):
                    _, at, seed = _seed_hashes(h, first, mask)
                    n = len(at)
                    columns = [np.full(n, window, np.int32), np.full(n, m, np.int32), np.full(n, len(h), np.int64), seed]
                    yield pa.record_batch([*map(pa.array, columns), part.column(0).take(pa.array(np.full(n, i))), pa.array(at)], names=["window", "mask", "words", "seed", "item", "at"])

    tests = old.write(items().select("item", "text").mapInArrow(test_seeds, f"window int, mask int, words long, seed long, item {ID}, at long"), "bench-seeds")
    windows = sorted(r[0] for r in tests().select("window").distinct().collect())  # at most WINDOW values
    bit = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    bytes_set = tests().groupBy(F.shiftright(bit, 3).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod(bit, F.lit(8)).cast("int"))).alias("bits"))
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for byte, bits in bytes_set.toLocalIterator():  # at most the filter's bytes
        bitmap[byte] = bits

    def doc_seeds(parts):
        for part in parts:
            at_row = 0
            for some, texts in text_runs(part.column(1), part.column(1)):
                h, first = hashing.words(texts)
                size = np.diff(first)
                for window in windows:
                    for m, mask in enumerate(masks(*tolerance(window))):
                        text, at, seed = _seed_hashes(h, first, mask)
                        place = seed.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
                        hit = (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                        k = np.flatnonzero(hit if window >= LEAST_WORDS else hit & (size[text] == window))
                        if len(k):
                            columns = [pa.array(np.full(len(k), window, np.int32)), pa.array(np.full(len(k), m, np.int32)), pa.array(seed[k])]
                            yield pa.record_batch([*columns, part.column(0).take(pa.array(text[k] + at_row)), pa.array(at[k])], names=["window", "mask", "seed", "doc_key", "place"])
                at_row += len(some)

    named = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("doc_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seeds = named.select("doc_key", "text").mapInArrow(doc_seeds, f"window int, mask int, seed long, doc_key {ID}, place long")
    hits = seeds.join(tests(), ["window", "mask", "seed"]).select("doc_key", "item", "words", (F.col("place") - F.col("at")).alias("shift")).distinct()
    of_items = hits.groupBy("doc_key", "item", "words").agg(F.collect_list("shift").alias("shifts"))
    held = old.write(of_items.groupBy("doc_key").agg(F.collect_list(F.struct("item", "words", "shifts")).alias("held")), "bench-held")
    hit_texts = named.join(held().select("doc_key"), "doc_key", "left_semi").dropDuplicates(["doc_key"])

    def cut(parts):
        for part in parts:
            rows, size = [], 0
            for key, text, held in zip(*(part.column(c) for c in range(3)), strict=True):
                words, key = hashing.word_texts(text.as_py()), key.as_py()
                for one in held:
                    item, n, shifts = one["item"].as_py(), one["words"].as_py(), one["shifts"].values.to_numpy()
                    for start, end, at in _stretches(shifts, n, len(words)):
                        rows.append((key, item, start, b" ".join(words[start:end]).decode(), at.tolist()))
                        size += len(rows[-1][3])
                        if size > GIVEN:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    two = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    kinds, names = [two, two, pa.int64(), pa.string(), pa.list_(pa.int64())], ["doc_key", "item", "from", "part", "shifts"]
    stretches = hit_texts.select("doc_key", "text").join(held(), "doc_key").mapInArrow(cut, f"doc_key {ID}, item {ID}, `from` long, part string, shifts array<long>")
    met = stretches.join(items().withColumnRenamed("text", "item_text"), "item").select("doc_key", "item_id", "item_text", "from", "part", "shifts")

    def verify(parts):
        for part in parts:
            for i in range(len(part)):
                names: dict[bytes, int] = {}
                words = np.array([names.setdefault(w, len(names)) for w in hashing.word_texts(part.column(4)[i].as_py())], np.int64)
                item, spans, start = _named(hashing.word_texts(part.column(2)[i].as_py()), names), set(), part.column(3)[i].as_py()
                for shift in part.column(5)[i].as_py():
                    spans.update((start + a, start + b, equal) for a, b, equal in _spans(item, words, shift))
                if spans:
                    columns = [pa.array(c, pa.int64()) for c in zip(*sorted(spans), strict=True)]
                    at = pa.array(np.full(len(spans), i))
                    yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), *columns], names=["doc_key", "item_id", "start", "end", "equal"])

    span = F.struct("item_id", "start", "end", "equal")
    found = met.mapInArrow(verify, f"doc_key {ID}, item_id long, start long, end long, equal long").groupBy("doc_key").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    found = write(found, "bench-spans")
    old.clear()
    out = named.select("doc_id", "doc_key").join(found(), "doc_key", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<item_id: long, start: long, end: long, equal: long>>"))
    return out.select("doc_id", "doc_key", F.col("spans").isNotNull().alias("contaminated"), F.sort_array(F.array_distinct(spans["item_id"])).alias("item_ids"), spans.alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no test passage; see find_contamination."""
    key = unused(docs, "doc_key")
    found = find_contamination(docs, benchmark, id_col, text_col).where("contaminated").select(F.col("doc_key").alias(key)).distinct()
    named = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    return named.join(write(found, "bench-documents")(), key, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_ids", F.to_json("spans").alias("spans"))
