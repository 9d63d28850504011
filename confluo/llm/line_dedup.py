"""Line deduplication by MinHash of character shingles: banding, exact Jaccard, union-find, one line a component."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Scratch, row_key, unused, write
from .linking import described, link_similar, may_hold, placed_keys, same_before, set_bits, shared_keys
from .pretokens import text_runs

#: Characters a shingle; bands of minwise hashes: lines of similarity 0.75 share no band with a chance of 4 in 1,000, of
#: 0.85 with 1 in 10,000.
SHINGLE, BANDS, ROWS = 10, 10, 3
#: Characters hashed at once: their arrays fit the processor's cache.
RUN = 1 << 18
#: Lines that a task remembers, so that it gives the bands of a line once: beyond these it forgets them, which costs work only.
KNOWN = 1 << 16
#: A line's id: 128 bits of its normal form.
ID = "struct<a: long, b: long>"
#: White space other than the plain space and the newline, of ASCII and of all.
ASCII_WHITE = tuple("\t\v\f\r\x1c\x1d\x1e\x1f")
WHITE = (*ASCII_WHITE, *(chr(c) for c in range(0x80, 0x3001) if chr(c).isspace()))


def normal(line: str) -> str:
    """Lines that differ in case and white space only are equal."""
    return " ".join(line.lower().split())


def _normal_lines(text: str) -> list[str]:
    """The normal form of every line of a text. A text without odd white space is looked through as a whole."""
    text = text.lower()
    lines = text.split("\n")
    if "  " in text or any(map(text.__contains__, ASCII_WHITE if text.isascii() else WHITE)):
        return [" ".join(x.split()) for x in lines]
    return [x.strip(" ") if x[:1] == " " or x[-1:] == " " else x for x in lines]


def _ids(lines: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=16).digest() for x in lines), np.int64).reshape(-1, 2)


def _id_array(ids: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1])], ["a", "b"])


def _lines(texts: list[str], shortest: int = 1) -> tuple[list[str], list[int], list[int]]:
    """Normal forms of the lines of so many characters at least, with their text and their place in it."""
    found, owner, place = [], [], []
    for i, t in enumerate(texts):
        lines = _normal_lines(t)
        kept = range(len(lines))
        if min(map(len, lines)) < shortest:
            kept = [j for j in kept if len(lines[j]) >= shortest]
            lines = [lines[j] for j in kept]
        found += lines
        owner += [i] * len(lines)
        place += kept
    return found, owner, place


def _places(parts):
    """A row for each line, with its bands where it is the first of its kind that the task knows. A line shorter than a shingle is
    its own only shingle, so it is similar to equal lines alone: its id says all, and it has no bands."""
    known: set[bytes] = set()
    for part in parts:
        at = 0
        for some, texts in text_runs(part.column(2), part.column(2), most=RUN):
            here, at = at, at + len(some)
            lines, owner, place = _lines(texts)
            if not lines:
                continue
            kinds = list(dict.fromkeys(lines))
            of = {x: i for i, x in enumerate(kinds)}
            which = np.array([of[x] for x in lines])
            ids = _ids(kinds)
            digests = [x.tobytes() for x in ids]
            new = np.array([len(x) >= SHINGLE and d not in known for x, d in zip(kinds, digests, strict=True)])
            keys = np.zeros((len(kinds), BANDS), np.int64)
            if new.any():
                shingles, first = hashing.char_shingles([kinds[i] for i in np.flatnonzero(new)], SHINGLE)
                keys[new] = placed_keys(hashing.keys(hashing.minwise(shingles, first, BANDS * ROWS), ROWS, 11))
                known.update(digests[i] for i in np.flatnonzero(new))
                if len(known) > KNOWN:
                    known.clear()
            fresh = np.zeros(len(lines), bool)
            fresh[np.unique(which, return_index=True)[1]] = True
            fresh &= new[which]
            offsets = np.concatenate([[0], np.cumsum(fresh * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[which[fresh]].ravel()))
            owners = pa.array(np.array(owner) + here)
            columns = [part.column(0).take(owners), part.column(1).take(owners), pa.array(place, pa.int32()), _id_array(ids[which]), bands]
            yield pa.record_batch(columns, names=["doc_key", "doc_id", "line", "id", "bands"])


def _flat_places(parts):
    """Rows of _places with ids as columns and bands (a list of longs) as binary."""
    for part in _places(parts):
        doc, doc_id, line, of, bands = part.columns
        cuts = pa.py_buffer((bands.offsets.to_numpy() * 8).astype("<i4"))
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, cuts, pa.py_buffer(np.ascontiguousarray(bands.values.to_numpy()))])
        yield pa.record_batch([doc.field("a"), doc.field("b"), doc_id, line, of.field("a"), of.field("b"), packed], names=["doc_a", "doc_b", "doc_id", "line", "a", "b", "bands"])


def _hashes(lines: list[str]) -> list[np.ndarray]:
    shingles, first = hashing.char_shingles(lines, SHINGLE)
    return [hashing.distinct(shingles[a:b]) for a, b in zip(first, first[1:], strict=False)]


def shingle_set(line: str) -> set[str]:
    """The distinct shingles of a line's normal form."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _first_met(x: np.ndarray, y: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a band is the first that two lines share."""
    return ~same_before(x, y, place)


def _same_for(x: str, y: str, most: int) -> int:
    """How many characters, most at most, two strings have alike from their begin."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


#: Characters by which a common stretch is found again, and how far ahead it is looked for in both lines.
AGAIN, AHEAD = 12, (1, 3, 6, 10, 16, 24, 40)


def surely_similar(x: str, y: str, n: int, m: int, percent: int) -> bool:
    """Whether two lines are similar by the shingles of common stretches, in order, alone. n and m (distinct hashes of
    shingles) say whether a line has no shingle twice; only then each place of a stretch is a common shingle of its own."""
    places = [max(1, len(t) - SHINGLE + 1) for t in (x, y)]
    if n != places[0] and m != places[1]:
        return False
    wanted = -(-percent * sum(places) // (100 + percent))
    common = i = j = 0
    while True:
        k = _same_for(x[i:], y[j:], min(len(x) - i, len(y) - j))
        common += max(0, k - SHINGLE + 1)
        i, j = i + k, j + k
        if common >= wanted:
            return True
        if common + min(len(x) - i, len(y) - j) - SHINGLE + 1 < wanted:
            return False
        for step in AHEAD:
            found = y.find(x[i + step : i + step + AGAIN], j, j + step + AHEAD[-1] + AGAIN)
            if found >= 0 and i + step + AGAIN <= len(x):
                break
        else:
            return False
        back = 0
        while back < step and found - back > j and x[i + step - back - 1] == y[found - back - 1]:
            back += 1
        i, j = i + step - back, found - back


def dedup_lines(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with one line kept of every component of similar lines: all columns of docs, with the text rebuilt, and
    dropped_lines (array of int, places in the old text) and same_as (array of long: the ids of the documents that hold
    the kept lines, distinct).

    Lines are parted by newlines; two are linked if 100 * common >= percent * union over their distinct 10-character
    shingles, case and white space aside. The kept line is the first by document id, then row, then place in its text.
    A line of fewer than 10 characters is one shingle: it is linked to equal lines only. Blank lines are left alone. A
    text that loses every line becomes empty; the row stays.

    Null and empty texts have no lines and stay as they are; rows with a null id come before others; rows of the same id
    and text are one document: they keep and lose the same lines; columns named dropped_lines or same_as in the input
    are replaced, all others kept, whatever their names; an empty table gives an empty result. Texts and lines of any
    length are taken whole: a task holds one text at a time beside a run of short ones.
    """
    docs = docs.drop("dropped_lines", "same_as")
    key_a, key_b, lost_lines, same = (unused(docs, x) for x in ("row_key_a", "row_key_b", "lost_lines", "same_ids"))
    doc_key = row_key(F.col(id_col), F.col(text_col))
    texts = docs.select(doc_key.alias("doc_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    old = Scratch(docs.sparkSession)
    places = old.write(texts.mapInArrow(_flat_places, "doc_a long, doc_b long, doc_id long, line int, a long, b long, bands binary"), "line-places")
    banded = places().where(F.length("bands") > 0).select("a", "b", "bands")
    live = old.write(shared_keys(banded, banded.count() * BANDS), "shared-bands")

    def lines_of(ids: DataFrame) -> DataFrame:
        """The normal form of each line wanted; lines that the filter stops are not moved."""
        bits = set_bits(ids)

        def run(parts):
            given: set[bytes] = set()
            for part in parts:
                for _, some in text_runs(part.column(0), part.column(0)):
                    lines = list(dict.fromkeys(_lines(some, SHINGLE)[0]))
                    if lines:
                        found = _ids(lines)
                        hit = [i for i in np.flatnonzero(may_hold(bits, found[:, 0])).tolist() if found[i].tobytes() not in given]
                        given.update(found[i].tobytes() for i in hit)
                        if len(given) > KNOWN:
                            given.clear()
                        yield pa.record_batch([_id_array(found[hit]), pa.array([lines[i] for i in hit], pa.string())], names=["id", "set"])

        return described(texts.select("text").mapInArrow(run, f"id {ID}, set string").join(ids.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"]), _hashes)

    linked = link_similar(live, lines_of, live(), BANDS, _first_met, shingle_set, percent, old, partial(surely_similar, percent=percent))
    # Every line id with more than one occurrence, and every linked one. Ids stand as columns, by whose longs rows are sorted.
    linked = linked.select("id.a", "id.b", F.col("component.a").alias("c_a"), F.col("component.b").alias("c_b"))
    repeated = places().groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").join(linked.hint("shuffle_hash"), ["a", "b"], "left_anti")
    group = old.write(linked.union(repeated.select("a", "b", "a", "b")), "line-groups")
    spots = places().select("a", "b", F.struct("doc_id", "doc_a", "doc_b", "line").alias("at")).join(group().hint("shuffle_hash"), ["a", "b"])
    spots = old.write(spots.select("c_a", "c_b", "at"), "line-spots")
    first = old.write(spots().groupBy("c_a", "c_b").agg(F.min("at").alias("first")), "line-firsts")
    lost = spots().join(first().hint("shuffle_hash"), ["c_a", "c_b"]).where("at != first")
    lost = lost.groupBy(F.col("at.doc_a").alias(key_a), F.col("at.doc_b").alias(key_b)).agg(F.sort_array(F.collect_set("at.line")).alias(lost_lines), F.sort_array(F.collect_set("first.doc_id")).alias(same))
    lost = write(lost, "lost-lines")
    old.clear()

    text = F.when(
        F.col(lost_lines).isNotNull(),
        F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(lost_lines, i)), "\n"),
    ).otherwise(F.col(text_col))
    out = docs.withColumns({key_a: doc_key["a"], key_b: doc_key["b"]}).join(lost().hint("shuffle_hash"), [key_a, key_b], "left")
    kept = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))
    return out.select(*kept, none(lost_lines, "int").alias("dropped_lines"), none(same, "long").alias("same_as"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", (lines * (F.col("text") != "").cast("int")).alias("n_lines"), "dropped_lines", "same_as", F.sha2("text", 256).alias("text_sha256"))
