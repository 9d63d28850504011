"""Links between similar sets from shared keys: exact verification and distributed union-find.

Used by line and document deduplication. Candidates share a key. A set meets the leader of its key with the most rows first;
where a key then holds several components, its holders meet its leader; where it still does, they are compared across
components, each pair once, if an exact bound from sketches lets it reach the threshold. Only such pairs become rows; copies
of one text, which are one component by then, are never paired.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, write
from .pretokens import text_runs

#: Longs of a parity sketch: bit b is the parity of the number of elements hashed to b.
SKETCH = 32
#: Rows that one task groups by key, and holders of a key that one task compares with the others.
ROWS_A_TASK, HOLDERS_A_TASK = 1 << 20, 1 << 12
#: Rows of holders that one task takes, and pairs of them that it looks at together.
HOLDER_ROWS_A_TASK, PAIRS_AT_ONCE = 1 << 16, 1 << 17
#: Bits of the filter that leaves texts without candidates where they are: its size is fixed.
FILTER_BITS = 26
#: The low bits of a key are the place of its table.
PLACES = 1 << 8
#: A key with this many rows in a sample of 64 rows a task is dealt to tasks by its ids.
SAMPLED, HOT = 64, 16
#: Rows of one task whose keys agree in so many upper bits move as one value.
SLICE_BITS = 12


def sketches(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity sketches (rows of SKETCH longs) of the runs elements[first[i]:first[i+1]] of distinct hashes."""
    n = len(first) - 1
    bit = (elements >> np.uint64(64 - (SKETCH * 64).bit_length() + 1)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(first))
    odd = np.bincount(owner * (SKETCH * 64) + bit, minlength=n * SKETCH * 64).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, -1), axis=1).view(np.int64)


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Whether two sets of these sizes can reach the threshold."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _close(n: Column, m: Column, x: list[Column], y: list[Column], percent: int) -> Column:
    """Whether the sketches let two sets reach the threshold: of n + m elements, at most 100 - percent in 100 + percent can
    stand in one set only, and where sketches differ at least one does. A part of the sketches is looked at first."""
    bits = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x, y, strict=True)]
    few = reduce(add, bits[: SKETCH // 4])
    most = (100 - percent) * (n + m)
    return ((100 + percent) * few <= most) & ((100 + percent) * reduce(add, bits) <= most)


def same_before(x: np.ndarray, y: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each pair of rows of marks (0: none) whether they share one that stands before its place."""
    return ((x == y) & (x != 0) & (np.arange(x.shape[1]) < place[:, None])).any(axis=1)


def placed_keys(keys: np.ndarray) -> np.ndarray:
    """Keys (a row a set, a column a table) whose low bits are the table's place."""
    return keys & ~np.int64(PLACES - 1) | np.arange(keys.shape[1])


def _of_several(key: np.ndarray, *fields: np.ndarray):
    """The distinct rows whose key has several ids (fields), with the key's rows, in batches."""
    order = np.argsort(key, kind="stable")
    key, fields = key[order], [f[order] for f in fields]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    which = np.repeat(np.arange(len(start)), size)
    stays = np.zeros(len(start), bool)
    for f in fields:
        stays |= np.bincount(which, f != f[start][which], len(start)) > 0
    kept = np.flatnonzero(stays[which])
    columns = [key[kept], *(f[kept] for f in fields)]
    if len(kept):
        again = np.lexsort(columns[::-1])
        new = np.zeros(len(kept), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[again][1:] != c[again][:-1]
        kept = kept[np.sort(again[new])]
    for a in range(0, len(kept), 1 << 16):
        some = kept[a : a + (1 << 16)]
        yield key[some], *(f[some] for f in fields), size[which[some]]


def _dealt(spark: SparkSession, count: int) -> tuple[int, float]:
    """Tasks for so many rows by key, and the share of the rows that is sampled for hot keys."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // ROWS_A_TASK))
    return tasks, min(1.0, SAMPLED * tasks / max(count, 1))


def _hot(keys: DataFrame) -> pa.Table:
    """Of a sample of keys those that fill a good part of a task, with their number: at most SAMPLED / HOT a task."""
    return keys.groupBy("key").count().where(F.col("count") >= HOT).toArrow()


def shared_rows(rows: DataFrame, count: int) -> DataFrame:
    """The distinct rows (key long, id) whose key several ids hold, with c, the key's rows: one shuffle.

    count: the number of rows, or more. A key that fills a good part of a task is found in a sample of bounded size; its
    ids are found by an aggregate, which meets copies of one id before the shuffle and deals the key by its ids. They all
    stay, and c is what the sample says of the key's rows.
    """
    spark = rows.sparkSession
    tasks, share = _dealt(spark, count)
    hot = _hot(rows.select("key").sample(share, 9))
    kind = rows.schema["id"].dataType
    parts_of_id = [F.col(f"id.{f}").alias(f"id_{f}") for f in kind.names] if isinstance(kind, T.StructType) else [F.col("id").alias("id_")]
    dealt = cold = rows.select("key", *parts_of_id)
    if len(hot):
        named = spark.createDataFrame([(k, int(n / share)) for k, n in zip(*hot.to_pydict().values(), strict=True)], "key long, c long")
        cold = dealt.join(F.broadcast(named), "key", "left_anti")

    def run(parts):
        parts = list(parts)
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        for some in _of_several(*(c.to_numpy() for c in t.columns)):
            yield pa.record_batch(list(map(pa.array, some)), names=[*t.column_names, "c"])

    found = cold.repartition(tasks, "key").mapInArrow(run, T.StructType([*dealt.schema.fields, T.StructField("c", T.LongType())]))
    if len(hot):
        found = found.union(dealt.join(F.broadcast(named), "key").select(*found.columns).distinct())
    whole = F.struct(*[F.col(c).alias(c[3:]) for c in found.columns[1:-1]]) if isinstance(kind, T.StructType) else F.col("id_")
    return found.select("key", whole.alias("id"), "c")


def _packs(parts, hot: np.ndarray):
    """Rows (slice, pack): the keys of sets, each with its set's id, by the upper bits of the key; those of hot keys are left out."""
    held, size = [], 0

    def packed():
        rows = np.concatenate(held)
        slices = (rows[:, 0].view(np.uint64) >> np.uint64(64 - SLICE_BITS)).astype(np.uint16)
        order = np.argsort(slices, kind="stable")
        found, start = np.unique(slices[order], return_index=True)
        cuts = np.append(start, len(rows)) * rows.itemsize * rows.shape[1]
        packs = pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(cuts.astype("<i4")), pa.py_buffer(rows[order])])
        return pa.record_batch([pa.array(found, pa.int32()), packs], names=["slice", "pack"])

    for part in parts:
        for rows in _unpacked(part):
            if len(hot):
                rows = rows[~np.isin(rows[:, 0], hot)]
            held.append(rows)
            size += len(rows)
            if size >= ROWS_A_TASK:
                yield packed()
                held, size = [], 0
    if size:
        yield packed()


def _unpacked(part: pa.RecordBatch):
    """Rows (key, a, b) of a batch of a, b and keys (binary, of longs), 2**14 sets at a time."""
    for at in range(0, len(part), 1 << 14):
        a, b, keys = part.slice(at, 1 << 14).columns
        flat = np.frombuffer(b"".join(keys.to_pylist()), np.int64)
        n = pc.binary_length(keys).to_numpy(zero_copy_only=False) // 8
        yield np.stack([flat, np.repeat(a.to_numpy(), n), np.repeat(b.to_numpy(), n)], axis=1)


def shared_keys(sets: DataFrame, count: int) -> DataFrame:
    """As shared_rows, of sets (a, b, keys): an id's two longs and its keys (binary: longs). count: the number of keys, or more.

    Rows of a task that go the same way move as one value."""
    spark = sets.sparkSession
    tasks, share = _dealt(spark, count)
    few = lambda parts: (pa.record_batch([pa.array(r[:, 0])], names=["key"]) for p in parts for r in _unpacked(p))
    hot = _hot(sets.sample(share, 9).mapInArrow(few, "key long"))
    keys, times = hot.column(0).to_numpy(), (hot.column(1).to_numpy() / share).astype(np.int64)
    order = np.argsort(keys)
    keys, times = keys[order], times[order]

    def run(parts):
        rows = [np.frombuffer(x, np.int64).reshape(-1, 3) for p in parts for x in p.column(1).to_pylist()]
        if rows:
            for some in _of_several(*np.ascontiguousarray(np.concatenate(rows).T)):
                yield pa.record_batch(list(map(pa.array, some)), names=["key", "a", "b", "c"])

    def hot_rows(parts):
        for part in parts:
            for rows in _unpacked(part):
                key, a, b = rows[np.isin(rows[:, 0], keys)].T
                yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in (key, a, b)] + [pa.array(times[np.searchsorted(keys, key)])], names=["key", "a", "b", "c"])

    kind = "key long, a long, b long, c long"
    found = sets.mapInArrow(lambda parts: _packs(parts, keys), "slice int, pack binary").repartition(tasks, "slice").mapInArrow(run, kind)
    if len(keys):
        found = found.union(sets.mapInArrow(hot_rows, kind).distinct())
    return found.select("key", F.struct("a", "b").alias("id"), "c")


def set_bits(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size for ids (structs whose a is a hash): bits that they set, by the top bits of a."""
    bit = F.shiftrightunsigned("id.a", 64 - FILTER_BITS)
    one = F.call_function("shiftleft", F.lit(1), F.pmod(bit, F.lit(8)).cast("int"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for byte, held in ids.groupBy(F.shiftright(bit, 3).alias("byte")).agg(F.bit_or(one).alias("bits")).toLocalIterator():
        bits[byte] = held
    return bits


def may_hold(bits: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Whether ids with these a may be among those of set_bits."""
    place = a.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def components(edges: DataFrame, into: Scratch | None = None) -> DataFrame:
    """Union-find over edges (a, b): id, component (its least id) of every id with an edge; its table belongs to into.

    Each round sends the greater neighbours of every id to its least neighbour, then an id and its smaller neighbours to
    the least of these; edges never grow in number, and few rounds leave stars around the least ids. A hub of many edges
    is an aggregate with partial minima and a join, no group. Edges stay in tables.
    """
    old = Scratch(edges.sparkSession)
    ends = old.write(edges.select("a", "b"), "edges")
    star = old.write(ends().where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "star")
    while True:
        seen = star().select(F.col("v").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(star().select("m", F.lit(0), F.lit(1)))
        seen = seen.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if seen.where("up > 1 or up = 1 and down > 0").isEmpty():
            break
        both = star().select(F.col("v").alias("u"), F.col("m").alias("n")).union(star().select("m", "v"))
        low = both.groupBy("u").agg(F.min("n").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = old.write(both.where("n > u").join(low, "u").select(F.col("n").alias("v"), "m"), "large-star")
        root = large().groupBy("v").agg(F.min("m").alias("root"))
        small = large().join(root, "v").where("m != root").select("m", "root").union(root.select("v", "root"))
        star = old.write(small.toDF("v", "m").distinct(), "star")
    alone = ends().select(F.col("a").alias("id")).union(ends().select("b")).distinct()
    labels = alone.join(star().select(F.col("v").alias("id"), "m"), "id", "left").select("id", F.coalesce("m", "id").alias("component"))
    done = (into.write if into else write)(labels, "components")
    old.clear()
    return done()


def verified(pairs: DataFrame, elements: Callable[[str], frozenset | set], percent: int, surely: Callable[[str, str, int, int], bool] | None = None) -> DataFrame:
    """The pairs (a, b) whose texts sa and sb have similar enough sets, compared element by element. surely tells from texts
    and sizes (na, nb) of the sets, at less cost, that a pair is similar; where it doesn't, the sets are compared."""

    def run(parts):
        for part in parts:
            for a in range(0, len(part), 512):
                some = part.slice(a, 512)
                known: dict[str, set] = {}
                keep = []
                for x, y, n, m in zip(*(some.column(i).to_pylist() for i in range(2, 6)), strict=True):
                    if surely and surely(x, y, n, m):
                        keep.append(True)
                        continue
                    for t in (x, y):
                        if t not in known:
                            known[t] = elements(t)
                    common = len(known[x] & known[y])
                    keep.append(100 * common >= percent * (len(known[x]) + len(known[y]) - common))
                yield some.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kept = T.StructType([pairs.schema["a"], pairs.schema["b"]])
    return pairs.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, kept)


def described(texts: DataFrame, hashes: Callable[[list[str]], list[np.ndarray]]) -> DataFrame:
    """id and set (the text) with n, the size of its set, and the set's sketch; hashes gives the distinct hashes."""

    def run(parts):
        for part in parts:
            at = 0
            for some, found in text_runs(part.column(1), part.column(1)):
                sets = hashes(found)
                first = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets])
                for a in range(0, len(sets), 64):
                    b = min(a + 64, len(sets))
                    marks = sketches(flat[first[a] : first[b]], first[a : b + 1] - first[a])
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(marks.ravel()), SKETCH).cast(pa.list_(pa.int64()))
                    yield pa.record_batch([part.column(0).slice(at + a, b - a), pa.array(found[a:b], pa.string()), pa.array(np.diff(first[a : b + 1])), lists], names=["id", "set", "n", "sketch"])
                at += len(some)

    kind = T.StructType([texts.schema["id"], T.StructField("set", T.StringType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
    return texts.select("id", "set").mapInArrow(run, kind)


def _fields(kind: T.DataType, name: str, named: str) -> list[Column]:
    """The fields of a struct, or a plain column, as columns."""
    return [F.col(f"{name}.{f}").alias(f"{named}{i}") for i, f in enumerate(kind.names)] if isinstance(kind, T.StructType) else [F.col(name).alias(f"{named}0")]


def _whole(kind: T.DataType, named: str) -> Column:
    """The column that _fields took apart."""
    return F.struct(*[F.col(f"{named}{i}").alias(f) for i, f in enumerate(kind.names)]) if isinstance(kind, T.StructType) else F.col(f"{named}0")


def near_pairs(holders: DataFrame, count: int, percent: int, first_met: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None) -> DataFrame:
    """Pairs (a, b) of holders of one key, of different labels, that their sizes and sketches let reach the threshold.

    holders: key, id, c (label), top (whether that is the key's greatest component), tasks, n, sketch and, with first_met, marks;
    without, a pair comes once for every key that its ids share. A key's holders are
    dealt to tasks * tasks blocks of those that look for others and those that are looked for; those in the greatest
    component do not look, and two others meet once. A task holds its blocks' sketches as arrays. count: the sum of 2 * tasks
    over holders.
    """
    kind, label = holders.schema["id"].dataType, holders.schema["c"].dataType
    own, every = F.pmod(F.hash("id"), "tasks"), F.sequence(F.lit(0), F.col("tasks") - 1)
    block = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    # Bit 1 of side: is looked for; bit 0: looks for others.
    sought = F.transform(every, lambda i: block(i, own, F.when((i == own) & ~F.col("top"), 3).otherwise(2)))
    seeking = F.transform(F.filter(every, lambda j: (j != own) & ~F.col("top")), lambda j: block(own, j, F.lit(1)))
    ids, labels = _fields(kind, "id", "id_"), _fields(label, "c", "c_")
    lists = ["sketch", "marks"] if first_met else ["sketch"]
    # Most keys are one block.
    many, whole = holders.where("tasks > 1"), F.when(F.col("top"), 2).otherwise(3).alias("side")
    dealt = many.select("key", F.explode(F.concat(sought, seeking)).alias("_b"), "top", "n", *lists, *ids, *labels)
    dealt = dealt.select("key", "_b.i", "_b.j", "_b.side", "top", "n", *lists, *[f"id_{i}" for i in range(len(ids))], *[f"c_{i}" for i in range(len(labels))])
    dealt = dealt.union(holders.where("tasks = 1").select("key", F.lit(0), F.lit(0), whole, "top", "n", *lists, *ids, *labels))
    tasks = max(int(holders.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // HOLDER_ROWS_A_TASK))
    n_ids, n_labels = len(ids), len(labels)

    def run(parts):
        parts = [p for p in parts if len(p)]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        key, i, j, side, top, n = (t.column(c).to_numpy() for c in range(6))
        sketch, *marks = (t.column(c).chunk(0).flatten().to_numpy().reshape(len(t), -1) for c in lists)
        sketch = sketch.view(np.uint64)  # of a signed number, the bits of its absolute value would be counted
        rest = [c.to_numpy() for c in t.columns[-(n_ids + n_labels) :]]
        order = np.lexsort((n, j, i, key))
        moved = np.zeros(len(order), np.int64)
        for c in (key, i, j):
            moved[1:] |= c[order][1:] != c[order][:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(moved)
        seeks, sought = (order[(side[order] & bit) > 0] for bit in (1, 2))
        # Sought rows stand by group and size: those whose size fits are a stretch.
        apart = int(n.max()) * 100 // percent + 2
        at = group[sought] * apart + n[sought]
        low = np.searchsorted(at, group[seeks] * apart - (-percent * n[seeks] // 100), side="left")
        high = np.searchsorted(at, group[seeks] * apart + np.minimum(100 * n[seeks] // percent, apart - 1), side="right")
        size = np.maximum(high - low, 0)
        before = np.concatenate([[0], np.cumsum(size)])
        a = 0
        while a < len(seeks):
            b = max(a + 1, int(np.searchsorted(before, before[a] + PAIRS_AT_ONCE, side="right")) - 1)
            x = np.repeat(seeks[a:b], size[a:b])
            y = sought[np.arange(before[a], before[b]) - np.repeat(before[a:b] - low[a:b], size[a:b])]
            a = b
            less = np.zeros(len(x), bool)
            for c in reversed(rest[n_ids:]):
                less = (c[x] < c[y]) | (c[x] == c[y]) & less
            for words in (slice(0, SKETCH // 4), slice(SKETCH // 4, SKETCH)):
                if words.start == 0:
                    able, differ = top[y] | less, 0
                x, y = x[able], y[able]
                differ = (differ[able] if words.start else 0) + np.bitwise_count(sketch[x, words] ^ sketch[y, words]).sum(axis=1, dtype=np.int64)
                able = (100 + percent) * differ <= (100 - percent) * (n[x] + n[y])
            x, y = x[able], y[able]
            for m in marks:
                able = first_met(m[x], m[y], key[x] & (PLACES - 1))
                x, y = x[able], y[able]
            if len(x):
                yield pa.record_batch([pa.array(c[z]) for z in (x, y) for c in rest[:n_ids]], names=[f"{z}_{k}" for z in "xy" for k in range(n_ids)])

    flat = kind.fields if isinstance(kind, T.StructType) else [T.StructField("id", kind)]
    found = T.StructType([T.StructField(f"{z}_{k}", f.dataType) for z in "xy" for k, f in enumerate(flat)])
    met = dealt.repartition(tasks, "key", "i", "j").mapInArrow(run, found)
    return met.select(_whole(kind, "x_").alias("a"), _whole(kind, "y_").alias("b"))


def link_similar(
    live: Callable[[], DataFrame],
    sets_of: Callable[[DataFrame], DataFrame],
    marks: DataFrame,
    n_marks: int,
    first_met: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None,
    elements: Callable[[str], set],
    percent: int,
    into: Scratch,
    surely: Callable[[str, str, int, int], bool] | None = None,
) -> DataFrame:
    """Components of the sets linked by 100 * common >= percent * union: id, component (least id), for linked ids.

    live: rows of shared_rows: which sets are candidates for each other: those that share a key. sets_of(ids) gives
    (id, set, n, sketch), see described; it is asked for candidates only. elements gives a text's set for verification;
    surely, see verified.
    marks: rows (id, key) of keys with places under n_marks, an id at most one for a place; first_met tells from those of
    pairs of holders (a column a place, 0 where there is none) and the place of a key that they share whether it is the
    first they share, so that a pair is met once. Without first_met, for few places, pairs that are met again are dropped.

    Exact among candidates; no pair is skipped by a cap. The leader of a key is the set with the most company in all its
    keys, mostly the original of a family of copies. A set first meets the leader of one key, that with the most rows: a
    family becomes one component by one row a member. Where a key then holds several components, its holders meet its
    leader; where it still does, they meet each other across components. Pairs become rows there only if the sketches let
    them reach the threshold; a key with many holders is dealt to several tasks, and what is in its greatest component is
    not compared with itself. The tables that the result reads belong to into.
    """
    old = Scratch(marks.sparkSession)
    # The key with the most rows by its size and its upper bits: one of many keys that agree in both only adds candidates.
    best = F.least(F.col("c"), F.lit((1 << 20) - 1)) * F.lit(1 << 43) + F.shiftrightunsigned("key", 21)
    ids = old.write(live().groupBy("id").agg(F.sum("c").alias("company"), F.max(best).alias("best")), "candidates")
    # From here a set goes by a number, which the written table fixes: it sorts and moves as one long.
    sets = old.write(sets_of(ids().select("id")).withColumn("num", F.monotonically_increasing_id()), "candidate-sets")
    fit = old.write(sets().select("id", "num", "n").join(ids().hint("shuffle_hash"), "id"), "candidate-sizes")
    order = F.struct(-F.col("company"), "n", "num")
    able = (F.col("num") != F.col("y.num")) & _fits(F.col("n"), F.col("y.n"), percent)
    leaders = fit().groupBy("best").agg(F.min_by(F.struct("num", "n"), order).alias("y"))
    tried = old.write(fit().join(leaders.hint("shuffle_hash"), "best").where(able).select(F.col("num").alias("a"), F.col("y.num").alias("b")), "tried")
    links = old.write(_checked(tried(), sets, percent, elements, surely), "links")
    labels = components(links(), old)

    label = F.coalesce("component", "num").alias("c")
    named = lambda: labels.select(F.col("id").alias("num"), "component")
    held = fit().join(named().hint("shuffle_hash"), "num", "left").select("id", "num", "n", "company", label)
    held = old.write(live().select("key", "id").join(held.hint("shuffle_hash"), "id").drop("id"), "bucket-labels")
    open_keys = held().groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("key")
    open_rows = old.write(held().join(open_keys.hint("shuffle_hash"), "key"), "open-buckets")
    leaders = open_rows().groupBy("key").agg(F.min_by(F.struct("num", "n", "c"), order).alias("y"))
    asked = open_rows().join(leaders.hint("shuffle_hash"), "key").where(able & (F.col("c") != F.col("y.c"))).select(F.col("num").alias("a"), F.col("y.num").alias("b"))
    more = old.write(_checked(asked.distinct().join(tried().hint("shuffle_hash"), ["a", "b"], "left_anti"), sets, percent, elements, surely), "leader-links")
    labels = _merged(labels, more, old)

    held = old.write(open_rows().select("key", "num").join(named().hint("shuffle_hash"), "num", "left").select("key", "num", label), "open-labels")
    # Of two holders the leader's comparison has decided.
    sized = held().groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key")
    sized = sized.agg(F.sum("m").alias("m"), F.count("*").alias("kinds"), F.max_by("c", F.struct("m", "c")).alias("greatest")).where("kinds > 1 and m > 2")
    open_keys = old.write(sized.select("key", "greatest", "m", F.ceil(F.col("m") / HOLDERS_A_TASK).cast("int").alias("tasks")), "open-keys")
    still = old.write(held().join(open_keys().hint("shuffle_hash"), "key").select("key", F.col("num").alias("id"), "c", (F.col("c") == F.col("greatest")).alias("top"), "tasks"), "open-rows")
    count = open_keys().agg(F.coalesce(F.sum(F.col("m") * (2 * F.col("tasks") - 1)), F.lit(0))).first()[0]
    sketched = sets().select(F.col("num").alias("id"), "n", "sketch")
    if first_met:
        asked_for = old.write(fit().join(still().select(F.col("id").alias("num")).distinct(), "num", "left_semi").select("id", "num"), "open-ids")
        place = F.col("key").bitwiseAND(F.lit(PLACES - 1))
        marked = marks.join(asked_for(), "id").groupBy(F.col("num").alias("id")).agg(F.array(*[F.coalesce(F.max(F.when(place == i, F.col("key"))), F.lit(0).cast("long")) for i in range(n_marks)]).alias("marks"))
        sketched = sketched.join(marked, "id")
    near = near_pairs(still().join(sketched.hint("shuffle_hash"), "id"), count, percent, first_met)
    near = near if first_met else near.distinct()
    more = old.write(_checked(near, sets, percent, elements, surely), "more-links")
    labels = _merged(labels, more, old)

    whole = fit().select(F.col("num"), F.col("id").alias("whole"))
    found = old.write(labels.join(whole, F.col("id") == F.col("num")).select("whole", "component"), "whole-labels")
    least = found().groupBy("component").agg(F.min("whole").alias("least"))
    labels = into.write(found().join(least, "component").select(F.col("whole").alias("id"), F.col("least").alias("component")), "components")()
    old.clear()
    return labels


def _merged(labels: DataFrame, more: Callable[[], DataFrame], into: Scratch) -> DataFrame:
    """Components with more links, between components, of which each has one label."""
    if more().isEmpty():
        return labels
    old = Scratch(labels.sparkSession)
    name = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_label"))
    joined = more().join(name("a"), "a", "left").join(name("b"), "b", "left")
    joined = joined.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).distinct()
    joined = components(joined, old).select(F.col("id").alias("component"), F.col("component").alias("root"))
    named = labels.join(joined, "component", "full").select(F.coalesce("id", "component").alias("id"), F.coalesce("root", "component").alias("component"))
    labels = into.write(named, "components")()
    old.clear()
    return labels


def _checked(pairs: DataFrame, sets: Callable[[], DataFrame], percent: int, elements: Callable[[str], set], surely: Callable[[str, str, int, int], bool] | None) -> DataFrame:
    """The similar pairs of pairs, by texts. A number is one row of sets, so a task holds few of them as a table, and pairs
    need not be sorted."""
    one = sets().select(F.col("num").alias("a"), F.col("set").alias("sa"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    two = sets().select(F.col("num").alias("b"), F.col("set").alias("sb"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    x, y = ([F.col(c)[i] for i in range(SKETCH)] for c in "xy")
    return verified(pairs.join(one.hint("shuffle_hash"), "a").join(two.hint("shuffle_hash"), "b").where(_close(F.col("na"), F.col("nb"), x, y, percent)), elements, percent, surely)
