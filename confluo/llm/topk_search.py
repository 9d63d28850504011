"""Exact top-k inner-product search: a KD-tree in every shard, searched best box first.

A tree over a bounded sample cuts space into cells; a cell's rows are one shard, or several if they are many. A query is
searched in its own shard first; the k-th best score found there is carried on, to the cells whose boxes can reach it and,
inside these, to the boxes of each shard's tree.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, write

FOUND = "query_key long, query_id long, vec_id long, score long"
#: Queries that go through a tree together.
TOGETHER = 64


class KdTree:
    """Median splits along the widest side down to leaves; every node has its tight bounding box."""

    def __init__(self, x: np.ndarray, leaf_rows: int = 64):
        self.order, self.side, self.cut, self.children, self.part = np.arange(len(x)), [], [], [], []
        low, high, todo = [], [], [(0, len(x), -1)]
        while todo:
            a, b, above = todo.pop()
            node, part = len(self.part), x[self.order[a:b]]
            low.append(part.min(0))
            high.append(part.max(0))
            self.part.append((a, b))
            self.children.append([])
            if above >= 0:
                self.children[above].append(node)
            side = int(np.argmax(high[-1] - low[-1])) if b - a > leaf_rows else 0
            self.side.append(side)
            self.cut.append(None)
            if b - a > leaf_rows:
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argsort(part[:, side], kind="stable")]
                self.cut[node] = x[self.order[a + middle - 1], side]
                todo += [(a + middle, b, node), (a, a + middle, node)]
        self.low, self.high = np.array(low), np.array(high)

    def bound(self, q: np.ndarray, node: int) -> np.ndarray:
        """The most that a row in the node's box can score with each query."""
        return np.maximum(q, 0) @ self.high[node] + np.minimum(q, 0) @ self.low[node]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf (node) whose side of every cut each row is on."""
        leaf, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            leaf[rows] = node
            if self.children[node] and len(rows):
                left = x[rows, self.side[node]] <= self.cut[node]
                todo += list(zip(self.children[node], (rows[left], rows[~left]), strict=True))
        return leaf

    def search(self, ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (place of the query, id, score) of the k best of each query, ties to smaller ids; none scores under
        least, a k-th best score known before; rows with the query's own id are passed over.

        Nodes wait in a heap by the best bound of the queries that reach them; a node is opened for the queries whose
        k-th score its box can still reach, and the search ends when no box in the heap can reach any.
        """
        found = []
        for a in range(0, len(q), TOGETHER):
            rows = np.arange(a, min(a + TOGETHER, len(q)))
            best = [[] for _ in rows]  # (-score, id), the k best so far
            kth = [int(v) for v in least[rows]]
            bound = self.bound(q[rows], 0)
            heap = [(-bound.max(), 0, rows, bound)]
            while heap:
                top, node, some, bound = heappop(heap)
                floor = np.array([kth[i - a] for i in some], dtype=object if q.dtype == object else None)
                if -top < min(kth):
                    break
                some = some[bound >= floor]
                if not len(some):
                    continue
                if self.children[node]:
                    for child in self.children[node]:
                        reach = self.bound(q[some], child)
                        heappush(heap, (-reach.max(), child, some, reach))
                    continue
                here = self.order[slice(*self.part[node])]
                scores = q[some] @ x[here].T
                for i, row in zip(some, scores, strict=True):
                    good = np.flatnonzero((row >= kth[i - a]) & (ids[here] != own[i]))
                    if len(good):
                        held = best[i - a]
                        held += zip((-row[good]).tolist(), ids[here[good]].tolist(), strict=True)
                        held.sort()
                        del held[k:]
                        if len(held) == k:
                            kth[i - a] = max(kth[i - a], int(-held[-1][0]))
            found += [(i, who, -score) for i, held in zip(rows.tolist(), best, strict=True) for score, who in held]
        return tuple(np.array(c, dtype=object) for c in zip(*found, strict=True)) if found else (np.zeros(0, object),) * 3


def _columns(t: pa.Table, id_col: str = "vec_id") -> tuple[np.ndarray, np.ndarray]:
    v = t["v"].combine_chunks()
    return t[id_col].to_numpy(), v.flatten().to_numpy().reshape(len(t), -1)


def _exact(*parts: np.ndarray) -> list[np.ndarray]:
    """As doubles where no sum of products can pass 2**53, which is fast and exact; else as integers of any size."""
    most = max((float(np.abs(x).max()) for x in parts if x.size), default=0.0)
    if most**2 * max(x.shape[1] for x in parts) < 1 << 53:
        return list(parts)
    return [np.array([[int(c) for c in row] for row in x.tolist()], dtype=object).reshape(x.shape) for x in parts]


def _search(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    if not len(rows) or not len(queries):
        return pa.table({c: pa.array([], pa.int64()) for c in ("query_key", "query_id", "vec_id", "score")})
    (ids, x), (own, q) = _columns(rows), _columns(queries)
    least = queries["least"].to_numpy() if "least" in queries.column_names else np.full(len(own), np.iinfo(np.int64).min)
    x, q = _exact(x, q)
    place, who, score = KdTree(x).search(ids, x, own, q, k, least)
    place = place.astype(np.int64)
    # A score that doesn't fit a long fails here.
    score = pa.array([int(s) for s in score], pa.int64())
    return pa.table({"query_key": queries["query_key"].to_numpy()[place], "query_id": own[place], "vec_id": pa.array(who.tolist(), pa.int64()), "score": score})


def _box(t: pa.Table) -> pa.Table:
    """The box around the boxes of one cell."""
    (_, low), (_, high) = (_columns(t.select(["cell", c]).rename_columns(["cell", "v"]), "cell") for c in ("low", "high"))
    return pa.table({"cell": t["cell"].slice(0, 1), "low": [low.min(0)], "high": [high.max(0)]})


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096, block_queries: int = 8192, most_cells: int = 2048
) -> DataFrame:
    """The k best rows for every row that is_query selects, against all other rows: query_id, rank, vec_id, score.

    A component x counts as floor(64 * x); the score is the integer inner product, ties go to the smaller id. Exact for
    components of any finite size; a score in a result that doesn't fit a long fails the job.

    Rows with a null id, and vectors that are null, empty or hold null or non-finite components, take no part. Vectors are
    compared with those of the same length only. Rows that share the query's id are passed over; repeated rows of
    another id each count. Query rows equal in id and vector are one query; each different vector of an id gets its k
    rows, under that id. Other columns are ignored, whatever their names; an empty table gives an empty result.

    Cells come from a sample of at most 16 * most_cells vectors; they hold all rows. A task holds one shard (about
    shard_rows vectors, whatever their values) and one block of queries; queries, not rows, travel, to the shards of the
    cells that can hold better rows than their own shard; a second block of queries costs another pass over the shards.
    Equal vectors are one cell, dealt at random to shards, so a vector that fills a third of the table is no hot group.
    """
    spark, old = vectors.sparkSession, Scratch(vectors.sparkSession)
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    named = vectors.where(fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, _floor).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    stored = old.write(named, "topk-vectors")
    rows = stored().count()
    cells = max(1, min(most_cells, rows // shard_rows))
    trees = {}
    if cells > 1:
        sample = stored().sample(min(1.0, 16 * cells / rows), 6).select("v").toArrow()["v"].combine_chunks()
        sizes = np.diff(sample.offsets.to_numpy())
        for dim in np.unique(sizes).tolist():
            part = sample.filter(pa.array(sizes == dim)).flatten().to_numpy().reshape(-1, dim)
            trees[dim] = KdTree(part, 16)

    def routed(parts):
        for part in parts:
            v = part.column(1)
            sizes = np.diff(v.offsets.to_numpy())
            cell = np.zeros(len(part), np.int64)
            for dim in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == dim)
                if dim in trees:
                    cell[some] = trees[dim].leaf_of(v.take(pa.array(some)).flatten().to_numpy().reshape(-1, dim))
                cell[some] += dim << 32  # cells of vectors of different lengths differ
            yield pa.record_batch([part.column(0), v, part.column(2), pa.array(cell)], names=["vec_id", "v", "asks", "cell"])

    placed = old.write(stored().mapInArrow(routed, "vec_id long, v array<double>, asks boolean, cell long").withColumn("place", F.rand(6)), "topk-placed")
    # At most most_cells rows for a length of vectors.
    shards = old.write(placed().groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "topk-shards")
    dealt = placed().join(F.broadcast(shards()), "cell").withColumn("shard", F.floor(F.col("place") * F.col("shards")).cast("int"))
    queries = placed().where("asks").groupBy("vec_id", "v").agg(F.min_by("cell", "place").alias("cell"), F.min("place").alias("place"))
    queries = queries.join(F.broadcast(shards()), "cell").withColumn("shard", F.floor(F.col("place") * F.col("shards")).cast("int"))
    queries = old.write(queries.select(F.monotonically_increasing_id().alias("query_key"), "vec_id", "v", "cell", "shard"), "topk-queries")
    blocks = max(1, -(-queries().count() // block_queries))
    block = F.pmod(F.xxhash64("query_key"), F.lit(blocks)).cast("int").alias("block")

    keys = ("cell", "shard", "block")
    everywhere = dealt.select("vec_id", "v", "cell", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(rows: pa.Table, asking: pa.Table) -> pa.Table:
        return _search(rows, asking, k)

    at_home = queries().select("query_key", "vec_id", "v", "cell", "shard", block)
    home = old.write(everywhere.groupBy(*keys).cogroup(at_home.groupBy(*keys)).applyInArrow(search, FOUND), "topk-home")

    def boxes(parts):
        for part in parts:
            cell, v = part.column(0).to_numpy(), part.column(1)
            for c in np.unique(cell):
                _, held = _columns(pa.table({"vec_id": cell[cell == c], "v": v.filter(pa.array(cell == c))}))
                yield pa.record_batch([pa.array([c]), pa.array([held.min(0)]), pa.array([held.max(0)])], names=["cell", "low", "high"])

    kind = "cell long, low array<double>, high array<double>"
    held = placed().select("cell", "v").mapInArrow(boxes, kind).groupBy("cell").applyInArrow(_box, kind).toArrow()
    by_dim: dict[int, list] = {}
    for cell, low, high in zip(*(held[c].to_pylist() for c in ("cell", "low", "high")), strict=True):
        by_dim.setdefault(len(low), []).append((cell, low, high))
    known = {dim: (np.array([c for c, _, _ in of]), np.array([b for _, b, _ in of]), np.array([b for _, _, b in of])) for dim, of in by_dim.items()}

    def reached(parts):
        """For each query, the cells whose boxes can reach its k-th score."""
        for part in parts:
            v, least = part.column(2), part.column(3).to_numpy()
            sizes = np.diff(v.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                of, low, high = known[dim]
                some = np.flatnonzero(sizes == dim)
                for a in range(0, len(some), 256):
                    few = some[a : a + 256]
                    q, low_, high_ = _exact(v.take(pa.array(few)).flatten().to_numpy().reshape(-1, dim), low, high)
                    may = np.maximum(q, 0) @ high_.T + np.minimum(q, 0) @ low_.T >= least[few, None]
                    row, cell = np.nonzero(may.astype(bool))
                    at = pa.array(few[row])
                    yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), v.take(at), pa.array(least[few[row]]), part.column(4).take(at), part.column(5).take(at), pa.array(of[cell])], names=asked.names)

    least = home().groupBy("query_key").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    asking = queries().join(least, "query_key", "left").select("query_key", "vec_id", "v", F.coalesce("least", F.lit(-(1 << 63))).alias("least"), F.col("cell").alias("home"), F.col("shard").alias("home_shard"))
    asked = asking.withColumn("cell", F.lit(0).cast("long")).schema
    abroad = asking.mapInArrow(reached, asked).join(F.broadcast(shards()), "cell")
    abroad = abroad.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), block).where((F.col("cell") != F.col("home")) | (F.col("shard") != F.col("home_shard")))
    abroad = abroad.select("query_key", "vec_id", "v", "least", *keys)
    found = everywhere.groupBy(*keys).cogroup(abroad.groupBy(*keys)).applyInArrow(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id"))
    done = write(home().unionByName(found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk-found")
    old.clear()
    return done()


def _floor(c: Column) -> Column:
    """floor(64 * c) as a double, exact for every finite component: beyond 2**52 a double is whole."""
    c = c.cast("double") * 64
    return F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
