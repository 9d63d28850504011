"""Gradient boosting with histograms, best leaf first: every task holds its rows' bins, and histograms are summed among tasks."""

from __future__ import annotations

import heapq
import math
import socket
import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..sources.scratch import Scratch
from .regress import valid_rows

#: Rows that one task holds, if there are as many tasks at a time; bins of a feature.
ROWS_A_TASK, BINS = 1 << 20, 255
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, gain double"


@dataclass
class Settings:
    """The published settings: the rows of a tree are all rows, as without a bagging frequency the share of rows is unused."""

    trees: int = 500
    rate: float = 0.03
    leaves: int = 31
    least: int = 30
    columns: float = 0.9
    l2: float = 1.0
    seed: int = 42


@dataclass
class Model:
    """Nodes of all trees, one after the other: feature -1 is a leaf; a row goes left if its feature is at most the threshold."""

    features: list[str]
    base: float | None
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan if self.base is None else self.base)
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            moving = np.arange(len(x))
            while len(moving):
                node = at[moving]
                inner = self.feature[node] >= 0
                moving, node = moving[inner], node[inner]
                goes = x[moving, self.feature[node]] <= self.threshold[node]
                at[moving] = np.where(goes, self.left[node], self.right[node])
            out += self.value[at]
        return out


class _Sum:
    """Sums arrays among the tasks of a barrier stage: the first task adds what all others send, and sends the sum back.

    The stage's own messages take a second each, too long for one a split; they only tell the first task's address. A task
    that is lost breaks its connections, so the stage fails and starts again."""

    def __init__(self, context: BarrierTaskContext, tasks: int, patience: float = 600.0):
        self.links: list[socket.socket] = []
        self.first = context.partitionId() == 0
        if tasks == 1:
            return
        server = socket.create_server(("", 0)) if self.first else None
        said = context.allGather(str(server.getsockname()[1]) if server else "")
        if server:
            server.settimeout(patience)
            ranked = []
            for _ in range(tasks - 1):
                link = server.accept()[0]
                link.settimeout(patience)
                ranked.append((struct.unpack("<i", _exactly(link, 4))[0], link))
            self.links = [link for _, link in sorted(ranked, key=lambda r: r[0])]
            server.close()
        else:
            host = context.getTaskInfos()[0].address.rsplit(":", 1)[0]
            link = socket.create_connection((host, int(said[0])), patience)
            link.sendall(struct.pack("<i", context.partitionId()))
            self.links = [link]
        for link in self.links:
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def __call__(self, mine: np.ndarray) -> np.ndarray:
        out = np.ascontiguousarray(mine, float)
        if self.first:
            for link in self.links:
                out = out + np.frombuffer(_exactly(link, out.nbytes)).reshape(out.shape)
            for link in self.links:
                link.sendall(out.tobytes())
            return out
        self.links[0].sendall(out.tobytes())
        return np.frombuffer(_exactly(self.links[0], out.nbytes)).reshape(out.shape)

    def close(self) -> None:
        for link in self.links:
            link.close()


def _exactly(link: socket.socket, n: int) -> bytes:
    out = bytearray()
    while len(out) < n:
        more = link.recv(min(1 << 20, n - len(out)))
        if not more:
            raise ConnectionError("a task of the stage is gone")
        out += more
    return bytes(out)


def _best(sums: np.ndarray, counts: np.ndarray, use: np.ndarray, s: Settings) -> tuple[float, int, int]:
    """Gain, feature and bin of a leaf's best split from its histograms (features by bins); no gain if there is none."""
    g, n = np.cumsum(sums, 1), np.cumsum(counts, 1)
    total, size = g[0, -1], n[0, -1]
    other = size - n
    ok = (n >= s.least) & (other >= s.least) & use[:, None]
    if not ok.any():
        return 0.0, -1, -1
    gain = np.where(ok, g**2 / (n + s.l2) + (total - g) ** 2 / (other + s.l2) - total**2 / (size + s.l2), -np.inf)
    f, b = divmod(int(gain.argmax()), gain.shape[1])
    return float(gain[f, b]), f, b


def _grow(codes: np.ndarray, x: np.ndarray, grad: np.ndarray, use: np.ndarray, s: Settings, summed) -> tuple[list[list], list[tuple[int, np.ndarray]]]:
    """A tree: nodes [feature, bin, left, right, value, gain], and the task's rows of each leaf."""
    p = x.shape[1]

    def histograms(rows: np.ndarray) -> np.ndarray:
        flat = codes[rows].ravel()
        mine = np.stack([np.bincount(flat, np.repeat(grad[rows], p), p * BINS), np.bincount(flat, minlength=p * BINS)])
        return summed(mine).reshape(2, p, BINS)

    nodes: list[list] = []
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[float, int, int, int]] = []

    def leaf(rows: np.ndarray, h: np.ndarray) -> int:
        total, size = h[0, 0].sum(), h[1, 0].sum()
        at = len(nodes)
        nodes.append([-1, 0, -1, -1, -s.rate * total / (size + s.l2), 0.0])
        held[at] = rows, h
        gain, f, b = _best(h[0], h[1], use, s)
        if gain > 1e-12:
            heapq.heappush(heap, (-gain, at, f, b))
        return at

    everything = np.arange(len(x))
    leaf(everything, histograms(everything))
    while heap and len(held) < s.leaves:
        gain, at, f, b = heapq.heappop(heap)
        rows, h = held.pop(at)
        goes = x[rows, f] <= b
        # The smaller side, of all tasks together, is counted; the other is what remains.
        small_left = 2 * h[1, f, : b + 1].sum() <= h[1, f].sum()
        small = histograms(rows[goes] if small_left else rows[~goes])
        one, two = (small, h - small) if small_left else (h - small, small)
        nodes[at] = [f, b, leaf(rows[goes], one), leaf(rows[~goes], two), 0.0, -gain]
    return nodes, [(at, rows) for at, (rows, _) in held.items()]


def fit(df: DataFrame, features: Sequence[str], target: str, settings: Settings | None = None, rows_a_task: int = ROWS_A_TASK) -> Model:
    """A model of squared error on the rows of df, whose features and target are not null (rows with nulls are left out).

    Features are cut into bins at approximate quantiles. The rows are dealt to as many tasks of one barrier stage as their
    number asks for, at most as many as run at a time; each keeps its rows as bins. A tree grows at the leaf of greatest gain;
    the tasks sum their histograms and so decide alike. The driver gets the nodes, a bounded number. Lost executors start
    the stage again, from a written table. Without rows the model predicts nothing.
    """
    s, names = settings or Settings(), list(features)
    spark = df.sparkSession
    with Scratch(spark) as old:
        rows = old.write(df.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(target).cast("double").alias("_y")).dropna(), "boost-rows")
        shares = [k / BINS for k in range(1, BINS)]
        n, *cuts = rows().agg(F.count("*"), *[F.percentile_approx(c, F.array(*map(F.lit, shares)), 20_000) for c in names]).first()
        if not n:
            return Model(names, None, *(np.zeros(0, int) for _ in range(7)))
        edges = [np.unique(c) for c in cuts]
        tasks = min(max(1, -(-n // rows_a_task)), spark.sparkContext.defaultParallelism)

        def train(parts):
            held = [p for p in parts]
            rows = pd.concat(held) if held else pd.DataFrame({c: np.zeros(0) for c in [*names, "_y"]})
            y = rows["_y"].to_numpy()
            x = np.column_stack([np.searchsorted(e, rows[c].to_numpy()) for c, e in zip(names, edges, strict=True)]).astype(np.uint8)
            codes = x.astype(np.int32) + np.arange(len(names), dtype=np.int32) * BINS
            context = BarrierTaskContext.get()
            summed = _Sum(context, tasks)
            total, size = summed(np.array([y.sum(), float(len(y))]))
            guess = np.full(len(y), total / size)
            out = [(-1, 0, -1, 0.0, -1, -1, total / size, 0.0)]
            for tree in range(s.trees):
                use = np.zeros(len(names), bool)
                use[np.random.default_rng((s.seed, tree)).choice(len(names), max(1, round(s.columns * len(names))), replace=False)] = True
                nodes, leaves = _grow(codes, x, guess - y, use, s, summed)
                for at, mine in leaves:
                    guess[mine] += nodes[at][4]
                for at, (f, b, left, right, value, gain) in enumerate(nodes):
                    cut = edges[f][b] if f >= 0 and b < len(edges[f]) else math.inf
                    out.append((tree, at, f, cut, left, right, value, gain))
            summed.close()
            if context.partitionId() == 0:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])

        found = rows().repartition(tasks).mapInPandas(train, NODES, barrier=True).toPandas().sort_values(["tree", "node"])
    base, nodes = float(found["value"].iloc[0]), found.iloc[1:]
    first = nodes["node"].to_numpy() == 0
    roots = np.flatnonzero(first)
    shift = roots[np.cumsum(first) - 1] if len(roots) else roots
    at = lambda c: np.where(nodes[c] >= 0, nodes[c] + shift, -1)
    return Model(names, base, roots, nodes["feature"].to_numpy(), nodes["threshold"].to_numpy(), at("left"), at("right"), nodes["value"].to_numpy(), nodes["gain"].to_numpy())


def predicted(df: DataFrame, model: Model, where: Column) -> DataFrame:
    """Adds pred, not under 0, in rows where the condition holds; null in others and without a fitted model. The model is a few
    megabytes at most (its nodes are bounded by its settings)."""

    @F.pandas_udf("double")
    def guess(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.column_stack([c.to_numpy(float) for c in columns])))

    good = df.where(where)
    some = good.withColumn("pred", F.lit(None).cast("double") if model.base is None else clip(guess(*[F.col(c).cast("double") for c in model.features]), 0.0))
    return some.unionByName(df.where(~F.coalesce(where, F.lit(False))).withColumn("pred", F.lit(None).cast("double")))


def corrected(df: DataFrame, features: Sequence[str], positive: Sequence[str], target: str, fit_on: Column, settings: Settings | None = None) -> tuple[DataFrame, Model]:
    """df with pred, and the model, fitted on valid rows (see valid_rows) with a positive target where fit_on holds."""
    good = valid_rows(features, positive)
    model = fit(df.where(good & fit_on & (F.col(target) > 0)), features, target, settings)
    return predicted(df, model, good), model


def importances(df: DataFrame, model: Model) -> DataFrame:
    """feature, splits (how many) and gain (their sum) of the model, in a DataFrame of df's session."""
    inner = model.feature >= 0
    splits = np.bincount(model.feature[inner], minlength=len(model.features))
    gain = np.bincount(model.feature[inner], model.gain[inner], len(model.features))
    return df.sparkSession.createDataFrame(list(zip(model.features, splits.tolist(), gain.tolist(), strict=True)), "feature string, splits long, gain double")
