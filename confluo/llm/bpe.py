"""Byte-level BPE: a segment tree over byte positions holds the leftmost pair of least rank.

Distinct pieces are merged side by side: one tree a piece, as rows of an array, so each step merges one pair in every
piece and repairs three leaves and their ancestors. Where few pieces are of a length, each has its tree to itself.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PieceCache, text_runs, gather

NEVER = np.int64(1) << 62
#: Fewer pieces of a length are merged one by one.
FEW = 24
#: Pieces of each generation that a worker keeps: workers stay between stages, and their memory with them.
KEPT = 50_000


class RankEncoder:
    """Encodes and decodes with mergeable ranks; a token's id is its rank."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in rank.items():
            for k in range(1, len(t)):
                a, b = rank.get(t[:k]), rank.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[p] for p in self.pair.tolist()], np.int64)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.array(list(map(len, tokens)), np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.cache = PieceCache(self.encode_pieces, KEPT)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], NEVER)

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Merged ids (little-endian uint32) of pieces of at most width bytes; width is a power of two."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        live = np.arange(width) < length[:, None]
        ids = np.zeros((n, width), np.int64)
        ids[live] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.where(np.arange(1, width + 1) < length[:, None], np.arange(1, width + 1), width)
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * width), NEVER)
        row, pos = np.nonzero(after < width)
        self._set(tree, row, pos, ids[row, pos], ids[row, pos + 1], width)
        half = width
        while half > 1:
            np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2], out=tree[:, half // 2 : half])
            half //= 2
        row = np.arange(n)
        while len(row := row[tree[row, 1] < NEVER]):
            rank, pos = np.divmod(tree[row, 1], width)
            gone = after[row, pos]
            follower = after[row, gone]
            ids[row, pos] = rank
            live[row, gone] = False
            after[row, pos] = follower
            tree[row, width + pos] = tree[row, width + gone] = NEVER
            k = np.flatnonzero(follower < width)
            before[row[k], follower[k]] = pos[k]
            self._set(tree, row[k], pos[k], rank[k], ids[row[k], follower[k]], width)
            leader = before[row, pos]
            k = np.flatnonzero(leader >= 0)
            self._set(tree, row[k], leader[k], ids[row[k], leader[k]], rank[k], width)
            for leaf in (gone, pos, np.maximum(leader, 0)):
                node = width + leaf
                for _ in range(width.bit_length() - 1):
                    node >>= 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        flat = ids[live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _set(self, tree, row, pos, a, b, width) -> None:
        rank = self.rank_of(a, b)
        tree[row, width + pos] = np.where(rank < NEVER, rank * width + pos, NEVER)

    def _merge_one(self, piece: bytes) -> bytes:
        """Merged ids of one piece."""
        n, never, rank_of = len(piece), int(NEVER), self.pairs.get
        width = max(2, 1 << (n - 1).bit_length())
        ids = array("q", self.byte_id[np.frombuffer(piece, np.uint8)].tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        tree = array("q", [never]) * (2 * width)

        def put(place: int, rank: int | None) -> None:
            node = width + place
            tree[node] = never if rank is None else rank * width + place
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        for i in range(n - 1):
            put(i, rank_of(ids[i] << 32 | ids[i + 1]))
        while (top := tree[1]) < never:
            rank, at = divmod(top, width)
            gone = after[at]
            follower = after[at] = after[gone]
            ids[at], ids[gone] = rank, -1
            put(gone, None)
            if follower < n:
                before[follower] = at
                put(at, rank_of(rank << 32 | ids[follower]))
            else:
                put(at, None)
            if before[at] >= 0:
                put(before[at], rank_of(ids[before[at]] << 32 | rank))
        merged = np.frombuffer(ids, np.int64)
        return merged[merged >= 0].astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(raw):
            by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, where in by_width.items():
            if len(where) < FEW:
                for i in where:
                    out[i] = self._merge_one(raw[i])
                continue
            step = max(1, (1 << 18) // width)
            for a in range(0, len(where), step):
                part = where[a : a + step]
                for i, ids in zip(part, self._merge([raw[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (uint32) and where each text's ids start (and the end of all)."""
        return self.cache(texts)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids and where each id's bytes start (and the end of all)."""
        return gather(self.token_bytes, self.token_at[ids], self.token_size[ids])


@lru_cache(2)
def load(path: str) -> RankEncoder:
    """An encoder by a rank file: a line holds a token in base 64 and its rank."""
    with open(path, "rb") as f:
        ranks = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f))
    return RankEncoder([t for _, t in ranks])


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again; returns doc_id, n_tokens, ids (little-endian uint32, binary),
    decoded (binary), same (whether decoded is the text).

    A map over rows: no shuffle, a row's memory is bounded by its own text; a piece of n bytes takes n merges of about
    log n steps, so texts without a break are no special case. Null and empty texts have no ids; null ids
    and repeated rows stay as they are; other input columns are ignored; an empty table gives an empty result. Strings
    of special tokens are ordinary text. Every executor finds the rank file at ranks_path.
    """

    def run(parts):
        encoder = load(ranks_path)
        for part in parts:
            for ids, texts in text_runs(part.column(0), part.column(1)):
                flat, bounds = encoder.encode(texts)
                raw, starts = encoder.decode(flat)
                cuts = starts[bounds]
                decoded = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(cuts.astype("<i4")), pa.py_buffer(raw)])
                same = pc.equal(decoded, pa.array(texts, pa.string()).cast(pa.binary()))
                yield pa.record_batch(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((bounds * 4).astype("<i4")), pa.py_buffer(flat.astype("<u4"))]),
                        decoded,
                        same,
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded", "same"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary, same boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(read(spark, sf_dir, "documents"), ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
