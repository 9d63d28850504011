"""Encodes and decodes as SentencePiece BPE models do: a table of every prefix's last token.

A sequence of tokens is what the merges give exactly if each two neighbours stay apart when merged alone. So a prefix has
one last token: of the tokens that end there, the one that stays apart from the last token before it. An automaton finds
the tokens that end at each place; the table is filled from left to right and read backwards.
"""

from __future__ import annotations

import codecs
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import code_points
from .pretokens import distinct, gather, text_runs

#: What stands for a space in pieces.
MARK = "▁"
#: Longer segments are encoded without the cache.
CACHED = 64
#: Segments in each of the cache's two generations, and pairs whose test is remembered.
SEGMENTS, PAIRS = 400_000, 1 << 21


def _one_each(e: UnicodeDecodeError) -> tuple[str, int]:
    """A replacement character for one byte that fits in no character."""
    return "�", e.start + 1


codecs.register_error("confluo_one_each", _one_each)


class PieceModel:
    """A BPE model with byte fallback, without normalisation: encoder and decoder."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, pb.ModelProto.SentencePiece
        plain = not norm.precompiled_charsmap and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or not plain:
            raise ValueError("a BPE model with byte fallback and without normalisation is needed")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.dummy = norm.add_dummy_prefix
        self.texts = [p.piece for p in model.pieces]
        self.normal = np.array([p.type == kind.NORMAL for p in model.pieces])
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        #: The place of each piece in the order of merges; equal scores are merged from the left.
        self.order = {p.piece: -p.score for p in model.pieces if p.type == kind.NORMAL}
        self.size = list(map(len, self.texts))
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        known = set()
        for i, p in enumerate(model.pieces):
            # A piece that its own characters aren't merged to is the last token of nothing.
            if p.type == kind.NORMAL and self._merged(p.piece) == [p.piece]:
                self.automaton.add_word(p.piece, i)
                if len(p.piece) == 1:
                    known.add(p.piece)
        if not all(set(t) <= known for t in self.order):
            raise ValueError("a piece has a character that is no piece")
        self.automaton.make_automaton()
        self.unknown = re.compile(f"[^{re.escape(''.join(sorted(known)))}]")
        #: Whether a space after another character always parts segments.
        self.parted = not any(re.search(f"[^{MARK}]{MARK}", t) for t in self.order)
        raw = [
            t.replace(MARK, " ").encode() if p.type == kind.NORMAL else bytes([int(t[3:5], 16)]) if p.type == kind.BYTE else model.trainer_spec.unk_surface.encode() if p.type == kind.UNKNOWN else b""
            for t, p in zip(self.texts, model.pieces, strict=True)
        ]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array(list(map(len, raw)), np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        #: Pieces whose mark the dummy prefix may have put there.
        self.spaced = self.normal & np.array([t.startswith(MARK) for t in self.texts])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _merged(self, text: str, cut: int = 0) -> list[str] | None:
        """The pieces that the merges make of a short text; none if a merge spans the place cut."""
        parts, order = list(text), self.order
        ranks = [order.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            at, least = -1, None
            for i, r in enumerate(ranks):
                if r is not None and (least is None or r < least):
                    at, least = i, r
            if at < 0:
                return parts
            if cut and sum(map(len, parts[: at + 1])) == cut:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = order.get(parts[at - 1] + parts[at])
            if at < len(ranks):
                ranks[at] = order.get(parts[at] + parts[at + 1])

    def _apart(self, a: int, b: int) -> bool:
        """Whether the merges leave token b apart from token a before it."""
        key = a * len(self.texts) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._merged(self.texts[a] + self.texts[b], self.size[a]) is not None
        return known

    def _known_ids(self, text: str) -> list[int]:
        """The ids of a text whose characters are all pieces."""
        size, pairs, n, apart = self.size, self.pairs, len(self.texts), self._apart
        last = [-1] * (len(text) + 1)
        for end, t in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = end - size[t]
                if not before:
                    last[end] = t
                else:
                    a = last[before]
                    fits = pairs.get(a * n + t)
                    if fits or fits is None and apart(a, t):
                        last[end] = t
        ids, end = [], len(text)
        while end:
            ids.append(last[end])
            end -= size[last[end]]
        ids.reverse()
        return ids

    def _segment(self, text: str) -> bytes:
        """The ids (little-endian int32) of a segment; characters that are no pieces are bytes and part it."""
        if not self.unknown.search(text):
            return array("i", self._known_ids(text)).tobytes()
        ids: list[int] = []
        at = 0
        for m in self.unknown.finditer(text):
            ids += self._known_ids(text[at : m.start()])
            ids += [self.byte_id[b] for b in m.group().encode()]
            at = m.end()
        return array("i", ids + self._known_ids(text[at:])).tobytes()

    def _cached(self, segments: list[str]) -> list[bytes]:
        if len(self.young) > SEGMENTS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = list(map(young.get, segments))
        for i, ids in enumerate(out):
            if ids is None:
                s = segments[i]
                out[i] = ids = old.get(s) or self._segment(s)
                if len(s) <= CACHED:
                    young[s] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (int32) and where each text's ids start (and the end of all)."""
        marked = [((MARK if self.dummy else "") + t.replace(" ", MARK)) if t else "" for t in texts]
        whole = "".join(marked)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in marked])])
        start = np.zeros(len(whole), bool)
        if self.parted:
            mark = code_points(whole) == ord(MARK)
            start[1:] = mark[1:] & ~mark[:-1]
        start[bounds[:-1][bounds[:-1] < len(whole)]] = True
        first = np.flatnonzero(start)
        cuts = np.append(first, len(whole))
        at, place = distinct(whole, cuts)
        ids = self._cached([whole[a:b] for a, b in zip(cuts[at].tolist(), cuts[at + 1].tolist(), strict=True)])
        sizes = np.array(list(map(len, ids)), np.int64) // 4
        flat, ends = gather(np.frombuffer(b"".join(ids), np.int32), (np.cumsum(sizes) - sizes)[place], sizes[place])
        return flat, ends[np.searchsorted(first, bounds)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run ids[bounds[i]:bounds[i+1]]; bytes that fit in no character become replacement characters."""
        raw, starts = gather(self.raw, self.raw_at[ids], self.raw_size[ids])
        cuts = starts[bounds]
        out = []
        for i, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
            text = raw[a:b].tobytes().decode("utf-8", "confluo_one_each")
            shown = np.flatnonzero(self.raw_size[ids[bounds[i] : bounds[i + 1]]][:64])
            if self.dummy and len(shown) and self.spaced[ids[bounds[i] + shown[0]]]:
                text = text[1:]
            out.append(text)
        return out


@lru_cache(2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text as the model's library does, without begin or end ids, and decode the ids again: doc_id,
    n_tokens, ids (array of int), decoded (string).

    A map over rows: no shuffle; a task holds one long text beside a run of short ones, and a text takes time by its
    length, with or without spaces. Null and empty texts have no ids; null ids and repeated rows stay as they are; other
    input columns are ignored; an empty table gives an empty result. Strings of control pieces are ordinary text. The mark
    U+2581 in a text is a space, as in the library. Every executor finds the model at model_path.
    """

    def run(parts):
        model = load(model_path)
        for part in parts:
            for ids, texts in text_runs(part.column(0), part.column(1)):
                flat, bounds = model.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                columns = [pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), lists, pa.array(model.decode(flat, bounds), pa.string())]
                yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
