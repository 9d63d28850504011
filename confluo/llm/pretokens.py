"""Splits texts into the matches of the byte-BPE pattern, whole batches at a time.

The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ and the splitter finds its matches from
the class of each character: a match starts where the class changes, a single space before a word belongs to the word,
and the last white space before a word stands apart from the white space in front of it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .hashing import char_hashes, code_points, rolling

LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
# The contractions that the pattern cuts off.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point, by the regex library's Unicode tables."""
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        classes[code_points("".join(regex.findall(pattern, every)))] = kind
    return classes


def spans(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one string, where its matches begin (and the end of all), and how many matches come before each
    text (one entry more than texts)."""
    whole = "".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    if not whole:
        return "", np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    chars = code_points(whole)
    kind = char_classes()[chars]
    begins = np.concatenate([[0], ends[:-1]])
    begins = begins[begins < len(chars)]
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[begins] = EDGE
    after = np.empty_like(kind)
    after[:-1] = kind[1:]
    after[np.concatenate([begins[1:], [len(chars)]]) - 1] = EDGE

    blank = np.zeros(len(chars), bool)  # a plain space stands before
    blank[1:] = chars[:-1] == 0x20
    blank[begins] = False
    start = kind != before
    start &= ~(blank & (kind != SPACE))
    start |= (kind == SPACE) & (after < SPACE)

    quote = np.flatnonzero((chars == 0x27) & start & (after == LETTER))
    for suffix in SUFFIXES if len(quote) else ():
        at = quote[quote + len(suffix) < len(chars)]
        same = np.ones(len(at), bool)
        for k, c in enumerate(suffix, 1):
            same &= (chars[at + k] == ord(c)) & (before[at + k] != EDGE)
        at = at[same]
        start[at + 1] = False
        rest = at + 1 + len(suffix)
        start[rest[rest < len(chars)]] = True

    first = np.flatnonzero(start)
    return whole, np.concatenate([first, [len(chars)]]), np.concatenate([[0], np.searchsorted(first, ends)])


def split(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The matches of all texts, in order, and how many matches come before each text."""
    whole, cuts, first = spans(texts)
    return [whole[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)], first


def gather(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[begin:begin+size], one after the other, and where each starts (and the end of all)."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(begins - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


def distinct(whole: str, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each kind of the pieces whole[cuts[i]:cuts[i+1]], and the place of each piece's kind among these.

    Pieces are sorted by a hash; each is then compared, character by character, with the one that stands for its hash."""
    chars = code_points(whole)
    size = np.diff(cuts)
    _, at, place = np.unique(rolling(char_hashes(chars), cuts[:-1], cuts[1:]), return_index=True, return_inverse=True)
    stands = at[place]
    same = size == size[stands]
    own, bounds = gather(chars, cuts[:-1], np.where(same, size, 0))
    other, _ = gather(chars, cuts[:-1][stands], np.where(same, size, 0))
    if same.all() and (own == other).all():
        return at, place
    kinds: dict[str, int] = {}
    place = np.array([kinds.setdefault(whole[a:b], len(kinds)) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)])
    return np.unique(place, return_index=True)[1], place


def batches(ids: list, texts: list, most: int = 1 << 20):
    """Runs of rows with about so many characters; a longer text stands alone."""
    a = size = 0
    for b, t in enumerate(texts):
        if size and size + len(t) > most:
            yield ids[a:b], texts[a:b]
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield ids[a:], texts[a:]


def text_runs(ids: pa.Array, texts: pa.Array, rows: int = 1024, most: int = 1 << 20):
    """As batches, from Arrow columns, of which few rows at a time become Python objects; null texts become empty."""
    for a in range(0, len(texts), rows):
        yield from batches(ids.slice(a, rows).to_pylist(), [t or "" for t in texts.slice(a, rows).to_pylist()], most)


class PieceCache:
    """Ids of texts by their pieces: each distinct piece of a batch is looked up once, and
    pieces not used lately are encoded. Two generations of at most so many pieces are kept."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 200_000):
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        missing = [w for w in words if w not in self.young]
        known = [w for w in missing if w in self.old]
        self.young.update((w, self.old[w]) for w in known)
        new = [w for w in missing if w not in self.young]
        self.young.update(zip(new, self.encode(new), strict=True))
        return list(map(self.young.__getitem__, words))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts and where each text's ids start (and the end of all)."""
        whole, cuts, first = spans(texts)
        at, place = distinct(whole, cuts)
        ids = self._ids([whole[a:b] for a, b in zip(cuts[at].tolist(), cuts[at + 1].tolist(), strict=True)])
        sizes = np.array(list(map(len, ids)), np.int64) // 4
        flat, bounds = gather(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(sizes) - sizes)[place], sizes[place])
        return flat, bounds[first]
