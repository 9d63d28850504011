"""Hashes of words, word shingles and character shingles of many texts at once, and minwise hashes of shingle sets."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
STEP = U(0xD1342543DE82EF95)  # the base of the rolling hash, odd so that it has an inverse
STEP_BACK = U(pow(int(STEP), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = np.asarray(x, U) + ODD
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        x ^= x >> U(shift)
        if factor:
            x *= U(factor)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(n, dtype=U) + (U(salt) << U(32)))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; for short arrays at a fraction of what numpy's unique takes."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@lru_cache(1)
def _char_table() -> np.ndarray:
    return mix(np.arange(0x110000))


def char_hashes(chars: np.ndarray) -> np.ndarray:
    return _char_table()[chars]


#: Values whose powers of the base are kept; longer runs make theirs anew, so that a long text leaves no memory taken.
KEPT = 1 << 18


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (STEP, STEP_BACK):
        p = np.full(n, base, U)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


@lru_cache(1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(KEPT)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _kept_powers() if n <= KEPT else _made_powers(n)


def rolling(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of values[begin:end] for every span, wherever it stands."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[begins]) * down[begins])


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """rolling() for every run of k values; long arrays are taken in parts, as the hash is the same wherever a run stands."""
    out = np.empty(max(0, len(values) - k + 1), U)
    step = max(KEPT - k, k)
    for a in range(0, len(out), step):
        part = values[a : a + step + k - 1]
        up, down = _powers(len(part))
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[a : a + step] = mix((total[k:] - total[:-k]) * down[: len(part) - k + 1])
    return out


BYTE = seeds(256, 1)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
PLACES = seeds(64, 4) | U(1)


def spread(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of every run values[begin:begin+size]: each value times an odd number of its own for its place in the run,
    so that no pattern of repeats cancels out, as it would in powers of one base."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    odd = PLACES[place] if len(sizes) and int(sizes.max()) <= len(PLACES) else mix(place.astype(U) + PLACES[0]) | U(1)
    total = np.zeros(bounds[-1] + 1, U)
    np.cumsum(values[np.repeat(begins, sizes) + place] * odd, out=total[1:])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(U) * ODD)


def word_texts(text: str) -> list[bytes]:
    """The words of a text, as words() hashes them."""
    return text.encode().lower().split()


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, with A-Z lower-cased and split at ASCII white space, and the number of words before each
    text (one entry more than texts)."""
    raw = [t.encode().lower() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    solid = np.concatenate([[False], ~WHITE[data], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    begins, ends = edge[::2], edge[1::2]
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    long = ends - begins > len(PLACES)
    if not long.any():
        return spread(BYTE[data], begins, ends - begins), np.searchsorted(begins, bounds)
    out = np.empty(len(begins), U)
    for some in (long, ~long):
        out[some] = spread(BYTE[data], begins[some], (ends - begins)[some])
    return out, np.searchsorted(begins, bounds)


WORD = seeds(64, 2) | U(1)


def word_shingles(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; a shorter text's whole sequence is its one shingle."""
    h, first = words(texts)
    rolled = np.zeros(max(0, len(h) - k + 1), U)
    for j in range(k):
        rolled += h[j : j + len(rolled)] * WORD[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= k:
            out.append(distinct(rolled[a : b - k + 1]))
        else:
            out.append(mix((h[a:b] * WORD[: b - a]).sum(keepdims=True) + WORD[b - a + k]) if b > a else np.zeros(0, U))
    return out


def char_shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-character shingles of all texts, repeats included, and how many come before each; a shorter text is one."""
    chars = char_hashes(code_points("".join(texts)))
    size = np.array([len(t) for t in texts], np.int64)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    ends = np.cumsum(size)
    if len(size) and size.min() >= k:
        # Every window of the whole but those that cross an end.
        whole = np.ones(len(chars), bool)
        for i in range(1, k):
            whole[ends - i] = False
        return windows(chars, k)[whole[: len(chars) - k + 1]], first
    begins = np.arange(first[-1]) + np.repeat(ends - size - first[:-1], count)
    return rolling(chars, begins, begins + np.repeat(np.minimum(size, k), count)), first


def minwise(shingles: np.ndarray, first: np.ndarray, n: int, salt: int = 3, block: int = 1 << 17) -> np.ndarray:
    """n minwise hashes (columns, of 32 bits) of every run shingles[first[i]:first[i+1]]; runs must not be empty.

    Runs are hashed in blocks of about so many shingles, which stay in the processor's cache."""
    a, b = (seeds(n, salt) | U(1)).astype(np.uint32), seeds(n, salt + 100).astype(np.uint32)
    x = (shingles >> U(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, n), U)
    low = 0
    while low < len(out):
        high = max(low + 1, int(np.searchsorted(first, first[low] + block, side="right")) - 1)
        part, at = x[first[low] : first[high]], first[low:high] - first[low]
        work = np.empty_like(part)
        for i in range(n):
            np.multiply(part, a[i], out=work)
            np.bitwise_xor(work, b[i], out=work)
            out[low:high, i] = np.minimum.reduceat(work, at)
        low = high
    return out


def keys(hashes: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """One signed 64-bit key for every rows neighbouring columns; the key also depends on the columns' place."""
    n = hashes.shape[1] // rows
    out = np.tile(seeds(n, salt), (len(hashes), 1))
    for j in range(rows):
        out = mix(out ^ hashes[:, j::rows][:, :n] * WORD[j])
    return out.view(np.int64)
