"""Periodic runs, SentencePiece ids, spelling variants: against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from confluo.llm import hashing, periodic_runs, piece_bpe, spelling

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# Periodic runs


def brute_runs(words, min_exp=4, min_length=6):
    """Every maximal stretch of words with its smallest period, by looking at all places and all periods."""
    n, out = len(words), set()
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exp * q):
                s = words[i : j + q]
                if not any(s[: len(s) - d] == s[d:] for d in range(1, q)):
                    out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        letters = "abcde"[: r.randint(1, 5)]
        words = []
        while len(words) < r.randint(0, 80):
            piece = [r.choice(letters) for _ in range(r.randint(1, 6))]
            words += piece * r.randint(1, 7) if r.random() < 0.6 else piece
        out.append(" ".join(words))
    return out


ODD_TEXTS = ["", " \t\n", "a", "a a a a a", "a a a a a a", "a b " * 4, "x y x y", "a b a b a b c a b a b a b a b " * 5, ("a " * 3 + "b ") * 9 + "a " * 12]


@pytest.mark.parametrize(("min_exp", "min_length"), [(4, 6), (2, 2), (3, 5)])
def test_runs_of_many_texts(min_exp, min_length):
    words = [periodic_runs.split_words(t) for t in run_texts(300, min_exp) + ODD_TEXTS]
    got = periodic_runs.find_runs(words, 1, None, min_exp, min_length)
    for w, rows in zip(words, got, strict=True):
        assert [tuple(r) for r in rows.tolist()] == brute_runs(w, min_exp, min_length)


def test_ranges_of_lags_find_the_same_runs():
    for t in run_texts(60, 9):
        w = periodic_runs.split_words(t * 3)
        whole = {tuple(r) for r in periodic_runs.find_runs([w], 1, None, 4, 6)[0].tolist()}
        parts = {tuple(r) for a in range(0, len(w), 3) for r in periodic_runs.find_runs([w], max(a, 1), a + 3, 4, 6)[0].tolist()}
        assert parts == whole


def test_smallest_period():
    for q, unit in ((1, "a"), (6, "aab"), (12, "ab"), (30, "abcde"), (7, "a"), (8, "aabaabab")):
        ids = np.array([ord(c) for c in (unit * 99)[: 4 * q]])
        want = next(d for d in range(1, q + 1) if (ids[:-d] == ids[d:]).all())
        assert periodic_runs._smallest_period(ids, q) == want


def doc_rows(texts):
    return [(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "y"), (None, "a a a a a a a b", "z"), (None, None, None), (7, None, "x")]


def test_periodic_runs_with_long_documents_in_parts(spark):
    rows = doc_rows(run_texts(80, 4) + ODD_TEXTS)
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    want = []
    for d, t, _ in rows:
        w = (t or "").split(" ") if "\t" not in (t or "") else []
        w = [x for x in w if x]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want.append((str(d), len(w), runs, best, brute_collapse(w, runs)))
    for lags in (1 << 15, 4):  # the second deals the lags of texts of over 32 bytes to tasks
        got = [(str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], tuple(r.strongest) if r.strongest else None, r.collapsed) for r in periodic_runs.periodic_runs(docs, lags_a_task=lags).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="min_exp"):
        periodic_runs.periodic_runs(docs, min_exp=1)


def test_one_long_text_of_one_word():
    """Each lag of it is the same run: no lag but the first compares all words."""
    runs = periodic_runs.find_runs([[b"a"] * 400_000], 1, None, 4, 6)[0]
    assert runs.tolist() == [[0, 400_000, 1]]
    assert periodic_runs.find_runs([[b"a", b"b"] * 200_000], 50_000, 60_000, 4, 6)[0].tolist() == [[0, 400_000, 2]]


def test_query_of_periodic_runs(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(run_texts(300, 5) + ODD_TEXTS)] + [(5, None)], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.collapsed_sha256): r for r in periodic_runs.query(spark, str(tmp_path)).collect()}
    rows, found = spark.read.parquet(f"{tmp_path}/documents.parquet").collect(), 0
    for d, t in rows:
        w = (t or "").encode().split()
        h, n = zlib.crc32(str(d).encode()), len(w)
        if n > 2500:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        w = [x.decode() for x in w]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        r = got[d, hashlib.sha256(brute_collapse(w, runs).encode()).hexdigest()]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        found += len(runs)
    assert len(got) == len(rows) and found > 100


# SentencePiece ids


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


PIECE_TEXTS = [
    "", " ", "  ", "   a", "a ", "\n", "\x00", "<s>", "</s><unk>", "<0x41>", "▁", "▁▁ a▁b", "tab\there", "é中😀​ ٣4", "ﬁ Ⅸ", "a" * 3000, " " * 501, "中" * 400, "ab́", " x", "http://x.y/z?q=1&w=2", "!!!???...", "퟿\U0010ffff",
]


def piece_texts(n=1500, seed=1):
    r = random.Random(seed)
    alphabets = ("abcdefghijklmnopqrstuvwxyz    ", "ab 'streveldm1٣é\n\t  .,!中😀▁'  ", "the and ing er on re 0123456789-_=", "ÀÉÎõüßñ ça va où", "日本語中文한국어 ")
    return PIECE_TEXTS + ["".join(r.choice(r.choice(alphabets) if r.random() < 0.1 else a) for _ in range(r.randint(0, 90))) for _ in range(n) for a in [r.choice(alphabets)]]


def test_ids_are_the_librarys(library):
    some, m = piece_texts(), piece_bpe.load(MODEL)
    flat, at = m.encode(some)
    back = m.decode(flat, at)
    for t, a, b, d in zip(some, at, at[1:], back, strict=False):
        want = library.encode(t)
        assert flat[a:b].tolist() == want, t
        assert d == library.decode(want)


def test_merges_without_segments(library):
    """The table needs no spaces: whole texts as one segment give the same ids."""
    m = piece_bpe.PieceModel(MODEL)
    m.parted = False
    some = piece_texts(300, 7)
    flat, at = m.encode(some)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == library.encode(some)


def test_decoding_any_ids(library):
    m, r = piece_bpe.load(MODEL), random.Random(3)
    for _ in range(300):
        ids = [r.randrange(3, 259) if r.random() < 0.5 else r.randrange(259, 32000) for _ in range(r.randint(0, 20))]
        assert m.decode(np.array(ids, np.int64), np.array([0, len(ids)])) == [library.decode(ids)]


def test_long_text_without_spaces(library):
    r = random.Random(2)
    text = "".join(r.choice("etaoinshrdlu") for _ in range(40_000))
    assert piece_bpe.load(MODEL).encode([text])[0].tolist() == library.encode(text)


def test_encode_piece_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(PIECE_TEXTS)] + [(1, "twice", "a"), (1, "twice", "a"), (None, "null id", None), (2, None, "y"), (4, "word " * 220_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = piece_bpe.encode_documents(docs, MODEL).collect()
    want = [(str(d), library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t, _ in rows]
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == sorted(want)
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert piece_bpe.encode_documents(docs.limit(0), MODEL).count() == 0


def test_query_of_piece_bpe(spark, sf_dir, library):
    got = {r.doc_id: r for r in piece_bpe.query(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    for d, t in rows:
        ids = library.encode(t or "")
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert len(got) == len(rows)


# Spelling variants


def brute_words(rows):
    counts = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, near=None):
    near = near or {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_of_many_words(spark):
    r = random.Random(5)
    counts = {"".join(r.choice("abé") for _ in range(r.randint(1, 6))): r.choice((3, 4, 6, 6, 13, 30, 70)) for _ in range(400)}
    counts |= {"aaaaa": 5, "aaaaaa": 10, "aaaaaaa": 20, "aaaaaaaa": 41, "ab": 3, "ba": 6, "🙂x": 9, "x": 2}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(words)) == brute_variants(counts)
    assert found(spelling.variants(words.limit(0))) == {}


def test_long_words(spark):
    base = "".join(random.Random(1).choice("abcdefg") for _ in range(70))
    longs = [base[:i] + x + base[i + y :] for i in (0, 3, 30, 31, 38, 39, 66, 69) for x, y in (("", 1), ("z", 0), ("q", 1))]
    longs += [base, base[:65], base[:64], base[:63], base[1:65], base[:64] + "zz", "y" * 300, "y" * 301, "w" * 64, "w" * 65]
    counts = {w: 3 + 7 * i for i, w in enumerate(dict.fromkeys(longs))}
    assert found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute_variants(counts)


def test_vocabulary(spark):
    r = random.Random(6)
    some = ["colour", "Colour", "color", "Größe", "GRÖßE", "naïveté", "×÷×÷×", "it's", "under_score", "ABCDEFG"]
    rows = [(i if i % 9 else None, " ".join(r.choice(some) for _ in range(40)) + r.choice(("", "\n1x2y"))) for i in range(120)]
    rows += [(3, None), (None, None), (4, ""), (5, "colour" * 50_000), rows[1], rows[1]]
    docs = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, n string")
    assert {w.word: w.n for w in spelling.vocabulary(docs).collect()} == brute_words(rows)
    plain = {w.word: w.n for w in spelling.vocabulary(docs, 1, 1, every=0).collect()}
    assert plain == Counter(w for _, t in rows for w in re.findall("[a-zÀ-ÿ]+", "".join(c.lower() if c.isascii() else c for c in t or "")))
    assert spelling.vocabulary(docs.limit(0)).count() == 0


def test_query_of_spelling_variants(spark, sf_dir):
    counts = brute_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    near, rests = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            rests[w[:i] + "*" + w[i + 1 :]].add(w)
            rests[w[:i] + w[i + 1 :]].add(w)
    for k, some in rests.items():
        if k in counts:
            for w in some:
                near[w].add(k)
                near[k].add(w)
        elif "*" in k:
            for w in some:
                near[w] |= some - {w}
    want = brute_variants(counts, {w: sorted(near[w]) for w in counts})
    assert found(spelling.query(spark, sf_dir)) == want
    assert sum(v[0] is not None for v in want.values()) > 3


def test_hashes_of_long_arrays():
    """Windows of arrays longer than the powers kept are the same wherever they stand."""
    values = hashing.mix(np.random.default_rng(1).integers(0, 50, 2 * hashing.KEPT + 77))
    for k in (1, 5, 10):
        begins = np.arange(len(values) - k + 1)
        assert (hashing.windows(values, k) == hashing.rolling(values, begins, begins + k)).all()
    at = np.arange(5)
    assert (hashing.rolling(values, at + 2 * hashing.KEPT, at + 2 * hashing.KEPT + 7) == hashing.rolling(values[2 * hashing.KEPT :], at, at + 7)).all()
    assert len(hashing.windows(values[:3], 5)) == 0 and len(hashing.windows(values[:5], 5)) == 1
