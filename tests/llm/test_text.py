"""Tokens, token files, pages, quality: against the libraries, exact round trips and held-out labels."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from confluo.llm import bpe, hashing, html_text, quality, token_files
from confluo.llm.common import fresh_path
from confluo.llm.pretokens import split

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n x", "it's we'll I'd'D '' 's", "a" * 3000, "é中😀​ ٣4", "  two  spaces \t\r\n ", "<|endoftext|>", "!!'re\n'", "x\x00y"]


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=400, seed=1):
    r = random.Random(seed)
    alphabet = "ab 'streveldm1٣é\n\t  .,!中😀'  "
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_pieces_are_the_matches_of_the_pattern():
    pattern, some = regex.compile(public_tokenizers.PATTERN), texts(3000)
    words, first = split(some)
    assert [words[a:b] for a, b in zip(first, first[1:])] == [pattern.findall(t) for t in some]


def test_ids_and_round_trip(encoding):
    some, e = texts(), bpe.load(RANKS)
    flat, at = e.encode(some)
    for t, a, b in zip(some, at, at[1:]):
        assert flat[a:b].tolist() == encoding.encode_ordinary(t)
        assert e.decode(flat[a:b])[0].tobytes() == t.encode()


def test_one_long_piece(encoding):
    e, r = bpe.load(RANKS), random.Random(8)
    for piece in ("a" * 20_001, "".join(r.choice("stevrlandi") for _ in range(30_000)), "x", "ab"):
        assert np.frombuffer(e._merge_one(piece.encode()), "<u4").tolist() == encoding.encode_ordinary(piece)


ROWS = [(1, "Hello there, it's me.", "x"), (1, "Hello there, it's me.", "x"), (None, "null id", None), (2, None, "y"), (3, "", ""), (4, "word " * 220_000, "z")]


def frame(spark, rows=ROWS, more="ids string"):
    return spark.createDataFrame(rows, f"doc_id long, text string, {more}")


def test_encode_documents(spark, encoding):
    got = bpe.encode_documents(frame(spark), RANKS).collect()
    want = sorted((str(d), encoding.encode_ordinary(t or "")) for d, t, _ in ROWS)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert all(r.same and r.n_tokens * 4 == len(r.ids) for r in got)
    assert bpe.encode_documents(frame(spark, []), RANKS).count() == 0


def test_elias_fano():
    r = random.Random(3)
    for v in ([], [0], [5, 5, 5], [-9, 0, 7, 1 << 40], sorted(r.randint(-1000, 10**7) for _ in range(3000))):
        x, end = token_files.EliasFano.read(b"xx" + token_files.EliasFano.build(np.array(v, np.int64)).tobytes(), 2)
        assert x.values().tolist() == v and [x.select(i) for i in range(0, len(v), 7)] == v[::7]


def alike(n=2048):
    """Two words that any sum of powers of an odd base, modulo 2**64, takes for one: each is the other's complement."""
    bits = np.array([bin(i).count("1") % 2 for i in range(n)])
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_equal_hashes_are_not_equal_pieces(spark, encoding, monkeypatch):
    from confluo.llm import pretokens

    a, b = alike()
    assert len(set(hashing.words([f"{a} {b}"])[0].tolist())) == 2
    some = [a, b, f"{b} {a} {a}", "one two"]
    for constant in (False, True):
        if constant:
            monkeypatch.setattr(pretokens, "rolling", lambda values, begins, ends: np.zeros(len(begins), np.uint64))
        flat, at = bpe.RankEncoder(bpe.load(RANKS).tokens).encode(some)
        assert [flat[x:y].tolist() for x, y in zip(at, at[1:])] == [encoding.encode_ordinary(t) for t in some]
        token_files._tokenizer.cache_clear()
        t = Tokenizer.from_file(VOCABULARY)
        assert [x.tolist() for x in token_files._encode(VOCABULARY, some, 0)] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in some]


def test_missing_token_file(spark):
    path = fresh_path(spark, "test-tokens")
    manifest = token_files.write_token_files(frame(spark), VOCABULARY, path)
    more = manifest.union(spark.createDataFrame([("ids-999999-00000.tok", 1, 1, 0)], manifest.schema))
    with pytest.raises(Exception, match="ids-999999"):
        token_files.read_token_files(spark, path, more).count()


def test_token_files(spark):
    path = fresh_path(spark, "test-tokens")
    manifest = token_files.write_token_files(frame(spark), VOCABULARY, path, ids_a_file=20)
    got = token_files.read_token_files(spark, path, manifest).orderBy("start").collect()
    t = Tokenizer.from_file(VOCABULARY)
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4] and manifest.count() > 1
    files = sorted(manifest.collect())
    assert [f.start for f in files] == [sum(f.n_ids for f in files[:i]) for i in range(len(files))]
    start, by_id = 0, {d: x for d, x, _ in ROWS}
    for r in got:
        assert r.start == start and list(r.ids) == [*t.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids, 0]
        start += len(r.ids)


def test_token_file_query(spark, tmp_path):
    frame(spark, [(d, x, None) for d, x in enumerate(texts(60))]).write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(VOCABULARY)
    start = 0
    for r, x in zip(token_files.query(spark, str(tmp_path)).orderBy("doc_id").collect(), texts(60), strict=True):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    frame(spark, []).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert token_files.query(spark, str(tmp_path)).count() == 0


def test_bpe_query(spark, tmp_path, encoding):
    frame(spark, [(d, x, None) for d, x in enumerate(texts(60))]).write.parquet(f"{tmp_path}/documents.parquet")
    for r, x in zip(bpe.query(spark, str(tmp_path)).orderBy("doc_id").collect(), texts(60), strict=True):
        ids = np.array(encoding.encode_ordinary(x), "<u4").tobytes()
        assert (r.n_tokens * 4, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(x.encode()).hexdigest())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home page</a><li><a href="/b">All the news</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies.</div>
<div id="sidebar"><p>Read this long teaser text that is no part of it, with many words.</p></div>
<article><h1>Title &amp; more</h1><p>First <b>bo</b>ld   paragraph<br>with a break, and enough text.<p>Second, with <a href="/x">a link</a> in it &eacute;&#33;
<form><input value="q"><button>Send</button></form><blockquote>Quoted words.</blockquote><section class="comments"><p>Nice article!</p></section></article>
<aside>More</aside><div class="ad">Buy now</div><footer>&copy; us</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(PAGE) == "Title & more First bold paragraph with a break, and enough text. Second, with a link in it é! Quoted words."
    assert html_text.main_text("<div><div><p>" + "Long text in plain boxes. " * 9 + "</p><p>" + "And more of it. " * 9 + "</p></div><ul>" + "<li><a>menu entry</a>" * 9 + "</ul></div>").startswith("Long text")


BODY = "".join(f"<p>Paragraph {i} of the article, with more than enough words to be the bulk of it.</p>" for i in range(6))
FAR = "<p>Site name and tagline</p>"


@pytest.mark.parametrize("around", ["<form>%s</form>", "<form><fieldset>%s</fieldset></form>", "<div class='content has-sidebar'>%s</div>", "<div class='post comments-open'><article>%s</article></div>",
    "<div class='layout with-nav'><div class='has-sidebar'>%s</div></div>", "<article><h1>T</h1><div class='content has-sidebar'>%s</div></article>", "<div class='search'><main>%s</main></div>"])
def test_wrappers_by_name_are_not_cut(around):
    small = "<div class='sidebar'><p>A teaser.</p></div><div class='comments'><p>Nice!</p></div><form><p>Your name</p></form>"
    for inner in (BODY, BODY + small):
        got = html_text.main_text(f"<html><body>{FAR}{around % inner}{small}</body></html>")
        assert all(f"Paragraph {i} of" in got for i in range(6)) and "teaser" not in got and "Nice" not in got and "Your name" not in got


@pytest.mark.parametrize("name", ["comments", "comments-area", "comment-list"])
@pytest.mark.parametrize("post", ["<article>%s</article>", "<div class='post'>%s</div>"])
def test_comments_longer_than_the_article_are_cut(name, post):
    said = "".join(f"<article><p>Comment {i}, about as long as anybody would ever care to write.</p></article>" for i in range(30)) if "article" in post else "<p>Comment, and very many more words. </p>" * 60
    got = html_text.main_text(f"<html><body>{post % BODY}<div class='{name}'>{said}</div></body></html>")
    assert "Paragraph 5 of" in got and "Comment" not in got


def test_density_decides(spark, sf_dir, monkeypatch):
    plain = "<ul>" + "".join(f"<li><a href='/{i}'>Entry number {i} of a list</a></li>" for i in range(3)) + "</ul>"
    page = f"<html><body><div>{plain}</div><div><p>More.</p></div><div><h1>Head</h1>{BODY}</div><div>{plain}<p>(c) us</p></div></body></html>"
    want = " ".join(f"Paragraph {i} of the article, with more than enough words to be the bulk of it." for i in range(6))
    assert html_text.main_text(page) == f"Head {want}"
    # On whole pages without any list of names: kinds of elements alone leave the adverts in, densities find the article.
    import html
    import re

    monkeypatch.setattr(html_text, "_not_text", lambda tag, attributes, inside: html_text.NEVER if tag in html_text.NOT_TEXT else html_text.TEXT)
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    exact = 0
    for p in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", p, re.S)[1]
        exact += html_text.main_text(p) == " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
    assert exact >= 0.9 * len(pages) and all('<div class="ad">' in p for p in pages)


@pytest.mark.parametrize("part", ["<a><p>x", "<div></span>x", "<div class='ad'><p>x", "<ul><li>x<table><tr><td>y", "<p>x</b></i>", "<b class=x>y"])
def test_time_grows_with_the_length(part):
    import time

    spent = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        html_text.main_text(part * n)
        spent.append(time.perf_counter() - began)
    assert spent[1] < 10 * spent[0] + 0.5


@pytest.mark.parametrize("html", ["", "<", "<p", "&am", "</p></p>", "<!-- open", "<script>", "<" * 5000, "<div>" * 2000 + "x", "<a href='q\"><p>t", "\x00<p>퟿", "<p title=\"a>b\">t</p>"])
def test_broken_pages(html):
    assert isinstance(html_text.main_text(html), str)


def test_extract_pages(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None), (2, "v", "", 1)]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == 4 and sum(r.n_chars > 0 for r in got) == 2 and all(len(r.text) == r.n_chars for r in got)


def test_whole_article_of_every_page(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html_text.query(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())


def test_quality_on_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough labels of both kinds
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = quality.query(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_discriminant_against_densities(spark):
    """The scores are the classes' Gaussian densities, with the shrunk covariances, by Bayes' rule."""
    rng, d = np.random.default_rng(4), len(quality.STATISTICS)
    x = np.vstack([rng.normal(0, 1, (60, d)) @ rng.normal(0, 1, (d, d)), rng.normal(1, 2, (90, d))])
    y = [0] * 60 + [1] * 90
    model = quality.fit(spark.createDataFrame([(v.tolist(), k) for v, k in zip(x, y)], "x array<double>, quality int"))
    density = []
    for k in (0, 1):
        part = x[np.array(y) == k]
        cov = np.cov(part.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 0.01 * np.eye(d)
        away = x - part.mean(0)
        far = (away * np.linalg.solve(cov, away.T).T).sum(1)
        density.append(np.log(len(part) / 150) - 0.5 * (np.linalg.slogdet(cov)[1] + far))
    want = 1 / (1 + np.exp(density[0] - density[1]))
    assert np.allclose(model.scores(x), want, atol=1e-7)


def test_quality_without_labels(spark):
    docs = frame(spark, ROWS, "score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(docs, ones).collect()} == {1.0}
    assert quality.keep_good(docs, ones).columns == docs.columns and quality.keep_good(docs, ones).count() == len(ROWS)
    assert quality.score_documents(frame(spark, []), ones).count() == 0


def test_hashes_do_not_depend_on_the_place():
    a = hashing.word_shingles(["One two THREE four five six", "x", "", " \t", "zero one two three\ffour five six"])
    assert len(a[0]) == 2 and len(a[1]) == 1 and len(a[2]) == len(a[3]) == 0 and set(a[0]) < set(a[4]) and len(a[4]) == 3
    s, first = hashing.char_shingles(["abcdef", "xabcdefx", "ab", ""], 5)
    assert set(s[first[0] : first[1]]) < set(s[first[1] : first[2]]) and list(np.diff(first)) == [2, 4, 1, 0]
