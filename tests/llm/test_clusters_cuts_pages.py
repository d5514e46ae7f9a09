"""Centroids, fill-in-the-middle and page text against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from brute import odd_documents
from pyspark.sql import functions as F

from erario.llm import centroids, fill_middle, page_text
from erario.llm.page_text import main_text

NAN, INF = float("nan"), float("inf")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- centroids ---------------------------------------------------------------

def odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(60)]
    rows += [(60, rows[0][1]), (60, rows[0][1]), (61, rows[1][1]), (None, rows[2][1]), (62, None), (63, [1.0, 2.0]), (64, [])]
    rows += [(65, [NAN, 0.0, 0.0, 0.0]), (66, [INF, 0.0, 0.0, 0.0]), (67, [None, 0.0, 0.0, 0.0]), (68, [0.0] * 4), (68, [-0.001] * 4)]
    return [(i, v, 7, "x") for i, v in rows]


def plain_clusters(rows, k, rounds, scale, seed):
    kept = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"{seed}:{r[0]}"), r[1]))
    centres = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    total = sum(d for d, _ in found)
    return [(i, c, d, sum(x for x, y in found if y == c), total, sha(",".join(map(str, centres[c]))))
            for (i, _), (d, c) in zip(kept, found)]


@pytest.mark.parametrize("k", [5, 100])
def test_centroids(spark, store, k):
    frame = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<float>, cluster int, v string").repartition(3)
    got = centroids.with_inertia(*centroids.cluster(frame, store, k=k, rounds=4, dims=4, scale=64, seed=3))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got.collect()) == order(plain_clusters(odd_vectors(), k, 4, 64, 3))
    none = centroids.with_inertia(*centroids.cluster(frame.limit(0), store, k=k, rounds=4, dims=4, scale=64, seed=3))
    assert none.collect() == [] and none.dtypes == got.dtypes


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark, store):
    frame = spark.createDataFrame([(i, [1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    found, centres = centroids.cluster(frame, store, k=3, rounds=3, dims=1, scale=10, seed=3)
    assert {(r.cluster, r.distance) for r in found.collect()} == {(0, 0)} and centres == [[10]] * 3


def test_components_too_large_for_exact_distances_stop_the_job(spark, store):
    frame = spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="units"):
        centroids.cluster(frame, store, k=1, rounds=1, dims=1, scale=10, seed=3)


# --- fill in the middle ------------------------------------------------------

def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix, ends = fill_middle.WaveletMatrix(symbols), np.arange(n + 1)
        for s in range(8):
            assert matrix.rank(s, ends).tolist() == [0, *np.cumsum(symbols == s).tolist()]


UNIT = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "character": r"(?s:.)"}


def plain_cut(doc_id, text, unit, percent, spm):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    assert "".join(units) == text
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i: 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["\n", "\n\n\n", "a\n", "a\nb", "a\n\nb\n", "x <P> y\nz\n", "<", "<\n<\n", "S>\n<P", "日本\n🦊\r\né", "one\n" * 5000, "y" * 30000]


@pytest.mark.parametrize("unit,percent,together", [("line", 100, 4 << 20), ("line", 60, 50), ("sentence", 100, 4 << 20), ("character", 100, 1000)])
def test_fill_in_middle(spark, docs, monkeypatch, unit, percent, together):
    monkeypatch.setattr(fill_middle, "TOGETHER", together)
    texts = [(i, t) for i, t, *_ in odd_documents()] + list(enumerate(TEXTS, 100))
    frame = docs.select("doc_id", "text", "n_chars", F.lit(1).alias("n"), F.lit("y").alias("h1")).unionByName(
        spark.createDataFrame([(i, t, 0, 1, "y") for i, t in enumerate(TEXTS, 100)], "doc_id long, text string, n_chars long, n int, h1 string"))
    got = fill_middle.transform(frame, unit=unit, seed=7, percent=percent, suffix_first=50)
    rows = got.withColumn("restored", fill_middle.restored()).collect()
    assert all(r.restored == r.text for r in rows)
    order = lambda rows: sorted(rows, key=str)
    expected = [plain_cut(i, t, unit, percent, 50) for i, t in texts]
    assert order((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows) == order(expected)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.transform(frame.limit(0)).count() == 0


# --- page text ---------------------------------------------------------------

BODY = "<p>First, a sentence of some length, with commas.</p><p>Second one, &lt;b&gt; &amp; more,\n\t here.</p>"
TEXT = "First, a sentence of some length, with commas.\nSecond one, <b> & more, here."
CASES = [
    (None, ""), ("", ""), ("   \n ", ""), ("<", "<"), ("just words", "just words"), ("<script>var x = '<p>never closed", ""),
    (f"<article>{BODY}</article>", TEXT), (f"<div>{BODY}", TEXT), (f"<DIV CLASS=x>{BODY}</Div>", TEXT),
    (f"<nav><ul><li><a href=/>Home, sweet, home</a></ul></nav><header>Site, name</header><div>{BODY}</div><footer>Me, too</footer>", TEXT),
    (f"<div class='sidebar'>{BODY * 3}</div><article>{BODY}</article>", TEXT),
    (f"<main><div>{BODY}</div><div id='comments'><p>{'so, true, ' * 50}</p></div></main>", TEXT),
    (f"<body class='no-sidebar has-ads'><div class=cookieNotice>We, use, cookies.</div><div>{BODY}</div>", TEXT),
    (f"<article><header><h1>Head</h1><span>by me</span></header>{BODY}<aside>See, also</aside><form>Name, <input></form></article>", "Head\n" + TEXT),
    (f"<article>{BODY}<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul></article>", TEXT),
    (f"<article>{BODY}<ul><li>one<li>two <a>link</a><li>three</ul></article>", TEXT + "\none\ntwo link\nthree"),
    (f"<article>{BODY}<p hidden>not, this</p><div style='display: none'>nor, that</div></article>", TEXT),
    (f"<table><tr><td class=menu>a, b<td><h1>T</h1>{BODY}</table>", "T\n" + TEXT),
    (f"<div><section>{BODY}</section><section>{BODY}</section></div>", TEXT + "\n" + TEXT),
    (f"<!-- <p>x, y</p> --><div><p><b>Bold<br>line<p>Next<script>'</p>'</script> part</p></div>", "Bold line\nNext part"),
    ("<div><p>a &am; &#65; &eacute;&nbsp;b</div>", "a &am; A é b"), ("<div>loose, text<p>para, graph</p>tail</div>", "loose, text\npara, graph\ntail"),
    ("<div class=ad>only, this</div>", "only, this"), ("<nav>only, this</nav>", ""), ('<p title="a > b">quoted</p>', "quoted"),
    ("<ul><li><a>1</a><li><a>2</a><li><a>3</a></ul>", ""), ("<p>a < b and c > d</p>", "a < b and c > d"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_main_text(html, text):
    assert main_text(html) == text


def test_hostile_pages_take_time_in_proportion():
    import time

    began = time.time()
    for page in ("<div>" * 50000 + "x", '<p><a "' * 50000, "<p><table><td>" * 20000 + "x", "<" * 500000, "<!--" * 100000, "</b>" * 100000):
        main_text(page)
    assert time.time() - began < 30


def plain_page(html):
    """The pages of the test tables: an article of a heading and paragraphs."""
    import html as h

    inside = html[html.index("<article>") + 9: html.index("</article>")]
    parts = [re.sub(r"\s+", " ", h.unescape(p.replace("<b>", "").replace("<br>", " "))).strip() for p in re.split("</?(?:h1|p)>", inside)]
    return "\n".join(p for p in parts if p)


def test_pages_of_the_test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.url, r.text) for r in page_text.extract(pages).collect()}
    assert got == {r.page_id: (r.url, plain_page(r.html)) for r in pages.collect()}


def test_page_rows(spark):
    frame = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (None, None, None, None), (2, "", "", "z")],
                                  "page_id long, url string, html string, text string")
    got = sorted(map(tuple, page_text.extract(frame).collect()), key=str)
    assert got == sorted([(1, "u", "a"), (1, "u", "a"), (None, None, ""), (2, "", "")], key=str)
    assert page_text.extract(frame.limit(0)).count() == 0
