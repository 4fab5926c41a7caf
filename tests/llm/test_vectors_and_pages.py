"""Searches against brute force, and page extraction."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, html_text, mih

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    v = rng.standard_normal((500, 64)).astype("f4")
    v[100:200] = v[100]
    v[200:260] = v[100] + (rng.standard_normal((60, 64)) * 1e-3).astype("f4")
    return v


def frame(spark, v):
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(len(v))]
    odd = [(None, [1.0] * 64, 0), (900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, [None] + [1.0] * 63, 0), (904, [1.0], 0), rows[5]]
    return spark.createDataFrame(rows + odd, SCHEMA)


@pytest.mark.parametrize("block", [10_000, 20])
def test_nearest(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", block)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", block)
    got = ann.nearest(frame(spark, vectors), F.col("id") % 50 == 0).toPandas()
    v = vectors.astype(float)
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 500, 50):
        s = n[q] @ n.T
        s[q] = -9
        best = np.lexsort((np.arange(500), -np.round(s, 12)))[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(own.score, s[own.vec_id], atol=1e-12)
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 0.9 * 50
    assert got[got.query_id == 100].vec_id.tolist() == [101, 102, 103, 104, 105]
    assert ann.nearest(frame(spark, vectors).limit(0), F.col("id") % 50 == 0).count() == 0


def test_nearest_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], SCHEMA)
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(df, F.col("id") == 0).collect()] == [(0, 1, 0.0)]


def test_every_length_is_searched_and_every_query_filled(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(12 if i % 3 else 7).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # Tables that find nearly nothing: the search widens until every query has its rows.
    monkeypatch.setattr(ann, "settled", lambda *args: (1, 20, 1))
    got = ann.nearest(df, F.col("id") % 50 == 0, width=1e-3).toPandas()
    for q in range(0, 300, 50):
        own = [(i, np.array(v)) for i, v in rows if len(v) == len(rows[q][1]) and i != q]
        v = np.array(rows[q][1])
        best = sorted(((-float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), i) for i, x in own))[:5]
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == [i for _, i in best]


@pytest.mark.parametrize("levels", [mih.LEVELS, ((0, 2, 1), (0, 3, 1), (0, 4, 16))])
def test_exact_hamming(spark, vectors, levels):
    codes = mih.sign_codes(frame(spark, vectors))
    rows = [(i, vectors[i]) for i in range(500)] + [(901, np.zeros(64)), (904, np.ones(1))]
    bits = {i: np.array([v[b::64].sum() >= 0 for b in range(64)]) for i, v in rows}
    assert {r.id: r.code for r in codes.collect()} == {i: int(np.packbits(b, bitorder="little").view("<i8")[0]) for i, b in bits.items()}
    got = sorted(tuple(r) for r in mih.top_k(codes, F.col("id") % 100 == 0, k=10, levels=levels).collect())
    expected = []
    for q in (i for i in bits if i % 100 == 0):
        near = sorted((int((bits[q] ^ b).sum()), i) for i, b in bits.items() if i != q)[:10]
        expected += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    assert got == sorted(expected)
    few = codes.where("id in (0, 1, 2)")
    assert len(mih.top_k(few, F.col("id") == 0, k=10, levels=levels).collect()) == 2
    assert mih.top_k(codes.limit(0), F.col("id") == 0).count() == 0


def test_segment_values_and_folded_codes(spark):
    for width, radius in ((16, 3), (24, 2)):
        masks = mih.masks_of(width, radius)
        assert len(set(masks.tolist())) == len(masks) == math.comb(width, radius) and set(np.bitwise_count(masks)) == {radius}
    df = spark.createDataFrame([(1, [1.0] * 64 + [-2.0] * 3), (2, [])], "vec_id long, embedding array<double>")
    assert [(r.id, r.code) for r in mih.sign_codes(df).collect()] == [(1, -8)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href="/a">A</a><li>B</ul></nav>
<div class="ad">Buy</div>{extra}<article><h1>Head {n}</h1><p><b>First &amp; only&nbsp;{n}.<br>more<p>Second <i>pa</i>rt  {n}</p><p>shared passage</p><div class="comments"><p>bad</p></div><!-- <p>no</p> --></article>
<aside>side</aside><form><p>field</p></form><footer>&copy; x</footer>"""


def test_rules(spark):
    page = html_text.parse(PAGE.format(n=1, extra=""))
    assert html_text.main_text(page, set()) == "Head 1\nFirst & only 1. more\nSecond part 1\nshared passage"
    assert html_text.main_text(html_text.parse(""), set()) == ""
    assert html_text.main_text(html_text.parse("<p>a<p>b<ul><li>c<li>d</ul>e < f"), set()) == "a\nb\nc\nd\ne < f"
    assert html_text.main_text(html_text.parse('<div id="x" title="a > b">q</div><p hidden>z</p><textarea><p>n</textarea>'), set()) == "q"
    assert len(html_text.main_text(html_text.parse("<div>" * 20_000 + "deep"), set())) == 4
    assert html_text.main_text(html_text.parse("<a " + 'x="' * 20_000), set()) == ""


def test_recurring_subtrees_are_deleted_per_host(spark):
    strip = "<div><p>Welcome to our site</p><p>Read this first</p></div>"
    bare = "<body>" + strip + "<p>Own text {n}</p></body>"
    rows = [(i, f"https://a.org/{i}", bare.format(n=i)) for i in range(30)]
    rows += [(100 + i, f"https://b.org/{i}", bare.format(n=7)) for i in range(30)]  # copies of one page: no template
    rows += [(200, "https://c.org/x", bare.format(n=1)), (201, None, None), (202, "", "plain"), rows[3]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert all(got[i] == f"Own text {i}" for i in range(30))
    whole = "Welcome to our site\nRead this first\nOwn text {}"
    assert all(got[100 + i] == whole.format(7) for i in range(30)) and got[200] == whole.format(1)
    assert got[201] == "" and got[202] == "plain"
    assert html_text.extract(df).count() == len(rows) and html_text.extract(df.limit(0)).count() == 0


def test_shared_passages_of_articles_stay(spark):
    rows = [(i, f"https://a.org/{i}", PAGE.format(n=i, extra="<div>Our notice</div>")) for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Head {i}\nFirst & only {i}. more\nSecond part {i}\nshared passage" for i in range(20))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p><b>one</b>\n<i>two</i></p>", "one two"),
        ("<main></main><div><p>hello</p></div>", "hello"),
        ("<article><p>a long enough text</p></article><section><p>more of it</p></section>", "a long enough text\nmore of it"),
        ('<article class="post comments-open"><p>kept</p></article>', "kept"),
        ('<div class="site has-sidebar"><p>kept</p><p>too</p></div>', "kept\ntoo"),
        ('<div class="share-price"><p>12 euro</p></div>', "12 euro"),
        ('<div class="widget"><article><p>kept</p></article></div>', "kept"),
        ('<article><p>text</p></article><div class="related-posts"><p>other</p></div>', "text"),
        ('<article><p>text</p></article><div class="comments"><article><p>me</p></article></div>', "text"),
        ('<article><p>text</p></article><div><a href="/1">one</a> | <a href="/2">two</a></div>', "text"),
        ('<p>text of a page</p><div class="menu-mobile"><a href="/1">one</a></div>', "text of a page"),
        ('<p>text</p><div class="menuLinks">x</div>', "text"),
        ('<div class="ad"><p>all there is</p></div>', "all there is"),
        ("a\n<p>b</p>\n\nc", "a\nb\nc"),
    ],
)
def test_names_decide_only_with_position_or_links(html, text):
    assert html_text.main_text(html_text.parse(html), set()) == text


def test_templates_equal_counts_by_hand(spark):
    blocks = [f"<div><p>block {k}</p></div>" for k in range(6)]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        host = f"h{int(rng.integers(0, 3)) if i % 2 else 9}.org" if i < 390 else "small.org"
        rows.append((i, f"https://{host}/{i}", "<body>" + "".join(b for k, b in enumerate(blocks) if rng.random() < (0.02, 0.04, 0.06, 0.3, 0.6, 0.9)[k]) + f"<p>own {i % 350}</p>"))
    seen, sizes = {}, {}
    for _, url, html in rows:
        host, page = url.split("/")[2], html_text.parse(html)
        hashes = html_text.subtree_hashes(page)
        sizes.setdefault(host, set()).add(hashes[0])
        for k in html_text.countable(page):
            seen.setdefault((host, hashes[k]), set()).add(hashes[0])

    def needed(n):
        return max(3, -(-n // 2)) if n < 16 else min(max(-(-n * 5 // 100), 8), 10)

    expected = {key for key, pages in seen.items() if len(pages) >= needed(len(sizes[key[0]]))}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.templates(df, "html", "url", 8, 0.05, 10)[1].collect()
    assert {(r.host, r.hash) for r in got} == expected and len(got) == len(expected) > 5
    clash = df.withColumns({"key": F.lit(1), "gone": F.lit(2), "source": F.lit(3), "host": F.lit(4), "salt": F.lit(5)})
    assert html_text.extract(clash).columns == [*clash.columns, "text"] and html_text.extract(clash).count() == 400
