import html
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from delaylens.llm import html_text

FOLDER = "/root/testdata/sf0.01"


def expected(page):
    """The given pages have one article of headings and paragraphs; some are cut off."""
    body = page[page.index("<article>") + 9:].split("</article>")[0]
    body = re.sub(r"<[^>]*$", "", body).replace("<br>", " ")
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r.page_id: r for r in entry.queries()["op6_html_text"](spark, FOLDER).collect()}
    assert set(got) == {p.page_id for p in pages}
    for p in pages:
        assert (got[p.page_id].url, got[p.page_id].text) == (p.url, expected(p.html)), p.page_id
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(spark.read.parquet(f"{FOLDER}/pages.parquet"))


OTHER = """<html><body><div id="cookie-notice"><p>We use cookies, as everybody does.</p></div><header><h1>Site</h1></header>
<div class="menu"><a href=x>Home</a> <a href=y>About</a></div><div class="layout"><div class="post-content">
<h2>Title &eacute;</h2><p>The quick brown fox, jumps over the lazy dog. And then it went on, for a long time.
<p>Second&nbsp; paragraph, <b>with</b> more words; it is also long enough to be an article.<ul><li>one<li>two</ul></div>
<div class="sidebar"><ul><li><a href=z>Link</a></li></ul></div><div id="comments"><p>Great article, I loved reading this one, thanks.</p>
</div></div><form><input><label>Mail</label></form><script>if (a < b) document.write("<p>no</p>")</script><footer>c 2020</footer></body>"""


def test_other_layouts(model):
    text, = html_text.main_texts([OTHER], model)
    assert text == ("Title é\nThe quick brown fox, jumps over the lazy dog. And then it went on, for a long time.\n"
                    "Second paragraph, with more words; it is also long enough to be an article.\none\ntwo")


def test_decoding_never_keeps_below_a_dropped_node():
    nodes = [html_text.Node("#page", frozenset(), -1, 0)] + [html_text.Node("div", frozenset(), p, 1) for p in (0, 1, 1, 0, 4)]
    kept = html_text.decode(nodes, [0, -4, 3, -1, 2, -3])
    assert kept == [True, False, False, False, True, False]
    assert html_text.decode(nodes, [0, -1, 4, 4, 1, 1])[1:4] == [True, True, True]


def test_edge_cases(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text & more"), (4, "u", "<p>" * 3000 + "<div>" * 3000 + "deep"), (5, "u", "<a href='x"),
            (6, "u", "<!-- never closed <p>x</p>"), (7, "u", "<script>x"), (8, "u", "<article><p>" + "word, " * 100_000), (8, "u", "</p></div>&amp;lt;"),
            (9, "u", "< 3 <3 a<b \x00 <" + "'\"" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = html_text.extract(df, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got if r.page_id != 8}
    assert by_id[1] == by_id[2] == by_id[6] == by_id[7] == ""
    assert max(r.n_chars for r in got) == 6 * 100_000 - 1
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty).count() == 0


def test_boosting_learns_a_rule():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    assert ((html_text.boost(x, y).margin(x) > 0) == y).mean() > 0.98


def test_sample_comes_from_pages_that_exist(spark, monkeypatch):
    """Pages that are all longer than the bound, among many empty ones, still teach."""
    monkeypatch.setattr(html_text, "SAMPLE_CHARS", 2_500)
    monkeypatch.setattr(html_text, "SAMPLE_PAGES", 12)
    shown = []
    monkeypatch.setattr(html_text, "train_on", lambda sample, real=html_text.train_on: shown.extend(sample) or real(sample))
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where("length(html) > 2500").select("page_id", "url", "html").limit(12)
    empty = spark.range(1000, 4000).selectExpr("id AS page_id", "'u' AS url", "IF(id % 2 = 0, '', NULL) AS html")
    got = html_text.extract(real.unionByName(empty)).where("page_id < 1000").collect()
    assert len(shown) == len(got) > 0 and all(len(s) == 2_500 for s in shown)
    assert all(r.n_chars > 0 for r in got)
