import html
import itertools
import re

import numpy as np
import pytest

from spendscope.llm import boosting
from spendscope.llm import html_extraction as h


@pytest.fixture(scope="module")
def model():
    return h.default_model()


def article_by_hand(page):
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in h.extracted(pages, model).collect()}
    for page in pages.collect():
        want = article_by_hand(page.html)
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want) and got[page.page_id].url == page.url


def test_held_out_templates(model):
    good = bad = 0
    for page in map(h.parse, h.training_pages(150, seed=1234)):
        truth = h.truth(page)
        kept = h.decode(model.trees.logits(h.features(page, model.telling)), page.parent)
        wrong = sum(bool(kept[n]) != bool(truth[n]) for n, _ in page.runs)
        bad += wrong
        good += len(page.runs) - wrong
    assert bad <= 0.02 * (good + bad)


def test_common_boilerplate(model):
    text = "This is a long paragraph of the article, with commas, and some more words to make it look like prose. " * 3
    page = f"""<html><body><div class="cookie-notice"><p>We use cookies to improve things.</p><button>OK</button></div>
      <header class="site-header"><h1>Site</h1><ul class="menu"><li><a href=/a>A</a><li><a href=/b>B</a></ul></header>
      <main><article><h1>Title &amp; more</h1><p>{text}<p>{text}<div class="ad">Buy now, cheap</div><ul><li>first point of the list<li>second point of the list</ul><p>{text}</article></main>
      <aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>x</a></li></ul></aside>
      <section id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>I liked this article very much, thank you for writing it.</p></div></section>
      <form class="newsletter"><label>Mail</label><input><button>Go</button></form><footer>&copy; Site</footer></body></html>"""
    prose = " ".join(text.split())
    assert model.texts([page]) == ["\n\n".join(["Title & more", prose, prose, "first point of the list", "second point of the list", prose])]


@pytest.mark.parametrize("seed", range(5))
def test_decoding_is_the_best_consistent_choice(seed):
    r = np.random.default_rng(seed)
    parent = [-1] + [int(r.integers(0, i)) for i in range(1, 9)]
    logit = r.normal(size=9)
    choices = [c for c in itertools.product([False, True], repeat=9) if all(p < 0 or c[p] or not c[i] for i, p in enumerate(parent))]
    best = max(choices, key=lambda c: sum(x if k else -x for k, x in zip(c, logit)))
    assert h.decode(logit, parent).tolist() == list(best)


@pytest.mark.parametrize("page, runs", [
    ("", []), ("just text", ["just text"]), ("<p>a<p>b</p>c", ["a", "b", "c"]), ("<b>a</p>b", ["a", "b"]), ("a<br>b&nbsp; &lt;c&gt; &#x41;&eacute;", ["a b <c> Aé"]),
    ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", ["a", "b", "c", "d"]), ("<script>x</p></script>y<style>z", ["y"]), ("<!-- <p>a --><p>b<!-- open", ["b"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<p title='a>b\">c</p>d", None), ("<p>a <a href='x'>b</a> c</p>", ["a b c"]), ("a <b", ["a"]), ("1 < 2 > 1", ["1 < 2 > 1"]),
    ("<div>a<p>b<div>c</div>d</div>", ["a", "b", "c", "d"]), ("<textarea><p>a</textarea><p>b", ["b"]), ("<template><p>a</p></template>b", ["b"]), ("<P CLASS=Main>a</P>", ["a"]), ("</div></p>a", ["a"]),
    ("<p>a</p", ["a"]), ("<head><title>t</title></head>a", ["a"]), ("x<svg><text>y</text></svg>z", None),
])
def test_parser(page, runs):
    got = [t for _, t in h.parse(page).runs]
    assert runs is None or got == runs


def test_hostile_pages_take_linear_time(model):
    for page in ("<a " * 100_000, "<a \"" * 100_000, "<div>" * 3_000 + "x", "<" * 300_000, "<p '" + "\"'" * 100_000, "<!--" * 100_000, "<li>" * 20_000 + "x"):
        model.texts([page])


def test_messy_rows(spark, model):
    kind = "page_id long, url string, html string, text string, n_chars long, out string"
    long = "<article>" + "<p>A sentence of the very long article, which goes on and on.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", " <nav></nav>"), (3, "u", long), (3, "u", long), (4, "u", "<article><p>Short one.</p></article>")]
    df = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], kind)
    got = h.extracted(df, model).collect()
    assert len(got) == 6 and {r.text for r in got if r.page_id in (1, 2, None)} == {""}
    assert {r.text.count("\n\n") for r in got if r.page_id == 3} == {19_999}
    assert h.extracted(df.limit(0), model).count() == 0


def test_boosting_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.4)).astype(int)
    trees = boosting.fit(x[:3000], y[:3000], depth=3)
    assert ((trees.logits(x[3000:]) > 0) == y[3000:]).mean() > 0.97
    assert (boosting.fit(x, np.zeros(4000)).logits(x) < 0).all() and (boosting.fit(x[:0], y[:0]).logits(x) == 0).all()
