import html
import itertools
import re

import numpy as np

from bondwise.llm import html_crf, queries
from bondwise.llm.html_blocks import blocks
from bondwise.llm.html_pages import labelled

SF = "/root/testdata/sf0.001"


def test_blocks_read_broken_markup():
    page = (
        "<html><head><title>T</title><script>var t='</p>';if(a<b)</script><style>p{}</style></head><body><!-- x <p>no</p> -->"
        "<ul class='Nav Top-2'><li><a href=\"/a>b\">One&nbsp;two</a><li>Three &amp; four</ul><article><p><b>Bold\n text<br><p>Next &lt;b&gt; 1 < 2 &am"
    )
    found = blocks(page)
    assert [b.text for b in found] == ["One two", "Three & four", "Bold text", "Next <b> 1 < 2 &am"]
    assert found[0].path == (("html", ""), ("body", ""), ("ul", "nav top"), ("li", "")) and found[0].linked == 7
    assert found[3].path == (("html", ""), ("body", ""), ("article", ""), ("p", ""))
    assert blocks("") == [] and [b.text for b in blocks("plain")] == ["plain"] and blocks("<script>x") == []


def test_left_out_end_tags_of_silent_elements():
    texts = lambda page: [b.text for b in blocks(page)]
    assert texts("<head><title>T</title><meta x><div>one</div><section>two</section>") == ["one", "two"]
    assert texts("<head><style>p{}</style>plain") == ["plain"]
    assert texts("<form><select><option>A<option>B</select></form><div>text</div>") == ["text"]
    assert texts("<form><select><optgroup><option>A<optgroup><option>B</form><section>text</section>") == ["text"]
    assert texts("<p>a <select><option>A<option selected>B</select> b</p><p>c") == ["a b", "c"]
    assert texts("<input list=x><datalist id=x><option>A<option>B</datalist><p>text") == ["text"]
    for name in ("button", "object", "svg", "select", "video"):
        assert texts(f"<article><p>a<{name}>x</p><p>b</p><{name}>y<p>c</p><p>d <{name}>z</{name}> e</p></article>") == ["a", "b", "c", "d e"]
    assert texts("<div>a<button><div>x</div>y</button>b</div>") == ["a b"]
    assert texts("<object>x<object>y</object>z</object><p>text") == ["text"]
    assert texts("<template><article>x</article></template><p>text") == ["text"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]


def test_marginals_and_viterbi_match_enumeration():
    rng = np.random.default_rng(3)
    step = rng.normal(size=(2, 2))
    e = rng.normal(size=5).tolist()
    score = {y: sum(x for x, l in zip(e, y) if l) + sum(step[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=5)}
    total = sum(map(np.exp, score.values()))
    p, pairs, log = html_crf.marginals(e, step)
    assert np.isclose(log, np.log(total))
    assert np.allclose(p, [sum(np.exp(s) for y, s in score.items() if y[k]) / total for k in range(5)])
    want = np.zeros((2, 2))
    for y, s in score.items():
        for a, b in zip(y, y[1:]):
            want[a, b] += np.exp(s) / total
    assert np.allclose(pairs, want)
    model = html_crf.Crf({}, step.tolist())
    model.emission = lambda block, k, n: e[k]
    assert tuple(map(int, model.decode([None] * 5))) == max(score, key=score.get)


def test_held_out_labelled_pages():
    model, wrong, total = html_crf.train(), 0, 0
    for page, labels in labelled(200, 77):
        for feats, want in html_crf.training_rows([(page, labels)]):
            got = model.decode(blocks(page))
            wrong, total = wrong + sum(a != b for a, b in zip(got, want)), total + len(want)
    assert total > 2000 and wrong / total < 0.02


def test_pages_of_the_table(spark):
    """The article element of the table's pages is known, so the result can be compared in full."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op7_html(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(filter(None, parts)) and r["n_chars"] == len(r["text"])


def test_edges(spark):
    page = "<body><nav><a>Home</a></nav><article><h1>A headline of some words</h1><p>" + "A sentence of the article, plain. " * 20000 + "</p></article></body>"
    rows = [(1, None, "t", 0), (2, "", "t", 0), (None, page, "t", 0), (4, "<nav><ul><li><a>x</a></li></ul></nav>", "t", 0), (5, page, "t", 0), (5, page, "t", 0)]
    got = html_crf.extract(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got)[-1][1] > 600_000 and len(got) == 6
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] in (1, 2, 4)} == {1: "", 2: "", 4: ""}
    assert html_crf.extract(spark.createDataFrame(rows[:0], "page_id long, html string")).collect() == []


def test_pages_that_are_little_but_their_article():
    """One block, breaks in one box, bare text, captions, and a layout table with a cell of links."""
    model, s = html_crf.train(), "A first sentence of the text, plain and long enough. Another one follows it here."
    text = lambda page: html_crf.extract_page(page, model)
    assert text(f"<body><p>{s}</p><p>{s}</p></body>") == f"{s}\n\n{s}" and text(f"<p>{s}") == s
    assert text(f"<div>{s}<br><br>{s}</div>") == f"{s} {s}" and text(f"<div class=content>{s}</div>") == s
    page = f"<article><h1>Title of it</h1><p>{s}</p><figure><img src=x><figcaption>A short caption</figcaption></figure><p>{s}</p></article>"
    assert text(page) == f"Title of it\n\n{s}\n\nA short caption\n\n{s}"
    assert text(f"<table><tr><td><a href=1>Home</a> <a href=2>News</a> <a href=3>About</a></td><td><p>{s}</p><p>{s}</p></td></tr></table>") == f"{s}\n\n{s}"
    assert text(f"<body><nav><a href=1>Home</a><a href=2>About</a></nav><p>{s}</p><footer>&copy; Some site</footer></body>") == s


def test_every_block_of_the_plans_is_known():
    for page in labelled(400, 5):
        assert html_crf.training_rows([page])
