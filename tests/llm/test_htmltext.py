import pytest

from queuelens.llm import htmltext, pagemaker

from .conftest import wide


@pytest.fixture(scope="module")
def model():
    return htmltext.fit()


def test_blocks_of_broken_pages():
    def texts(page):
        return [b.text for b in htmltext.leaf_blocks(page)]
    assert texts('<p>a <b>b</b>&amp;c<br>d<p>e</p> tail<ul><li>x<li>y</ul>') == ["a b&c d", "e", "tail", "x", "y"]
    assert texts('<script>var t="</p><p>no";</script><style>p{}</style><!-- <p>no --><p title="a>b">yes') == ["yes"]
    assert texts("1 < 2 and <p") == ["1 < 2 and"] and texts("") == [] and texts("<<>>") == ["<<>>"]
    assert texts("<div>&lt;p&gt;\u00a0 x \n y</div></div></p>") == ["<p> x y"]


def test_blocks_around_formulas_drawings_and_heads():
    def texts(page):
        return [b.text for b in htmltext.leaf_blocks(page)]
    formula = "<math><msup><mi>r</mi><mn>2</mn></msup><semantics><mo>=</mo><annotation>r^2=</annotation></semantics></math>"
    assert texts(f"<p>The area is {formula} in this long sentence.</p>") == ["The area is r2= in this long sentence."]
    assert texts("<p>one <svg><g><path d=1><title>no</title></g></svg> two<script>no</script> three</p>") == ["one two three"]
    assert texts("<p>one <svg><path d=1><p>two</p>") == ["one", "two"]
    assert texts("<svg/>a<p>b <mspace/>c</p>") == ["a", "b c"]
    assert texts("<head><title>t</title><meta x><h1>A</h1><p>b") == ["A", "b"]
    assert texts("<html><head><title>t</title><style>p{}</style> Text <b>c</b><p>d") == ["Text c", "d"]
    assert texts("<head><noscript><p>no</p></noscript></head><body><noscript>on</noscript><object data=x>alt</object>z") == [
        "on", "alt", "z"]
    assert texts("<body><select><option>no<div>no</select><p>yes") == ["yes"]


def old_style_pages(n):
    """(html, labels) of another build than the training pages: table layouts, roles, English words, other names."""
    import random
    words = "the of and to in is that for it was on are as with at be this have from or one had by word but not".split()
    rng = random.Random(77)

    def text(least, most):
        return " ".join(rng.choices(words, k=rng.randint(least, most)))
    for _ in range(n):
        menu, body, links, labels = rng.randint(3, 8), rng.randint(2, 9), rng.randint(2, 5), []
        html = f"<HTML><HEAD><TITLE>{text(2, 5)}</TITLE><BODY bgcolor=white><TABLE width=100%><TR><TD role=navigation class='menu left'>"
        html += "".join(f"<A href=/{k}>{text(1, 3)}</A><BR>" for k in range(menu)) + "</TD>"
        labels.append(0)
        html += "<TD id=main-content class='article body'><H1>" + text(3, 8).capitalize() + "</H1>"
        labels.append(1)
        for _ in range(body):
            html += "<P>" + ". ".join(text(8, 20).capitalize() for _ in range(rng.randint(1, 4))) + ".\n"
            labels.append(1)
        html += "</TD><TD class='sidebar related'>"
        for _ in range(links):
            html += f"<DIV><A href=/x>{text(2, 5)}</A></DIV>"
            labels.append(0)
        html += f"</TD></TR></TABLE><DIV class='footer'>Copyright 2009 {text(2, 6)}</DIV></BODY></HTML>"
        labels.append(0)
        yield html, labels


def test_pages_of_another_build(model):
    blocks = wrong = 0
    for page, labels in old_style_pages(60):
        found = model.viterbi(htmltext.leaf_blocks(page))
        assert len(found) == len(labels)
        blocks += len(labels)
        wrong += sum(a != b for a, b in zip(found, labels))
    assert wrong < 0.03 * blocks, (wrong, blocks)


def test_deep_pages_take_linear_time():
    import time
    start = time.process_time()
    deep = "<div class=a><b>x</b>" * 60_000 + "</td></li>" * 1000 + "<li>" * 20_000 + "end"
    blocks = htmltext.leaf_blocks(deep)
    assert len(blocks) == 60_001 and blocks[-1].text == "end" and time.process_time() - start < 20


def test_held_out_pages(model):
    blocks = wrong = 0
    for page, labels in pagemaker.pages(150, seed=41):
        found = model.viterbi(htmltext.leaf_blocks(page))
        assert len(found) == len(labels)
        blocks += len(labels)
        wrong += sum(a != b for a, b in zip(found, labels))
    assert wrong < 0.005 * blocks


def test_viterbi_finds_the_best_path(model):
    import itertools

    import numpy as np
    page, _ = next(p for p in pagemaker.pages(40, seed=8) if 4 <= len(p[1]) <= 10)
    blocks = htmltext.leaf_blocks(page)
    score = [model.weights[row].sum(axis=0) for row in model.rows(blocks)]

    def total(states):
        return sum(score[k][s] for k, s in enumerate(states)) + sum(model.pairs[a, b] for a, b in zip(states, states[1:]))
    best = max(itertools.product((0, 1), repeat=len(blocks)), key=total)
    assert total(model.viterbi(blocks)) == pytest.approx(total(best))
    state, both = htmltext._marginals(np.array(score), model.pairs)
    weights = {s: np.exp(total(s)) for s in itertools.product((0, 1), repeat=len(blocks))}
    whole = sum(weights.values())
    assert state[2, 1] == pytest.approx(sum(w for s, w in weights.items() if s[2]) / whole, abs=1e-6)
    assert both[0, 1] == pytest.approx(sum(w * sum(a == 0 and b == 1 for a, b in zip(s, s[1:])) for s, w in weights.items()) / whole, abs=1e-6)


def test_pages_of_the_table(spark, sf_dir, model):
    import html
    import re
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in htmltext.extract(pages, model).collect():
        article = re.search(r"<article>(.*?)</article>", r.row.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in parts if x)


def test_edge_cases(spark, model):
    page = "<article><p>" + "long words here. " * 60_000 + "</p></article><footer>&copy; x</footer>"
    rows = [(1, None, None), (None, "u", ""), (2, "u", page), (3, "u", "<p>cut off <b"), (3, "u", "<p>cut off <b")]
    pages = wide(spark.createDataFrame(rows, "page_id bigint, url string, html string"), "row", "text", "in_html")
    found = htmltext.extract(pages, model).collect()
    assert len(found) == 5 and [r.text for r in found if r.row.page_id in (None, 1)] == ["", ""]
    assert [r.text for r in found if r.row.page_id == 2] == [("long words here. " * 60_000).strip()]
    assert htmltext.extract(pages.filter("false"), model).count() == 0
    with pytest.raises(ValueError):
        htmltext.fit([("<p>a", [1, 0])])
