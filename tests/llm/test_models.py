from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD_TEXTS, documents

from ledgerwork.llm import gbt, html_extract, quality, toxicity

SYLLABLES = "an en ti re st on ou la er the ing and".split()


def _corpus(n, odd):
    """Texts and labels; a third is spoiled by `odd`."""
    draw = random.Random(9)
    texts, labels = [], []
    for k in range(n):
        words = ["".join(draw.choices(SYLLABLES, k=draw.randint(1, 3))) for _ in range(draw.randint(20, 160))]
        spoiled = k % 3 == 0
        if spoiled:
            words = odd(words, draw)
        texts.append((k, " ".join(words)))
        labels.append((k, int(spoiled)))
    return texts, labels


def _toxic(words, draw):
    for _ in range(max(2, len(words) // 12)):
        words.insert(draw.randrange(len(words)), draw.choice(("moron", "worthless", "disgusting")))
    return words


def _junk(words, draw):
    return draw.choice(([words[0]] * len(words), [w.upper() + "!!" for w in words], [w + "%%%" for w in words]))


def _auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.mark.parametrize("module, odd, label, flip", [(toxicity, _toxic, "toxic", False), (quality, _junk, "quality", True)])
def test_held_out_accuracy(spark, module, odd, label, flip):
    texts, labels = _corpus(450, odd)
    table = spark.createDataFrame([(k, 1 - y if flip else y, "x") for k, y in labels], f"doc_id long, {label} int, text string")
    scored = module.classify(documents(spark, texts), table).collect()
    truth = {k: 1 - y if flip else y for k, y in labels}
    held = [(r.score, truth[r.doc_id]) for r in scored if r.held_out]
    assert len(held) > 60 and _auc(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, module, label):
    table = spark.createDataFrame([(4, None), (None, 1), (99, 1)], f"doc_id long, {label} int")
    docs = documents(spark, ODD_TEXTS)
    assert len(module.classify(docs, table).collect()) == len(ODD_TEXTS)
    assert module.classify(docs, table.limit(0)).where("score != 0").count() == 0
    assert module.classify(documents(spark, []), table).count() == 0
    kept = module.rejected_out(docs, table.limit(0))
    assert kept.columns == docs.columns


def test_attention_gradient():
    random_numbers = np.random.default_rng(1)
    x, bags, label = random_numbers.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])
    shapes = {"encode": (5, quality.CODE), "encode_at": (quality.CODE,), "value": (quality.CODE, quality.GATE)}
    shapes |= {"gate": (quality.CODE, quality.GATE), "attend": (quality.GATE,), "score": (quality.CODE,), "score_at": ()}
    w = {k: random_numbers.normal(size=s) for k, s in shapes.items()}

    def loss():
        logit = quality._forward(x, bags, w)["logit"]
        return np.mean(np.log1p(np.exp(logit)) - label * logit)

    slopes = quality._gradients(x, bags, label, w)
    for k in w:
        at = tuple(0 for _ in w[k].shape)
        before = w[k].copy()
        w[k] = before.copy()
        w[k][at] += 1e-6
        up = loss()
        w[k][at] -= 2e-6
        down = loss()
        w[k] = before
        assert abs((up - down) / 2e-6 - slopes[k][at]) < 1e-5, k


def test_trees_learn_an_interaction():
    random_numbers = np.random.default_rng(0)
    x = random_numbers.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    trees = gbt.train(x, y, 20, 3, 0.3)
    assert ((trees.log_odds(x) > 0) == y).mean() > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><header><a href="/">Site</a></header><div class="ad">Buy <b>now</b></div>
<article><h1>A &amp; B</h1><p>First   <b>bold</b>text,<br>next &lt;line&gt;.<p>Second&nbsp;one &eacute;.</p><!-- <p>no</p> -->
<form><input><button>Go</button></form><section class="comments"><p>Reader says</p></section></article>
<aside class="sidebar">Side</aside><footer>&copy; x</footer></body></html>"""


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.fit(spark.createDataFrame([(PAGE,)], "html string"))


def test_page(spark, trees):
    pages = [(1, "u", PAGE, "x"), (2, None, None, None), (3, "u", "", ""), (4, "u", PAGE[:560], "y"), (5, "u", "<<<p>&#x;</b></article>", "z"), (6, "u", PAGE, "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    rows = html_extract.extract(table, trees, "main").collect()
    got = {r.page_id: r.main for r in rows}
    assert got[1] == got[6] == "A & B First boldtext, next <line>. Second one é."
    assert got[2] == got[3] == ""
    assert got[4].startswith("A & B First boldtext")
    assert html_extract.extract(table.limit(0), trees, "main").count() == 0


def test_a_self_closed_svg_hides_nothing(spark, trees):
    icons = ('<svg class="icon"/>', "<svg/>", "<svg><text>no</text></svg>")
    pages = [(k, PAGE.replace("<article>", "<article>" + icon)) for k, icon in enumerate(icons)]
    pages.append((3, PAGE.replace("<article>", "<article><svg />").replace("<aside", "<svg><path/></svg><aside")))
    rows = html_extract.extract(spark.createDataFrame(pages, "page_id long, html string"), trees).collect()
    assert {r.text for r in rows} == {"A & B First boldtext, next <line>. Second one é."}


def test_decoding_never_contradicts(trees):
    draw = random.Random(3)
    for _ in range(20):
        page = html_extract.Page(html_extract._wrappings(draw))
        odds = np.random.default_rng(1).normal(size=len(page.tags))
        chosen = page.decode(odds)
        assert all(not chosen[k] or chosen[page.parents[k]] for k in range(1, len(chosen)))


def test_made_pages_that_were_not_learned_from(trees):
    draw = random.Random(123)
    share = []
    for _ in range(60):
        source = html_extract._wrappings(draw)
        page = html_extract.Page(source)
        marks = [bool(m[3] and "data-in" in m[3]) for m in html_extract._TAG.finditer(source) if m[2] and m[2].lower() != "html"]
        want = page.text(np.array([True, *marks])).split()
        got = page.text(page.decode(trees.log_odds(page.features()))).split()
        both = sum(min(want.count(w), got.count(w)) for w in set(want))
        share.append(2 * both / (len(want) + len(got)) if want or got else 1)
    assert np.mean(share) > 0.97


@pytest.mark.parametrize(
    "source, parents, texts",
    [
        ("<p data-x=it's>one", [-1, 0], [(1, "one")]),
        ('<p title="it>one', [-1, 0], []),
        ("<p title=\"it>one\" class='a'>two", [-1, 0], [(1, "two")]),
        ("<a href=/x/>in</a>out", [-1, 0], [(1, "in"), (0, "out")]),
        ("<div/>inside", [-1, 0], [(1, "inside")]),
        ('<svg class="icon"/>after', [-1, 0], [(0, "after")]),
        ("<svg><p>no</p></svg>yes", [-1, 0], [(0, "yes")]),
        ("x<br/>y<img src=a/>z", [-1, 0, 0], [(0, "x"), (0, "y"), (0, "z")]),
        ("<script/>no</script>yes", [-1, 0], [(0, "yes")]),
        ("<p =x a=>e", [-1, 0], [(1, "e")]),
    ],
)
def test_tags_are_read_as_browsers_do(source, parents, texts):
    page = html_extract.Page(source)
    assert (page.parents, [t for t in page.texts if t[1]]) == (parents, texts)


def test_extracted_column_does_not_clash(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some words of an article, and more of them.</p></article>", "own")], "page_id long, url string, html string, text string")
    out = html_extract.extract(pages, html_extract.fit(pages))
    assert out.columns == ["page_id", "url", "html", "text", "_text"] and out.first().text == "own"


def test_quality_texts_do_not_reach_the_driver(spark, monkeypatch):
    """Passages are described where the texts are; a text that repeats counts once."""
    texts, labels = _corpus(60, _junk)
    table = spark.createDataFrame([(k, 1 - y) for k, y in labels], "doc_id long, quality int")
    labelled_texts = spark.createDataFrame([(texts[k][1], y) for k, y in [*labels, *labels[:9]]], "text string, label int").coalesce(1)
    x, bags, label = quality._features_of(labelled_texts)
    want, want_bags = quality.passages(pa.array([t for _, t in texts]))
    assert (x == want).all() and (bags == want_bags).all() and label.tolist() == [y for _, y in labels]

    driver, described = os.getpid(), quality.passages

    def elsewhere(column):
        assert os.getpid() != driver
        return described(column)

    docs = documents(spark, texts)
    whole = quality.fit(docs, table)
    monkeypatch.setattr(quality, "passages", elsewhere)
    assert quality.fit(docs, table).mean.tolist() == whole.mean.tolist()
