import random
import re

import numpy as np

from quillgraph.llm import html_extract as H


def test_held_out_pages():
    """Generated pages not trained on: nearly all words of the article, hardly any other."""
    r = random.Random(99)
    model, right, kept, wanted = H.fitted(), 0, 0, 0
    for _ in range(150):
        page = H.training_page(r)
        nodes = H.parse(page)
        text = H.blocks(nodes, H.decode(nodes, model.log_odds(H.features(nodes))))
        body = page[page.index("<body>") :]
        want = len(re.findall(r"(?<![\w/])k\w*", re.sub(r"<[^>]*>", " ", body)))
        got = text.split()
        right += sum(w.startswith("k") for w in got)
        kept, wanted = kept + len(got), wanted + want
    assert right / kept > 0.97 and right / wanted > 0.97, (right / kept, right / wanted)


def test_decoding_is_consistent():
    r = random.Random(5)
    nodes = H.parse(H.training_page(r))
    for seed in range(20):
        kept = H.decode(nodes, np.random.default_rng(seed).normal(0, 3, len(nodes)))
        at = {id(x): k for x, k in zip(nodes, kept, strict=True)}
        assert all(at[id(x.parent)] for x, k in zip(nodes, kept, strict=True) if k and x.parent)


def test_decoding_is_best():
    """The kept nodes are worth the most of all choices without a kept node under a dropped one, and trees lower the loss."""
    r = np.random.default_rng(6)
    for _ in range(60):
        nodes = [H.Node("#root", None)]
        for _ in range(int(r.integers(0, 9))):
            up = nodes[int(r.integers(0, len(nodes)))]
            up.children.append(H.Node("div", up))
            nodes.append(up.children[-1])
            nodes[-1].parts = ["x" * int(r.integers(0, 30))]
        odds = r.normal(0, 3, len(nodes))
        weight = [1 + np.log1p(sum(map(len, x.parts))) for x in nodes]
        worth = np.clip(odds, -8, 8) * weight
        at = {id(x): i for i, x in enumerate(nodes)}
        best = -1e9
        for choice in range(1 << len(nodes)):
            keep = [choice >> i & 1 for i in range(len(nodes))]
            if all(not keep[i] or x.parent is None or keep[at[id(x.parent)]] for i, x in enumerate(nodes)):
                best = max(best, sum(w if k else -w for w, k in zip(worth, keep)))
        kept = H.decode(nodes, odds)
        assert abs(sum(w if k else -w for w, k in zip(worth, kept)) - best) < 1e-9


def test_boosting_fits_held_out_rows():
    r = np.random.default_rng(7)
    x = r.normal(size=(4000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.5)).astype(float)
    model = H.Boosted(x[:3000], y[:3000])
    assert ((model.log_odds(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.97


PAGES = [
    (
        """<!doctype html><html lang=en><head><title>Storm</title><meta charset=utf-8></head><body><header class="site-header"><a href="/">The Gazette</a><nav><ul><li><a href="/w">World</a><li><a href="/s">Sport</a></ul></nav></header>
        <main id="content"><article><h1>Storm cuts power to the coast</h1><p>Thousands of homes were without power on Monday, after a storm crossed the coast overnight and brought down lines.</p>
        <p>Crews worked through the morning, the company said, and most lines should be back by the evening.</p></article><aside class="related"><h3>Related</h3><ul><li><a href="/1">Rain to come</a></li><li><a href="/2">Rivers rise</a></li></ul></aside></main>
        <footer><p>Copyright The Gazette. <a href="/terms">Terms</a> <a href="/help">Help</a></p></footer></body></html>""",
        "Storm cuts power to the coast\n\nThousands of homes were without power on Monday, after a storm crossed the coast overnight and brought down lines.\n\nCrews worked through the morning, the company said, and most lines should be back by the evening.",
    ),
    (
        """<html><body><div id="page"><div class="navigation"><a href="/a">Home</a> <a href="/b">Archive</a> <a href="/c">About</a></div><div class="cookie-consent"><p>We use cookies on this site.</p><button>Accept</button></div>
        <div class="post"><h1>Baking rye bread</h1><p>Rye holds a lot of water, so the dough stays wet, and it needs a tin. A starter that was fed the evening before works best, in my kitchen at least.</p>
        <ul><li>500 g of rye flour</li><li>400 g of water, warm</li><li>a spoon of salt</li></ul><p>Bake it for an hour, and let it rest for a day before you cut it &ndash; it is worth the wait.</p></div>
        <div id="comments"><h3>Comments</h3><div class="comment">Great recipe, thanks a lot!</div><div class="comment">Mine was too wet.</div></div><div class="sidebar"><a href="/x">Popular posts</a></div></div>""",
        "Baking rye bread\n\nRye holds a lot of water, so the dough stays wet, and it needs a tin. A starter that was fed the evening before works best, in my kitchen at least.\n\n500 g of rye flour\n\n400 g of water, warm\n\na spoon of salt\n\nBake it for an hour, and let it rest for a day before you cut it \u2013 it is worth the wait.",
    ),
]


def test_written_pages():
    """Pages written by hand, of another make than the training pages."""
    model = H.fitted()
    for page, want in PAGES:
        nodes = H.parse(page)
        assert H.blocks(nodes, H.decode(nodes, model.log_odds(H.features(nodes)))) == want


def test_deep_and_wide_pages_take_linear_time():
    import time

    def took(page):
        began = time.process_time()
        nodes = H.parse(page)
        H.decode(nodes, H.features(nodes)[:, 0].astype(float))
        return time.process_time() - began

    for make in (lambda n: "<ul>" + "<li>x" * n, lambda n: "<div>" * n + "x", lambda n: "<b>" * n + "<hr></q>" * n, lambda n: "<p>a<hr>" * n):
        took(make(500))
        assert took(make(16_000)) < 40 * max(took(make(2_000)), 0.005)


def article(html):
    """The article of the driver's pages by their markup alone."""
    inner = re.search(r"<article>(.*?)(</article>|<footer|$)", html, re.S)[1]
    import html as h

    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p))).strip() for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_driver_pages(spark):
    d = "/root/testdata/sf0.001"
    pages = {p.page_id: p.html for p in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = H.op7_html_extract(spark, d).collect()
    assert len(got) == len(pages)
    wrong = [r.page_id for r in got if r.text != article(pages[r.page_id])]
    assert len(wrong) <= len(pages) // 50, wrong


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "<p>"), (5, "<script>var t='</p>'</script>"), (6, "<article><h1>A &amp; B</h1><p>one\n two &eacute;</p><p>" + "word, and. " * 30000 + "</p></article>"), (6, "<![bad <p>x"), (7, "<div>" * 3000)]
    docs = spark.createDataFrame(rows, "page_id long, html string").withColumn("n_chars", H_lit())
    got = H.extract(docs).collect()
    assert len(got) == len(rows)
    assert all(r.text == "" for r in got if r.page_id in (1, 2, 3, 4, 5))
    big = next(r for r in got if r.page_id == 6 and len(r.html) > 100)
    assert big.text.startswith("A & B\n\none two é\n\nword, and.") and big.n_chars == len(big.text)
    assert H.extract(docs.limit(0)).count() == 0


def H_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_rest_of_the_page_is_read():
    """Open heads, forms, selects and buttons and unknown declarations do not swallow what follows."""

    def words(html):
        return " ".join("".join(x.parts) for x in H.parse(html) if x.tag == "#text").split()

    article = "<article><p>one two</p></article>"
    for page in (
        f"<html><head><title>t <b>u</b></title><meta charset=x><body>{article}",
        f"<head><title>t</title><script>s</script>{article}",
        f"<head><link href=x><noscript><img src=y></noscript>{article}",
        *(f"<body><div><{x}><div>in</div><p>in</div>{article}" for x in ("form", "select", "button")),
        f"<div><form><div>in</div><svg><path/><g/></svg>in</form></div>{article}",
        f"<template><div>in</div></div></template>{article}",
        f"<![bad x]>{article}",
        f"<head><title>t</title></head><body><![if !IE]>{article}<![endif]>",
    ):
        assert words(page) == ["one", "two"], page
    assert words("<div>a <![bad>b</div><p>c</p>") == ["a", "b", "c"]
