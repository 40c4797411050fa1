"""All main text of pages whose article or main has several layers, links or layouts, or whose rows come again."""

import random

from tideframe.llm.html_wrapper import main_text

RNG = random.Random(4)


def _sentence(n=30):
    return " ".join(RNG.choices([f"word{i}" for i in range(500)], k=n))


def _extracted(spark, pages):
    rows = [(k, f"http://a.org/{k}", f"<html><body><nav><ul><li>Home</li></ul></nav>{html}<div><p>Powered by engine</p></div></body></html>") for k, html in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def _check(spark, made):
    out = _extracted(spark, [html for html, _ in made])
    for k, (_, expected) in enumerate(made):
        assert out[k] == "\n\n".join(expected)


def _layered(root):
    title, lead, link, *body = _sentence(6), _sentence(10), _sentence(9), *(_sentence(60) for _ in range(5))
    text = "".join(f"<p>{b}</p>" for b in body)
    return f'<{root}><header><h1>{title}</h1><p class="lead">{lead}</p></header><div class="body">{text}<p><a href="/x">{link}</a></p></div></{root}>', [title, lead, *body, link]


def _flat():
    title, *body = (_sentence() for _ in range(4))
    return f"<div><h2>{title}</h2><section>" + "".join(f"<p>{b}</p>" for b in body) + "</section></div>", [title, *body]


def test_layers_and_layouts(spark):
    for root in ("article", "main"):
        _check(spark, [_layered(root) for _ in range(40)] + [_flat() for _ in range(3)])


def test_repeated_rows(spark):
    pages = [_layered("article") for _ in range(6)]
    _check(spark, pages * 8)


def test_repeated_lines(spark):
    _check(spark, [("<article>" + "<p>so it goes</p>" * 20 + "</article>", ["so it goes"] * 20)])


def test_several_articles(spark):
    made = []
    for _ in range(20):
        story, one, two = (_sentence() for _ in range(3))
        made.append((f"<section><p>{story}</p></section><article><p>{one}</p></article><article><p>{two}</p></article>", [story, one, two]))
    _check(spark, made)


def test_deep_page_and_own_constants(spark):
    """One page of 5,000 nested elements beside others; boilerplate that only this host repeats, in no telling element."""
    made = []
    for _ in range(40):
        title, *body = _sentence(6), *(_sentence(50) for _ in range(4))
        made.append(("<div><p>Brought to you by a sponsor of this host</p></div><section><h1>" + title + "</h1>" + "".join(f"<p>{b}</p>" for b in body) + "</section>", [title, *body]))
    story = _sentence(80)
    made.append(("<div>" * 5000 + f"<p>{story}</p>" + "</div>" * 5000, [story]))
    _check(spark, made)
