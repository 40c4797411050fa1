"""Wrapper induction on pages of known layout: with telling names, and without any."""

import collections
import random

from tideframe.llm.html_wrapper import OFTEN, PRIOR, SHARE, Aligned, blocks, choose, content, cut, dumps, loads, match, merge, parse, skeleton, text_hash

RNG = random.Random(1)


def _sentence(n):
    return " ".join(RNG.choices([f"word{i}" for i in range(500)], k=n)).capitalize() + "."


def _page(named):
    body = [_sentence(RNG.randint(20, 60)) for _ in range(RNG.randint(3, 7))]
    title = _sentence(8)
    text = [f"<p>{b}</p>" for b in body]
    if not named:
        html = "<div><p>Welcome to our site</p><p>Call us today</p></div><div><div><h2>" + title + "</h2>" + "".join(text) + "</div></div><div><p>Powered by engine</p><p>Terms apply</p></div>"
        return f"<html><body>{html}</body></html>", [title, *body]
    menu = '<ul class="menu">' + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News")) + "</ul>"
    side = '<div id="sidebar"><ul>' + "".join(f"<li>{_sentence(6)}</li>" for _ in range(5)) + "</ul></div>"
    comments = '<section class="comments">' + "".join(f'<div class="comment"><p>{_sentence(25)}</p></div>' for _ in range(3)) + "</section>"
    ad = f'<div class="promo"><p>{_sentence(12)}</p></div>'
    html = f'<div class="cookie-notice">We use cookies <button>OK</button></div><div id="header"><h1>Site</h1>{menu}</div><div class="wrap"><div class="post"><h1>{title}</h1>'
    html += "".join(text[:2]) + ad + "".join(text[2:]) + f'<p class="share"><a href="#">Tweet</a></p></div>{side}</div>{comments}<div class="footer"><p>All rights reserved</p></div><script>if(a<b){{}}</script>'
    return f"<html><head><title>{title}</title></head><body>{html}</body></html>", [title, *body]


def _induce(pages):
    """The template, marks, and template texts by place, anywhere and at constant places, of one host's pages."""
    template = None
    for html in pages:
        s = skeleton(parse(html))
        template = s if template is None else merge(template, s)
    texts, rows = collections.defaultdict(set), collections.defaultdict(collections.Counter)
    for html in pages:
        aligned = Aligned(html, template)
        for place, text, _ in aligned.slots():
            texts[place, text].add(aligned.signature())
        for place, several in aligned.containers.items():
            rows[place]["several" if several else "single"] += 1
    for (place, text), seen in texts.items():
        rows[place].update(n=len(seen), distinct=1, chars=len(seen) * len(text))
    n = len({Aligned(p, template).signature() for p in pages})
    stats = [(p, r["n"], r["distinct"], r["chars"], r["n"], r["distinct"], r["several"], r["single"]) for p, r in rows.items()]
    often = {text_hash(t, p) for (p, t), seen in texts.items() if len(seen) > 2 and len(seen) - 1 >= OFTEN * (n + PRIOR)}
    repeated = {text_hash(t, p) for (p, t), seen in texts.items() if len(seen) > 1 and len(seen) >= SHARE * rows[p]["n"]}
    return template, choose(sorted(stats), n), often, repeated


def test_layouts():
    for named in (True, False):
        pages = [_page(named) for _ in range(40)]
        found = _induce([p[0] for p in pages])
        for html, expected in pages:
            assert content(html, *found) == expected


def _site(seed, comments=0, side=False, containers=True):
    """Pages without main, article or any class: constant boilerplate, a body, a side column, comments."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choices([f"w{seed}x{i}" for i in range(400)], k=n))
    made = []
    for _ in range(50):
        title, lead = say(6), say(14)
        body = [say(rng.randint(30, 60)) for _ in range(rng.randint(3, 8))]
        out = f"<div><p>Host {seed} welcomes you</p></div>"
        if side:
            out += "<ul>" + "".join(f"<li><p>{say(4)}</p></li>" for _ in range(6)) + "</ul>"
        inner = "".join(f"<p>{b}</p>" for b in body)
        out += f"<section><h1>{title}</h1><p>{lead}</p><p>Share this page</p>" + (f"<div>{inner}</div>" if containers else inner) + "</section>"
        if comments:
            out += "<section><h3>What readers say</h3><ol>" + "".join(f"<li><h4>{say(2)}</h4><p>{say(rng.randint(20, 90))}</p></li>" for _ in range(rng.randint(0, comments))) + "</ol></section>"
        out += "<div><p>Terms apply</p></div>"
        made.append((f"<html><body>{out}</body></html>", [title, lead, *body]))
    return made


def test_plain_sites():
    """Neither names nor standard elements tell: constants of one host alone, comments longer than the body, side columns."""
    for seed, how in enumerate(({}, {"comments": 12}, {"side": True}, {"comments": 4, "side": True, "containers": False})):
        made = _site(seed, **how)
        found = _induce([html for html, _ in made])
        for html, expected in made:
            assert content(html, *found) == expected, how


def test_deep_and_wide():
    deep = "<div>" * 5000 + "<p>bottom</p>" + "</div>" * 5000 + "<p>after</p>"
    s = skeleton(parse(deep))
    assert [t for _, t, _ in blocks(deep, loads(dumps(cut(s))))] == ["bottom", "after"]
    wide = ["".join(f"<p>{k} {x}</p><section><h2>{x}</h2></section>" for k in range(n)) for n, x in ((5000, "a"), (4990, "b"))]
    template = merge(*(cut(skeleton(parse(x))) for x in wide))
    out = [t for _, t, _ in blocks(wide[1], template)]
    assert len(out) == 2 * 4990 and out[:2] == ["0 b", "b"]
    odd = ["".join(f"<{('p', 'ul', 'pre')[rng.randrange(3)]}>x</{'p'}>" for _ in range(5000)) for rng in (random.Random(k) for k in range(2))]
    merge(*(skeleton(parse(x)) for x in odd))


def test_tree_matching():
    a, b = loads("html(body(div(p),ul(li),p))"), loads("html(body(h1,div(p,ul),p))")
    assert dumps(a) == "html(body(div(p),ul(li),p))" and match(a, b)[0] == 5
    assert dumps(merge(a, b)) == "html(body(h1,div(p,ul),ul(li),p))"


def test_markup():
    html = "<p>a &lt;b&gt; &amp;amp; &eacute;&#233;&nbsp; x<!-- c --><br>y<b>z</b><li>q"
    assert [t for _, t, _ in blocks(html, skeleton(parse(html)))] == ["a <b> &amp; éé x yz", "q"]


ROOTS = ("article", "main", "div")


def _around(root, inner):
    return f"<html><body><div><p>Welcome to our site</p></div><{root}>{inner}</{root}><div><p>Powered by engine</p><p>Terms apply</p></div></body></html>"


def _right(made):
    found = _induce([html for html, _ in made])
    return sum(content(html, *found) == expected for html, expected in made)


def test_repeated_headings_stay():
    for root in ROOTS:
        made = []
        for _ in range(40):
            parts = [(h, [_sentence(RNG.randint(20, 50)) for _ in range(RNG.randint(1, 3))]) for h in ("Introduction", "Methods", "Results")]
            title = _sentence(7)
            inner = f"<h1>{title}</h1>" + "".join(f"<h2>{h}</h2>" + "".join(f"<p>{b}</p>" for b in body) for h, body in parts)
            made.append((_around(root, inner), [title, *(x for h, body in parts for x in (h, *body))]))
        assert _right(made) == 40, root


def test_repeated_cells_stay():
    for root in ROOTS:
        made = []
        for _ in range(40):
            title, body = _sentence(7), [_sentence(40) for _ in range(3)]
            cells = [RNG.choice(("yes", "no", "n/a")) for _ in range(6)]
            table = "<table>" + "".join(f"<tr><th>Feature {k}</th><td>{c}</td></tr>" for k, c in enumerate(cells)) + "</table>"
            made.append((_around(root, f"<h1>{title}</h1><p>{body[0]}</p>{table}<p>{body[1]}</p><p>{body[2]}</p>"), [title, body[0], *(x for k, c in enumerate(cells) for x in (f"Feature {k}", c)), *body[1:]]))
        assert _right(made) == 40, root


def test_quotations_and_sentences_stay():
    """A quotation most pages share and some have of their own; a closing sentence that two thirds share."""
    usual, close = _sentence(15), _sentence(12)
    for root in ROOTS:
        made, unique = [], []
        for k in range(60):
            title, body = _sentence(7), [_sentence(40) for _ in range(3)]
            quote = usual if k % 5 else _sentence(15)
            last = close if k % 3 else _sentence(12)
            unique += [(k, x) for x in (quote, last) if x not in (usual, close)]
            made.append((_around(root, f"<h1>{title}</h1><p>{body[0]}</p><blockquote>{quote}</blockquote><p>{body[1]}</p><p>{body[2]}</p><div>{last}</div>"), [title, body[0], quote, *body[1:], last]))
        found = _induce([html for html, _ in made])
        out = [content(html, *found) for html, _ in made]
        assert all(text in out[k] for k, text in unique)  # what stands once is content everywhere
        assert not any(x in text for text in out for x in ("Welcome to our site", "Powered by engine", "Terms apply"))
        if root != "div":
            assert out == [expected for _, expected in made]


def test_share_rows_and_links_go():
    """Links that repeat inside the article are no part of it; a text is template at its own place alone."""
    made = []
    for k in range(40):
        title, body = _sentence(7), [_sentence(40) for _ in range(3)]
        own = "Powered by engine" if k == 7 else _sentence(5)
        inner = f'<h1>{title}</h1><p><a href="/s">Share on a network</a></p><p>{body[0]}</p><p>{own}</p><p>{body[1]}</p><p>{body[2]}</p>'
        made.append((_around("article", inner), [title, body[0], own, *body[1:]]))
    assert _right(made) == 40
