"""Extraction of main text: pages that names mislead about, broken markup, and a version over the tree of a page."""

import html
import random
import time

import pytest

from parapet.llm import html_text
from parapet.llm.html_text import BESIDE, FRAME, SLIGHT, UNKNOWN, WORD, Weights

ART = " ".join(f"word{i}" for i in range(60))
A, B = "a " * 29 + "a", "b " * 29 + "b"

CASES = {
    "class long-form": (f'<body><nav>menu</nav><div class="long-form"><h1>T</h1><p>{ART}</p></div></body>', f"T\n{ART}"),
    "layout class around all": (f'<body><div class="layout-right-sidebar"><div><p>{ART}</p></div></div><footer>x</footer></body>', ART),
    "id around the article": (f'<body><div id="search-engine-history"><article><p>{ART}</p></article></div></body>', ART),
    "page in a form": (f'<body><form id="aspnetForm"><nav>a b</nav><h1>T</h1><p>{ART}</p><input name=x><button>go</button></form></body>', f"T\n{ART}"),
    "form beside the article": (f"<body><article><p>{ART}</p></article><form><p>your name</p><input></form></body>", ART),
    "stray quote": (f'<article><p>one <a href="x"">link</a> {ART}</p></article>', f"one link {ART}"),
    "apostrophe in a value": (f"<article><p>one <a title=don't>link</a> {ART}</p></article>", f"one link {ART}"),
    "quote never closed": (f'<article><p>one <a href="x>link</a> {ART}</p></article>', f"one link {ART}"),
    "greater sign in a value": (f'<article><p>one <a title="a > b">link</a> {ART}</p></article>', f"one link {ART}"),
    "two articles": (f"<article><p>{A}</p></article><p>{'gap ' * 40}</p><article><p>{B}</p></article>", f"{A}\n{B}"),
    "a main element with next to nothing": (f'<main><p>Read more</p></main><div class="story"><p>{ART}</p></div>', f"Read more\n{ART}"),
    "comments as responses": (f'<article><p>{ART}</p></article><div class="post-responses"><p>nice {ART}</p></div>', ART),
    "sidebar larger than the text": (f'<div class="content"><h1>T</h1><p>short text here</p></div><div class="sidebar"><p>{ART}</p></div>', "T\nshort text here"),
    "comments larger than the text": (f'<div><h1>T</h1><p>short text here</p></div><div class="comments"><p>{ART}</p><article class="comment">{ART}</article></div>', "T\nshort text here"),
    "article open to comments": (f'<article class="post comments-open"><p>{ART}</p><section id="comments"><article class="comment">no</article></section></article>', ART),
    "advert in the article": (f'<article><p>{ART}</p><div class="ad">buy</div><p>{ART}</p></article>', f"{ART}\n{ART}"),
    "navigation never closed": (f"<nav><ul><li>x<article><p>{ART}</p></article>", ART),
    "tag at the end": (f"<p>{ART}</p><a href=", ART),
    "references": ("<article><p>a &amp;&lt;b&gt; &#233;&nbsp;&eacute; c&copy</p></article>", "a &<b> é é c©"),
    "hidden element": (f'<div><p>{ART}</p><div style="display: none">no</div><div hidden>no</div></div>', ART),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    source, want = CASES[name]
    assert html_text.extract(source, Weights()) == want


def test_names_are_evidence():
    """A name that labelled pages have beside their articles only counts against words; one that they have around all does not."""
    pages = [f'<body><div class="wrap"><article><p>{ART}</p></article><div class="zzpromobox"><p>buy this {i}</p></div></div></body>' for i in range(60)]
    w = html_text.weigh(pages)
    assert w.names["zzpromobox"] < -2000 and w.names.get("wrap", 0) > -200
    unmarked = f'<body><div class="wrap"><div><p>{ART}</p></div><div class="zzpromobox"><p>{"buy this now " * 40}</p></div></div></body>'
    assert html_text.extract(unmarked, w) == ART


def test_time_in_proportion():
    deep = "".join(f'<div class="sidebar n{i}">' for i in range(20_000)) + ART
    quotes = '<a href="x>' * 20_000 + ART
    for source in (deep, quotes, "<" * 200_000, "<a " * 50_000, "<!--" * 50_000, "<script>" * 20_000):
        began = time.time()
        html_text.extract(source, Weights())
        assert time.time() - began < 10


def tree(rng, depth=0):
    """A random well-formed element: (tag, attributes, children), or a text."""
    if depth > 3 or rng.random() < 0.35:
        return " ".join(rng.choice(["one", "two", "x&amp;y", "&eacute;", "four"]) for _ in range(rng.randint(1, 12)))
    tag = rng.choice(["div", "div", "p", "section", "ul", "li", "b", "a", "h1", "nav", "footer", "form", "script"])
    names = rng.choice(["", "", "", "sidebar", "comments", "ad-box", "story", "post"]) if tag in ("div", "section", "ul") else ""
    return tag, names, children(rng, depth + 1) if tag != "h1" else [tree(rng, 9)]


def children(rng, depth=0):
    """Random elements and texts, no two texts side by side."""
    out = []
    for _ in range(rng.randint(1, 5)):
        one = tree(rng, depth)
        if not (out and isinstance(one, str) and isinstance(out[-1], str)):
            out.append(one)
    return out


def written(node):
    if isinstance(node, str):
        return node
    tag, names, children = node
    return f"<{tag}{f' class={names}' if names else ''}>" + ("".join(map(written, children)) if tag != "script" else "x < y") + f"</{tag}>"


def count(node, heading=None):
    """Words of a tree that are not in elements that are never text; with heading: those in h1 elements."""
    if isinstance(node, str):
        return len(node.split()) if heading is not False else 0
    if node[0] in ("nav", "footer", "script"):
        return 0
    return sum(count(c, heading if heading is None else heading or node[0] == "h1") for c in node[2])


def suspects(node):
    """The outermost elements of a tree that names speak against."""
    if isinstance(node, str) or node[0] in ("nav", "footer", "script"):
        return []
    if node[0] == "form" or node[1] in ("sidebar", "comments", "ad-box"):
        return [node]
    return [s for c in node[2] for s in suspects(c)]


def plain(root):
    """The main text by the tree: frames found by counting subtrees anew, the region by all pairs of ends."""
    out = set()

    def decide(whole, inner):
        own = [count(s) for s in inner]
        for s, n in zip(inner, own):
            elsewhere = count(whole, False) - count(s, False)
            frame = 2 * n > sum(own) and FRAME * (count(whole) - sum(own)) < n and not elsewhere
            if frame and (s[1] != "comments" or count(s, False)):
                decide(s, [x for c in s[2] for x in suspects(c)])
            else:
                out.add(id(s))

    decide(root, suspects(root))
    items = []

    def walk(node, gone):
        if isinstance(node, str):
            items.append(("", node, gone))
            return
        gone = gone or id(node) in out or node[0] in ("nav", "footer", "script")
        items.append((node[0], "", gone))
        for c in node[2] if node[0] != "script" else ["x < y"]:
            walk(c, gone)
        items.append(("/" + node[0], "", gone))

    walk(root, False)
    value = lambda t, x, gone: (SLIGHT if t else 0) if gone else (SLIGHT if t.lstrip("/") in ("b", "a", "p") else UNKNOWN) if t else WORD * len(x.split())
    values = [value(*i) for i in items]
    best, at = 0, (0, 0)
    for a in range(len(values)):
        total = 0
        for b in range(a, len(values)):
            total += values[b]
            if total > best:
                best, at = total, (a, b + 1)
    blocks = [""]
    for t, x, gone in items[at[0] : at[1]]:
        if t and t.lstrip("/") not in ("b", "a"):
            blocks.append("")
        elif not t and not gone:
            blocks[-1] += html.unescape(x)
    return "\n".join(y for y in (" ".join(b.split()) for b in blocks) if y)


def test_against_the_tree():
    rng = random.Random(11)
    seen = set()
    for _ in range(1500):
        root = ("div", "", children(rng))
        want = plain(root)
        assert html_text.extract(written(root), Weights()) == want, written(root)
        seen.add(want)
    assert len(seen) > 500 and BESIDE > 1


def test_query_is_the_extraction_of_each_page(spark, sf):
    from parapet.llm import registry

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    weights = html_text.weigh([r.html for r in pages.values()])
    for r in registry.queries()["op1_html_text"](spark, sf).collect():
        assert r.text == html_text.extract(pages[r.page_id].html, weights) and r.n_chars == len(r.text)
        assert r.text.startswith(html.unescape(pages[r.page_id].html.split("<h1>")[1].split("</h1>")[0]).strip()[:20])
