"""Operator 1: main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of tags and words. Words score positive and tags negative, by weights from
labelled pages (those whose markup itself sets the article apart), and one linear scan finds the
contiguous region with the largest sum. A word's score falls with what labelled pages tell of the
names (class, id) of the elements around it. The region's text is cut into blocks at block-level tags.

Left out, in the region too, is what is no article text: elements that never are (scripts, menus,
footers, asides, controls ...), and elements whose names, roles or kind say so (sidebars, notices,
adverts, forms, reader comments), unless they are the page's frame: those with an article in them,
and those that hold nearly all words of the page while no heading or article stands elsewhere. Where
a page's own article and main elements hold a fair share of its words, words beside them are left out.

Cases: null, empty or text-free html gives an empty text; unclosed and unknown tags are taken as
they come; quotes open a value only after an equals sign, and one that is never closed opens none; an
element that is left out ends with its end tag, or where an article begins, an article, main or body
ends; of equal sums the first region counts; repeated rows are alike; an empty table gives an empty
result; other columns are ignored. Very long pages take time and memory in proportion.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.shared import mapped, table

#: Labelled pages that the weights are taken from, at most, and their bytes; a longer page is not taken.
LABELLED, LABELLED_BYTES = 400, 16 << 20

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)

RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("script style noscript template textarea title iframe noembed noframes svg canvas object audio video button select option datalist fieldset nav footer aside menu dialog head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTENT = frozenset(("article", "main"))
NEVER = frozenset(("html", "body", "main", "br", "hr", "img"))
#: Parts of class and id names that mark reader comments.
COMMENTS = frozenset("comment comments disqus reply replies respond response responses discussion feedback".split())
#: Parts that mark menus, headers, footers, sidebars, notices, adverts and forms.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations widget widgets toolbar topbar pagination pager masthead copyright disclaimer search form "
    "notification notifications promoted".split()
)
#: Beginnings of such parts, for names written as one word.
MARK_STARTS = ("advert", "sidebar", "cookie", "newsletter", "sponsor", "navbar", "footer")
COMMENT_STARTS = ("commentlist", "commentform", "commentsection")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

#: Scores where no labelled page tells: of a word, of tags that seldom matter, of others; the least that pages tell.
#: Scores are whole thousandths, so that sums are exact.
WORD, SLIGHT, UNKNOWN, STRONGEST = 1000, -20, -300, -4000
#: Name parts of the elements around a word that count, the innermost.
AROUND = 16
#: A page's articles are believed if other words are at most so many times theirs.
BESIDE = 6
#: An element is the page's frame if the words outside it are fewer than one in so many of its own.
FRAME = 3


@dataclass
class Weights:
    """Log-odds of article text, in thousandths: of tags, and of parts of the names of elements around a word."""

    tags: dict[str, int] = field(default_factory=dict)
    names: dict[str, int] = field(default_factory=dict)


def _names(attributes: str) -> list[str]:
    """Class and id names, one after another."""
    return [one for name, *values in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for one in next((v for v in values if v), "").split()]


def _parts(name: str) -> list[str]:
    return [p.lower() for p in NAME_PART.findall(name)]


def _kind(tag: str, attributes: str, within: bool) -> str:
    """What an element's tag and attributes say of it: "comment", "mark", or "" for nothing."""
    if tag in NEVER:
        return ""
    told = "mark" if tag == "form" else ""
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            for one in value.split():
                parts = _parts(one)
                if not parts or parts[0] in ("no", "has", "with", "without"):
                    continue
                if tag == "article":
                    # an article may say that it is open to comments; one that is a comment begins so
                    if parts[0] in COMMENTS and parts[-1] not in ("open", "closed"):
                        return "comment"
                elif COMMENTS.intersection(parts) or any(p.startswith(COMMENT_STARTS) for p in parts):
                    return "comment"
                elif MARKS.intersection(parts) or any(p.startswith(MARK_STARTS) for p in parts) or (not within and "header" in parts):
                    told = "mark"
        elif tag != "article" and ((name == "role" and value.lower() in ROLES) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value))):
            told = "mark"
    return told


@dataclass(eq=False)
class Suspect:
    """An element that its names speak against: items from begin up to end. above: how many such elements it is in."""

    kind: str
    begin: int
    above: int
    end: int = -1
    inner: list = field(default_factory=list)


@dataclass
class Page:
    """Tags and texts of a page in order, and what is known of each."""

    tags: list = field(default_factory=list)  # a name, with / for an end tag; "" for a text
    texts: list = field(default_factory=list)
    words: list = field(default_factory=list)  # how many a text has, 0 in elements that are left out
    within: list = field(default_factory=list)  # in an article or main element
    left_out: list = field(default_factory=list)
    around: list = field(default_factory=list)  # names of the elements around
    trusted: bool = False  # the page's own articles are believed


def _tags(page: str) -> Iterator[re.Match]:
    """Tags, comments and declarations; what stands in raw-text elements is not searched."""
    at = 0
    while m := TAG.search(page, at):
        yield m
        at = m.end()
        tag = (m[2] or "").lower()
        if tag in RAW and not m[1]:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)


def read(source: str) -> Page:
    """The page, with what is left out decided."""
    p = Page()
    outermost: list[Suspect] = []
    open_names: dict[str, list] = {}  # of each tag: what its open elements are
    held: list[Suspect] = []  # open suspects
    names: tuple[str, ...] = ()
    at, within, skip, depth = 0, 0, "", 0

    def item(tag: str, text: str = "") -> None:
        p.tags.append(tag)
        p.texts.append(text)
        p.words.append(0 if tag or skip else len(text.split()))
        p.within.append(within > 0)
        p.left_out.append(bool(skip))
        p.around.append(names)

    def close(above: int) -> None:
        """Ends the open suspects but for the first `above`."""
        while len(held) > above:
            held.pop().end = len(p.tags)

    for m in _tags(source):
        if m.start() > at:
            item("", source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if skip:
            if (tag in CONTENT and not closing) or (closing and tag in ("article", "main", "body", "html")):
                skip = ""
            elif tag == skip and tag not in VOID:
                depth += -1 if closing else 1
                if depth <= 0:
                    item("/" + tag)
                    skip = ""
                    continue
        if skip:
            item("/" + tag if closing else tag)
            continue
        if closing:
            what, before = open_names[tag].pop() if open_names.get(tag) else (None, names)
            if what == "content" or (what is None and tag in CONTENT):
                within = max(0, within - 1)
            names = before
            item("/" + tag)
            if isinstance(what, Suspect) and what.end < 0:  # and those in it that were left open
                close(what.above)
            continue
        if tag not in VOID and (tag in LEFT_OUT or (tag == "header" and not within)):
            skip, depth = tag, 1
            item(tag)
            continue
        kind = _kind(tag, m[3], within > 0)
        in_comment = tag in CONTENT and any(s.kind == "comment" for s in held)
        if tag in CONTENT and not kind and not in_comment:
            close(0)  # an article ends what is left out, but for comments
        item(tag)
        if tag in VOID:
            continue
        what = None
        if kind:
            what = Suspect(kind, len(p.tags) - 1, len(held))
            (held[-1].inner if held else outermost).append(what)
            held.append(what)
        elif tag in CONTENT and not in_comment:
            what = "content"
            within += 1
        open_names.setdefault(tag, []).append((what, names))
        if m[3]:
            own = {q for one in _names(m[3]) for q in _parts(one)}.difference(names)
            names = (names + tuple(sorted(own)))[-AROUND:] if own else names
    if at < len(source):
        item("", source[at:])
    close(0)
    _decide(p, outermost)
    return p


def _decide(p: Page, outermost: list[Suspect]) -> None:
    """Marks the items of suspects as left out, but for frames, in which those inside are looked at; and whether articles are believed."""
    before = np.concatenate([[0], np.cumsum(p.words)]).tolist() if p.words else [0]
    content = np.concatenate([[0], np.cumsum([n if w else 0 for n, w in zip(p.words, p.within)])]).tolist() if p.words else [0]
    headings, inside = [0], False
    for tag, n, out in zip(p.tags, p.words, p.left_out):
        inside = tag == "h1" or (inside and tag != "/h1")
        headings.append(headings[-1] + (n if inside and not out else 0))
    todo = [(0, len(p.tags), outermost)]
    while todo:
        lo, hi, suspects = todo.pop()
        count = lambda s, sums: sums[s.end] - sums[s.begin]
        own = [count(s, before) for s in suspects]
        beside = before[hi] - before[lo] - sum(own)
        for s, n in zip(suspects, own):
            elsewhere = (content[hi] - content[lo] - count(s, content)) + (headings[hi] - headings[lo] - count(s, headings))
            only = 2 * n > sum(own) and FRAME * beside < n and not elsewhere
            if only and (s.kind == "mark" or count(s, headings)):
                todo.append((s.begin, s.end, s.inner))
            else:
                for k in range(s.begin, s.end):
                    p.left_out[k] = True
                    p.words[k] = 0
    own = sum(n for n, w in zip(p.words, p.within) if w)
    p.trusted = 0 < own and sum(p.words) - own <= BESIDE * own
    if p.trusted:
        for k, w in enumerate(p.within):
            if not w:
                p.left_out[k] = True


def weigh(pages: list[str]) -> Weights:
    """Of tags and names, the log-odds that they stand in, or around, article text, by pages that mark their article; never over SLIGHT for tags, 0 for names."""
    tags, names = (Counter(), Counter()), (Counter(), Counter())
    for source in pages:
        p = read(source)
        if not p.trusted:
            continue
        seen: tuple[set, set] = (set(), set())
        for tag, n, w, around in zip(p.tags, p.words, p.within, p.around):
            if tag:
                tags[w][tag.lstrip("/")] += 1
            elif n:
                seen[w].update(around)
        for w in (False, True):
            names[w].update(seen[w])
    odds = lambda x, c, by: max(STRONGEST, round(1000 * math.log((c[True][x] + by) / (c[False][x] + by))))
    return Weights({t: min(SLIGHT, odds(t, tags, 1)) for t in {*tags[0], *tags[1]}}, {x: min(0, odds(x, names, 5)) for x in names[0]})


def scores(p: Page, weights: Weights) -> list[int]:
    """What each item adds to a region's sum."""
    out = []
    for tag, n, left_out, around in zip(p.tags, p.words, p.left_out, p.around):
        if left_out:
            out.append(SLIGHT if tag else 0)  # what is left out anyway does not end an article
        elif tag:
            name = tag.lstrip("/")
            out.append(weights.tags.get(name, SLIGHT if name in INLINE or name == "p" else UNKNOWN))
        else:
            out.append(n * max(-WORD, WORD + sum(weights.names.get(x, 0) for x in around)))
    return out


def region(values: list[int]) -> tuple[int, int]:
    """The contiguous items with the largest sum, by one scan; the first of equals."""
    best, best_at, total, begin = 0, (0, 0), 0, 0
    for k, x in enumerate(values):
        if total < 0:
            total, begin = 0, k
        total += x
        if total > best:
            best, best_at = total, (begin, k + 1)
    return best_at


def extract(source: str | None, weights: Weights) -> str:
    if not source:
        return ""
    p = read(source)
    begin, end = region(scores(p, weights))
    blocks, now = [], []
    for k in range(begin, end):
        tag, text = p.tags[k], p.texts[k]
        if tag:
            name = tag.lstrip("/")
            if name == "br":
                now.append(" ")
            elif name not in INLINE:
                blocks.append(now)
                now = []
        elif not p.left_out[k]:
            now.append(html.unescape(text) if "&" in text else text)
    blocks.append(now)
    lines = (" ".join("".join(b).split()) for b in blocks if b)
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame) -> Weights:
    """Weights from at most LABELLED pages that have an article or main element, the first by hash of their ids, of at most LABELLED_BYTES in all."""
    labelled = pages.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]") & F.col("page_id").isNotNull() & (F.octet_length("html") <= LABELLED_BYTES))
    first = labelled.groupBy("page_id").agg(F.max(F.octet_length("html")).alias("size")).orderBy(F.xxhash64("page_id"), "page_id").limit(LABELLED).collect()
    left, ids = LABELLED_BYTES, []
    for r in first:
        if r["size"] <= left:
            left -= r["size"]
            ids.append(r["page_id"])
    return weigh([r["html"] for r in labelled.filter(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.max("html").alias("html")).collect()] if ids else [])


def texts(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = batch.slice(k, 1000)
                text = [extract(x, weights) for x in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(text, pa.string()), pa.array(np.array([len(t) for t in text], np.int64))], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return mapped(rows, extracted, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return texts(pages, train(pages))
