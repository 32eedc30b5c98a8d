"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parapet.llm import decontaminate, html_text, language_id, language_model, mixing, near_dup, quality_cnn, quality_rules, toxicity, warc

LONG = "lorem ipsum dolor sit amet " * 30_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "score double, key string, id long, label string, kept boolean, f1 long, part int, train boolean, size long, words int, hit int"
BASE = "The quick brown fox jumps over the lazy dog and then runs far away from all of them again "


def rows():
    copy = BASE * 3
    near = copy + "tail words"
    return [
        (1, copy, "en", "a"),
        (2, copy, "en", "b"),
        (2, copy, "en", "b"),
        (3, near, "en", None),
        (4, None, None, "a"),
        (5, "", "de", "a"),
        (6, " \t\n\x0b\r", None, None),
        (7, "one two", "de", "c"),
        (8, "one two", "de", "c"),
        (9, LONG, "en", "c"),
        (None, "nameless words are here", "en", "a"),
        (None, None, None, None),
        (10, "Übergrößen ändern Straßen für alle Menschen", "de", "é"),
        (11, "123 456 \x00 !!", "en", "a"),
        (12, "a a a a a a a\na a a a a a a\n\nb", "en", "a"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in EXTRA.split(", "):
        name, kind = c.split()
        d = d.withColumn(name, F.lit(None).cast(kind))
    return d


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 13)] + [(None, 1, 1), (3, None, None), (99, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def words(text):
    return WORD.findall(text or "")


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    sizes = Counter((i, len(words(t))) for i, t, _, _ in rows())
    assert Counter((r.doc_id, r["size"]) for r in got) == sizes
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        s = by.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r.taken
    for (size, target), (taken, _) in by.items():
        if size:
            assert abs(taken - target) <= max(1, 0.51 * len([k for k in by if k == (size, target)]) * 2)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0


def test_targets():
    sizes = {"a": 100, "b": 1000, "c": 10, None: 500}
    t = mixing.targets(sizes)
    assert abs(sum(t.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(t[s] <= 2 * sizes[s] + 1e-9 for s in sizes) and t["a"] == 200 and t["c"] == 20
    assert t[None] == 1000 and t["b"] == pytest.approx(1195)
    even = mixing.targets({"a": 300, "b": 100, "c": 200})
    assert even["a"] / 3 == pytest.approx(even["b"]) == pytest.approx(even["c"] / 2)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def counts(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_rules(docs, empty):
    got = quality_rules.judge(docs).collect()
    want = Counter((i, *counts(t)) for i, t, _, _ in rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.kept or not r.base_failed)
    assert quality_rules.judge(empty).count() == 0


@pytest.mark.parametrize("op, column", [(toxicity, "toxic"), (quality_cnn, "quality")])
def test_classifiers(docs, labels, empty, op, column, monkeypatch):
    monkeypatch.setattr(op, "SIZE", 200_000)
    model = op.train(docs, labels)
    got = op.score(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.doc_id == 2}
    assert len(same) == 1 and same == {r.score for r in got if r.doc_id == 1}
    assert op.score(empty, model).count() == 0
    none = op.train(docs, labels.filter("false"))
    assert op.score(docs, none).count() == len(rows())
    one = op.train(docs, labels.filter(f"{column} = 1"))
    assert op.score(docs, one).agg(F.min("score")).first()[0] > 0.5
    kept = op.keep(docs, none)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert op.train(empty, labels) is not None


def test_language(docs, empty):
    got = language_id.label(docs, language_id.train(docs)).collect()
    assert len(got) == len(rows())
    for r in got:
        text = next(t for i, t, _, _ in rows() if i == r.doc_id)
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
        assert r.lang_pred in ("und", "de", "en") and 0 <= r.score <= 1
    assert {r.lang_pred for r in language_id.label(docs, language_id.train(empty)).collect()} == {"und"}
    assert language_id.label(empty, language_id.train(docs)).count() == 0


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(data):
    sets = [(i, shingles(t)) for i, t in data]
    least = {i: i for i, _ in sets if i is not None}
    moved = True
    while moved:
        moved = False
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b) and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    moved = True
    return least


def test_near_duplicates(docs, empty):
    got = near_dup.classes(docs).collect()
    least = classes([(i, t) for i, t, _, _ in rows()])
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t))) for i, t, _, _ in rows())
    for r in got:
        assert r.component_id == (None if r.doc_id is None else least[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert near_dup.classes(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = [(1, "jumps over the lazy dog and then runs far away from"), (2, "one two"), (2, "one two"), (3, None), (4, " ,"), (None, "456"), (5, "ÜBERGRÖSSEN")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    got = decontaminate.report(docs, bench).collect()
    for r in got:
        if r.doc_id is None:
            continue
        w = lower(next(t for i, t, _, _ in rows() if i == r.doc_id))
        hit, names = set(), set()
        for i, t in items:
            x = lower(t)
            k = min(10, len(x))
            for a in range(len(x) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[a : a + k]:
                        hit |= set(range(p, p + k))
                        if i is not None:
                            names.add(str(i))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, bench.filter("false")).filter("contaminated").count() == 0
    clean = decontaminate.cut(docs, bench)
    assert clean.schema == docs.schema
    assert decontaminate.report(clean, bench).filter("contaminated").count() == 0
    left = {r.doc_id: r for r in clean.collect()}
    assert 7 not in left and left[9].text == LONG and left[1].n_chars == len(left[1].text) and left[4].text is None


def test_language_model(docs, empty):
    got = language_model.score(docs).collect()
    lower = lambda t: words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    learned = [lower(t) for i, t, _, _ in rows() if i is not None and not held(i)]
    seen = Counter(x for w in learned for x in w)
    total = sum(seen.values()) + len(learned)
    want = Counter((i, len(lower(t)) + 1, sum(x in seen for x in lower(t)) + 1, total) for i, t, _, _ in rows())
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    import math

    for r in got:
        assert r.score < 0
        if r.doc_id == 7:
            base = [(seen[x] + 1) / (total + len(seen) + 2) for x in ("one", "two")] + [(len(learned) + 1) / (total + len(seen) + 2)]
            assert r.base_score == pytest.approx(sum(map(math.log10, base)))
    assert language_model.score(empty).count() == 0
    only_held = language_model.score(docs.filter("doc_id IS NULL")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in only_held)


PAGES = [
    (1, "http://a", "<html><body><article><h1>T &amp; x</h1><p>one  two<br>three</article><footer>f</footer>"),
    (2, "http://b\r\nX: y", "<html><body><article><h1>T &amp; x</h1><p>one  two<br>three</article><footer>f</footer>"),
    (3, None, None),
    (4, "", ""),
    (None, "http://c", "<p>no id"),
    (5, "http://é", "text only"),
    (5, "http://é", "text only"),
    (6, "http://long", "<article><p>" + LONG + "</p></article>"),
    (7, "x", "<div class='comments'>c</div><script>if (a < b) {}</script>"),
    (8, "x", "<nav><a href='/'>home</a></nav><main><p>é &#8212; <b>b</b>c &nbsp; d<div class=ad>buy</div>e</main> <aside>z"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("size", F.lit(1)).withColumn("sha", F.lit("x")).withColumn("text", F.lit("x"))


def test_html(pages):
    got = html_text.texts(pages, html_text.train(pages)).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(PAGES) and all(r.n_chars == len(r.text) for r in got)
    assert by[1] == by[2] == "T & x\none two three" and by[3] == by[4] == by[7] == "" and by[None] == "no id" and by[5] == "text only"
    assert by[6] == LONG.strip() and by[8] == "é — bc d\ne"
    assert html_text.texts(pages.filter("false"), html_text.Weights()).count() == 0
    assert html_text.train(pages.filter("false")) == html_text.Weights()


def test_warc(spark, pages):
    got = warc.read(warc.write(pages)).collect()
    pay = {i: (h or "").encode() for i, _, h in PAGES}
    assert Counter(r.page_id for r in got) == Counter(i for i, _, _ in PAGES)
    for r in got:
        assert r.payload_bytes == len(pay[r.page_id]) and r.payload_digest == base64.b32encode(hashlib.sha1(pay[r.page_id]).digest()).decode()
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[1] == ("revisit", 2) and kinds[2] == ("response", None) and kinds[3] == ("revisit", 4) and kinds[5] == ("response", None) and kinds[None] == ("response", None)
    assert warc.read(warc.write(pages.filter("false"))).count() == 0
    small = {r.page_id: r.record_type for r in warc.read(warc.write(pages, least=10)).collect()}
    assert small[3] == "response" and small[1] == "revisit"
    some = warc.write(pages).filter("page_id IN (2, 6)")
    assert {r.page_id for r in warc.read(some).collect()} == {2, 6}


def test_warc_ranges():
    import numpy as np

    start, size = np.array([0, 10, 100_000, 100_020]), np.array([10, 5, 20, 5])
    assert warc.spans(start, size) == [(0, 2), (2, 4)]
    assert warc.spans(start[:0], size[:0]) == []
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcX")
