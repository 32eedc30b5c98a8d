"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from parapet.queries import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf, same_rows, name):
    same_rows(registry.queries()[name](spark, sf), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def _alignment(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_every_word_is_a_probe(spark, tmp_path):
    """Rare and frequent words, short and long ones, against a comparison of all pairs."""
    often = {"lodash": 200, "express": 250, "abcdefghijklmnop": 300, "reacts": 200}
    counts = {"ldoash": 1, "lodas": 4, "lodahss": 7, "expres": 50, "expressoo": 199, "exp": 3, "the": 500, "cat": 201, "abcdefghijklmnopqr": 2, "bacdefghijklmnop": 12, "abcdefghijklmnopqrs": 1, "react": 150, "unlike": 1, "loda": 9, "x" * 3000: 1} | often
    text = [" ".join([w] * n) for w, n in counts.items()]
    spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for w in counts.keys() - often.keys():
        near = [(_alignment(w, p), p) for p in often if abs(len(w) - len(p)) <= 2 and _edits(w, p) <= 2]
        if near:
            want[w] = min(near)
    got = {r.bare: (r.d, r.matched) for r in registry.queries()["t7_edit_distance"](spark, str(tmp_path)).collect()}
    assert got == want and {"ldoash", "lodas", "lodahss", "expres", "expressoo", "abcdefghijklmnopqr", "react"} <= set(got)
    close = sum(any(_edits(w, p) <= 1 for p in often) for w in counts.keys() - often.keys())
    assert registry.queries()["t8_neighbour_pairs"](spark, str(tmp_path)).first().n == close


def test_scans_read_whole_texts(spark, tmp_path):
    prose = "plain words of a long text " * 400
    packed = "'" + "aZ3kQ9xP7mL2vB8nR5tY1wE6uI4oS0dF" + "'"
    rows = [(2, prose + packed), (12, prose), (13, prose + "eval(late)"), (23, prose + "it ends")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    of = registry.queries()
    assert {r.pkg_id for r in of["c18_has_sinks"](spark, str(tmp_path)).collect()} == {"2", "12", "13"}
    got = {(r.pkg_id, r.rule) for r in of["c16_sink_collapse_documents"](spark, str(tmp_path)).collect()}
    assert got == {("2", "sink_with_obfuscation"), ("12", "sink_eval"), ("13", "sink_eval")}
