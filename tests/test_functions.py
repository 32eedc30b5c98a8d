import hashlib
import hmac
import random
import re

from pyspark.sql import functions as F

from parapet.functions import hashes, semver, strings


def alignment(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_alignment_distance(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 6)))
    pairs = [(word(), word()) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.expr(strings.osa("a", "b")).alias("d"), strings.osa_within_two(F.col("a"), F.col("b")).alias("near"), F.levenshtein("a", "b").alias("l")).collect()
    for r in rows:
        assert r.d == alignment(r.a, r.b)
        if r.l <= 2:
            assert r.near == r.d


def test_deletions_meet_within_distance(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    rows = {r.w: set(r.left) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", strings.deletions(F.col("w")).alias("left")).collect()}
    near = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").filter(F.levenshtein("a", "b", 2) >= 0).collect()
    assert all(rows[r.a] & rows[r.b] for r in near)


def string_end(raw, i):
    """Where the string that begins at i ends, and whether its quote closes it."""
    j = i + 1
    while j < len(raw):
        if raw[j] == 0x5C and j + 1 < len(raw):
            j += 2
        elif raw[j] == raw[i]:
            return j + 1, True
        elif raw[j] == 0x0A and raw[i] != 0x60:
            return j, False
        else:
            j += 1
    return len(raw), False


def spaces(raw):
    return bytes(0x0A if c == 0x0A else 0x20 for c in raw)


def scan(src, blank):
    """The lexer by hand, over bytes: comments as spaces or, with blank, what strings hold."""
    raw, out, i = src.encode(), b"", 0
    while i < len(raw):
        two = raw[i : i + 2]
        if raw[i] in b"'\"`":
            end, closed = string_end(raw, i)
            if blank:
                inner, k, held = raw[i + 1 : end - closed], 0, b""
                while k < len(inner):
                    step = 2 if inner[k] == 0x5C and k + 1 < len(inner) else 1
                    held += b"  " if step == 2 else spaces(inner[k : k + 1])
                    k += step
                out += raw[i : i + 1] + held + (raw[i : i + 1] if closed else b"")
            else:
                out += raw[i:end]
            i = end
        elif not blank and two == b"//":
            end = raw.find(b"\n", i)
            end = len(raw) if end < 0 else end
            out += spaces(raw[i:end])
            i = end
        elif not blank and two == b"/*":
            end = raw.find(b"*/", i + 2)
            end = len(raw) if end < 0 else end + 2
            out += spaces(raw[i:end])
            i = end
        else:
            out += raw[i : i + 1]
            i += 1
    return out.decode()


def test_lexer_against_scanner(spark):
    rng = random.Random(3)
    sources = ["".join(rng.choice("a'\"`\\\n/* é€😀") for _ in range(rng.randint(0, 24))) for _ in range(2500)]
    rows = spark.createDataFrame([(s,) for s in sources], "src string").withColumn("code", strings.strip_comments(F.col("src"))).withColumn("calls", strings.blank_strings(F.col("code"))).collect()
    for r in rows:
        assert r.code == scan(r.src, False), r.src
        assert r.calls == scan(r.code, True), r.src


def test_lexer_on_long_input(spark):
    src = "x = 'a'; // c\n" * 100_000
    got = spark.createDataFrame([(src,)], "src string").select(F.length(strings.strip_comments(F.col("src"))).alias("n")).first().n
    assert got == len(src)


def test_hmac_and_integrity(spark):
    for secret in ("k", "k" * 100):
        got = spark.range(1).select(hashes.hmac_sha256(F.lit("grüße"), secret).alias("h")).first().h
        assert got == hmac.new(secret.encode(), "grüße".encode(), hashlib.sha256).hexdigest()


def test_versions(spark):
    order = ["0.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "v1.0.1", "1.10.0"]
    rows = spark.createDataFrame([(v,) for v in reversed(order)], "v string").orderBy(semver.key(F.col("v"))).collect()
    assert [r.v for r in rows] == order
    assert spark.createDataFrame([("",), ("a.b",), ("1.2.3.4",)], "v string").filter(semver.key(F.col("v")).isNotNull()).count() == 0
