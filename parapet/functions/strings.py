"""Name, distance and lexical functions as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Look-alike characters and what they stand for.
HOMOGLYPHS = ("0O1I53@$", "oollseas")


@F.pandas_udf(T.StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """NFKC, which the engine's own functions lack."""
    return names.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def normalise(name: Column) -> Column:
    """NFKC, lower case, trimmed. Pure ASCII needs no NFKC, so that only other names go through the vectorised UDF."""
    other = F.when(name.rlike(r"[^\x00-\x7F]"), name)
    return F.lower(F.trim(F.coalesce(nfkc(other), name)))


def strip_scope(name: Column) -> Column:
    """@scope/name to name."""
    return F.regexp_replace(name, "^@[^/]*/", "")


def scope_of(name: Column) -> Column:
    """@scope of a scoped name, else null."""
    found = F.regexp_extract(name, "^(@[^/]*)/", 1)
    return F.when(found != "", found)


def unmask(name: Column) -> Column:
    """Homoglyphs as what they look like."""
    return F.translate(name, *HOMOGLYPHS)


def within(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance of at most `most`, by code points."""
    return F.levenshtein(a, b, most) >= 0


def swapped(a: Column, b: Column) -> Column:
    """Whether one swap of neighbours makes a into b."""
    swaps = F.transform(
        F.sequence(F.lit(1), F.length(a) - 1),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))),
    )
    return (F.length(a) >= 2) & (F.length(a) == F.length(b)) & F.coalesce(F.array_contains(F.when(F.length(a) >= 2, swaps), b), F.lit(False))


def osa_within_two(a: Column, b: Column) -> Column:
    """Optimal string alignment distance of names whose Levenshtein distance is at most 2; null otherwise."""
    d = F.levenshtein(a, b, 2)
    return F.when(d >= 0, F.when((d == 2) & swapped(a, b), F.lit(1)).otherwise(d))


def osa(a: str, b: str) -> str:
    """SQL of the optimal string alignment distance of two columns, by the three-row recurrence."""
    row = f"""aggregate(sequence(1, length({b})), array(i), (r, j) -> concat(r, array(least(
        r[j - 1] + 1, s.p[j] + 1, s.p[j - 1] + if(substr({a}, i, 1) = substr({b}, j, 1), 0, 1),
        if(i > 1 AND j > 1 AND substr({a}, i, 1) = substr({b}, j - 1, 1) AND substr({a}, i - 1, 1) = substr({b}, j, 1), s.q[greatest(j - 2, 0)] + 1, 1000000)))))"""
    return f"""CASE WHEN length({a}) = 0 THEN length({b}) WHEN length({b}) = 0 THEN length({a}) ELSE
      aggregate(sequence(1, length({a})), named_struct('q', sequence(0, length({b})), 'p', sequence(0, length({b}))),
        (s, i) -> named_struct('q', s.p, 'p', {row}), s -> s.p[length({b})]) END"""


def deletions(s: Column, depth: int = 2) -> Column:
    """s and all strings left by deleting up to `depth` of its characters, without repeats."""

    def one(x: Column) -> Column:
        return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))

    out, level = F.array(s), F.array(s)
    for _ in range(depth):
        level = F.array_distinct(F.flatten(F.transform(level, one)))
        out = F.concat(out, level)
    return F.array_distinct(out)


_QUOTED = r"'(?:[^'\\\n]++|\\[\s\S])*+\\?'?|\"(?:[^\"\\\n]++|\\[\s\S])*+\\?\"?|`(?:[^`\\]++|\\[\s\S])*+\\?`?"
#: Runs without comments, or comments; strings and templates keep theirs (quotes end at a line's end).
_COMMENTED = rf"(?:[^'\"`/]++|{_QUOTED}|/(?![/*]))++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"
#: Runs without strings, or strings.
_STRINGS = rf"[^'\"`]++|{_QUOTED}"


def _bytewise(s: Column) -> Column:
    """s with as many ASCII characters for each other one as it has bytes."""
    for wide, n in ((r"[\x{10000}-\x{10FFFF}]", 4), (r"[\x{800}-\x{FFFF}]", 3), (r"[\x{80}-\x{7FF}]", 2)):
        s = F.regexp_replace(s, wide, "x" * n)
    return s


def _blank(s: Column) -> Column:
    """A space for each byte, but line ends as they are."""
    return F.regexp_replace(_bytewise(s), r"[^\n]", " ")


def _spaced_string(s: Column) -> Column:
    """A string's quotes, and a space for each byte between them; an escape is two, whatever it escapes."""
    plain = F.regexp_replace(_bytewise(s), r"\\[\s\S]", "  ")
    quote = F.substring(plain, 1, 1)
    closed = (F.length(plain) > 1) & plain.endswith(quote)
    body = F.substring(plain, F.lit(2), F.length(plain) - 1 - closed.cast("int"))
    return F.concat(quote, F.regexp_replace(body, r"[^\n]", " "), F.when(closed, quote).otherwise(F.lit("")))


def strip_comments(source: Column) -> Column:
    """JavaScript source with comments as spaces, one for each byte, so that offsets and lines stay."""
    of_comment = lambda t: t.startswith("//") | t.startswith("/*")
    return F.array_join(F.transform(F.regexp_extract_all(source, F.lit(_COMMENTED), F.lit(0)), lambda t: F.when(of_comment(t), _blank(t)).otherwise(t)), "")


def blank_strings(stripped: Column) -> Column:
    """On top of strip_comments, strings with spaces, one for each byte, as their contents."""
    return F.array_join(F.transform(F.regexp_extract_all(stripped, F.lit(_STRINGS), F.lit(0)), lambda t: F.when(t.rlike("^['\"`]"), _spaced_string(t)).otherwise(t)), "")


def entropy(s: Column) -> Column:
    """C11: Shannon entropy in bits over code points; the sum is taken in order of the characters."""
    n = F.length(s).cast("double")
    letters = F.split(s, "")
    shares = F.transform(F.array_sort(F.array_distinct(letters)), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return F.when(F.length(s) > 0, F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(F.lit(0.0))


def is_base64(s: Column, least: int) -> Column:
    """Long enough without its padding, and decodable once padded again (line ends do not count)."""
    bare = F.regexp_replace(s, "=+$", "")
    plain = F.regexp_replace(bare, "[\r\n]", "")
    return (F.length(bare) >= least) & bare.rlike("^[A-Za-z0-9+/\r\n]*$") & (F.length(plain) % 4 != 1)
