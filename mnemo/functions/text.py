"""String functions as column expressions. Character classes are explicit ASCII so that every engine agrees."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo import policy


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form: the one step that Spark has no function for."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def ascii_edges(pattern: str) -> str:
    """A pattern whose word boundaries are those of ASCII, as in other engines: here \\b also takes other letters as words."""
    return pattern.replace(r"\b", r"(?:(?<=[a-zA-Z0-9_])(?![a-zA-Z0-9_])|(?<![a-zA-Z0-9_])(?=[a-zA-Z0-9_]))")


def canonicalize(s: Column | str, unicode_form: bool = False) -> Column:
    """Markup signs to spaces, white space collapsed, trimmed, lower case; NFKC first if asked for."""
    s = nfkc(_c(s)) if unicode_form else _c(s)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(s, r"[*#`~\[\]()>|_]", " "), r"[ \t\r\n]+", " ")))


def tokens(s: Column | str, least: int = 1) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores of at least `least` characters, in order."""
    return F.regexp_extract_all(F.lower(_c(s)), F.lit(f"[a-z0-9_]{{{least},}}"), F.lit(0))  # a match is a whole run


def word_set(s: Column | str, least: int = 4) -> Column:
    return F.array_distinct(tokens(s, least))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def trigrams(s: Column | str, first: int = 200) -> Column:
    """Distinct character trigrams of the lower-cased beginning."""
    t = F.lower(F.substring(_c(s), 1, first))
    n = F.length(t) - 2
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(t, i, F.lit(3))))).otherwise(
        F.array().cast("array<string>")
    )


def stem(w: Column) -> Column:
    """The first suffix of the list that leaves three characters is cut, once."""
    out = w
    for suffix in reversed(policy.SUFFIXES):
        out = F.when(w.endswith(suffix) & (F.length(w) - len(suffix) >= 3), F.substring(w, F.lit(1), F.length(w) - len(suffix))).otherwise(out)
    return out


def word_overlap(words: Column, text: Column | str) -> Column:
    """Share of words that the text contains, as they are or by their stem."""
    found = lambda t: F.size(F.filter(words, lambda w: t.contains(w) | t.contains(stem(w))))
    hits = F.get(F.transform(F.array(F.lower(_c(text))), found), F.lit(0))  # lower case is made once a text, not twice a word
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(0.0)


def normalize_for_dedup(s: Column | str) -> Column:
    """Errors without what differs from run to run: ids, paths, quoted strings and numbers."""
    out = F.lower(_c(s))
    for pattern, mark in (
        (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
        (r"(/[a-z0-9_.\-]+)+", "<path>"),
        (r"\"[^\"]*\"|'[^']*'", "<str>"),
        (r"[0-9]+", "<n>"),
        (r"[ \t\r\n]+", " "),
    ):
        out = F.regexp_replace(out, pattern, mark)
    return F.trim(out)


def key_terms(s: Column | str, stop: list[str], most: int = 5) -> Column:
    """The first distinct terms in the first 300 characters that aren't stop words."""
    found = F.regexp_extract_all(F.substring(_c(s), 1, 300), F.lit(r"([a-zA-Z_][a-zA-Z0-9_.\-]{2,})"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(found, F.lower), lambda w: ~w.isin(stop))), 1, most)


def lexical_overlap(query: Column, content: Column) -> Column:
    """Share of the query's words of four letters or more that the content has; 1 for a query without such."""
    q = word_set(query, 4)
    return F.when(F.size(q) == 0, 1.0).otherwise(F.size(F.array_intersect(q, word_set(content, 4))) / F.size(q))


def estimate_tokens(s: Column | str) -> Column:
    return F.floor(F.length(_c(s)) / 4).cast("long")


def snippet(s: Column | str, most: int) -> Column:
    t = F.trim(F.regexp_replace(_c(s), r"[ \t\r\n]+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def natural_tokens(name: Column | str) -> Column:
    """Words of an identifier or file name: its extension goes, camel case and separators become spaces."""
    t = F.regexp_replace(_c(name), r"\.[A-Za-z0-9]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-./]+", " ")
    return F.lower(F.trim(t))


def fts_words(s: Column | str) -> Column:
    """Words that full-text search takes: three characters or more, no operators."""
    return F.filter(tokens(s, 3), lambda w: ~w.isin("and", "not", "near"))


def is_keyword_query(q: Column | str) -> Column:
    """Queries that name things exactly (code, paths, quotes, identifiers, versions, addresses), so that vectors add nothing."""
    patterns = [
        r"`", r"/[a-zA-Z][\w/.]*", r"\b[A-Z][a-z]+[A-Z]\w*\b", r"\b[a-z]+_[a-z_]+\b", r"\bmem-[0-9a-f]{8,}\b",
        r"\bv?\d+\.\d+(?:\.\d+)?\b", r"https?://", r"\b[0-9a-f]{8,}\b",
    ]
    whole = F.trim(_c(q))
    quoted = whole.startswith('"') & whole.endswith('"') & (F.length(whole) > 2)
    return _c(q).rlike("|".join(f"(?:{p})" for p in patterns)) | quoted


def intent(q: Column | str) -> Column:
    """navigational, factual, conceptual or none."""
    low = F.lower(_c(q))
    return (
        F.when(is_keyword_query(q), "navigational")
        .when(low.rlike(r"(^|[^a-z0-9_])(what|when|who|where|which|how many)([^a-z0-9_]|$)"), "factual")
        .when(low.rlike(r"why|explain|concept|understand|overview|architecture|approach"), "conceptual")
        .otherwise("none")
    )


def decompose(q: Column | str) -> Column:
    """A compound question's parts (at most 4), or none: split at a conjunction before a question word."""
    q = _c(q)
    parts = F.split(q, r"(?i),?\s+(?:and|also|then|plus)\s+(?=(?:what|which|who|when|where|why|how|did|does|do|is|are)\b)")
    parts = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^[\s,;]+|[\s,;]+$", "")))
    parts = F.filter(parts, lambda p: (F.length(p) >= 12) & (F.size(F.split(p, r"\s+")) >= 2))
    whole = (F.length(q) >= 25) & ~q.rlike('".*"') & (F.size(parts) > 1)
    return F.when(whole, F.slice(parts, 1, 4)).otherwise(F.array().cast("array<string>"))


def human_ttl(seconds: Column | str) -> Column:
    s = _c(seconds)
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(s.isNull(), "permanent").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def duration_seconds(s: Column | str) -> Column:
    """Seconds of a duration like 1w2d3h4m; null if it isn't one or is zero."""
    t = F.lower(F.trim(_c(s)))
    total = F.lit(0).cast("long")
    for unit, size in (("w", 604800), ("d", 86400), ("h", 3600), ("m", 60)):
        total = total + F.coalesce(F.expr("1") * F.nullif(F.regexp_extract(t, rf"([0-9]+){unit}", 1), F.lit("")).cast("long"), F.lit(0)) * size
    ok = t.rlike(r"^([0-9]+w)?([0-9]+d)?([0-9]+h)?([0-9]+m)?$") & (total > 0)
    return F.when(ok, total)


def relative_time(then: Column, now: Column) -> Column:
    s = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 1e6)
    some = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return (
        F.when(s < 60, "just now").when(s < 3600, some(60, "m ago")).when(s < 86400, some(3600, "h ago"))
        .when(s < 604800, some(86400, "d ago")).otherwise(some(604800, "w ago"))
    )
