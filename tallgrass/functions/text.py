"""Text scalars as Column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lines trimmed, blank and comment lines (``//``, ``#``) dropped, lower-cased, white space collapsed, one space between."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    code = F.filter(lines, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("#"))
    return F.regexp_replace(F.lower(F.array_join(code, " ")), r"\s+", " ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def shingles(toks: Column, k: int) -> Column:
    """Windows of k tokens joined by a space, repeats kept; none if there are fewer tokens.

    toks should be a column of its own: an expression here would be evaluated for each window.
    """
    made = F.transform(F.slice(toks, 1, F.greatest(F.lit(0), F.size(toks) - (k - 1))), lambda t, i: F.concat_ws(" ", t, *[F.get(toks, i + j) for j in range(1, k)]))
    return F.when(F.size(toks) >= k, made).otherwise(F.array().cast("array<string>"))


def hash60(s: Column) -> Column:
    """The first 60 bits of md5: a hash that other engines share."""
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def name_tokens(name: Column) -> Column:
    """Words of an identifier: camel, Pascal, snake, kebab, dotted and acronym boundaries; single letters dropped."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[_\-.:\s]+", " ")), " "), lambda w: F.length(w) > 1)


def identifiers(text: Column, stop: list[str], least: int = 3, cut: int = 64, most: int = 128) -> Column:
    """Distinct lower-case identifiers without stop words, in order of appearance."""
    runs = F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1), lambda w: F.trim(F.substring(w, 1, cut), F.lit("_")))
    words = F.filter(runs, lambda w: (F.length(w) >= least) & ~w.isin(stop))
    return F.slice(F.array_distinct(words), 1, most)


def loc(text: Column, comments: tuple[str, ...] = ("//", "#", "/*", "*")) -> Column:
    """Lines that are neither blank nor start with one of the comment marks."""

    def code(line: Column) -> Column:
        bare = F.trim(line)
        keep = bare != ""
        for mark in comments:
            keep = keep & ~bare.startswith(mark)
        return keep

    return F.size(F.filter(F.split(text, "\n"), code))


def literal_kind(token: Column) -> Column:
    """Numbers and quoted strings as INT_LIT, FLOAT_LIT and STR_LIT; short words with a lower-case letter as LOCAL_VAR."""
    return (
        F.when(token.rlike("^[0-9]+$"), "INT_LIT")
        .when(token.rlike(r"^[0-9]+\.[0-9]+$"), "FLOAT_LIT")
        .when(token.rlike("^[\"'].*[\"']$"), "STR_LIT")
        .when((F.length(token) <= 3) & token.rlike("[a-z]"), "LOCAL_VAR")
        .otherwise(token)
    )


LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "go": "go", "cpp": "cpp", "cc": "cpp", "h": "cpp", "hpp": "cpp"}


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    found = F.lit("txt")
    for e, name in LANGUAGES.items():
        found = F.when(ext == e, name).otherwise(found)
    return found


def code_of(name: Column) -> Column:
    """The first eight letters and digits, upper-cased; GENERIC if there are none."""
    return F.coalesce(F.nullif(F.substring(F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", "")), 1, 8), F.lit("")), F.lit("GENERIC"))
