"""Labels and sentences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def plain(label: Column) -> Column:
    """A label in lower case without qualifiers after a dash, underscores as spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(label), "_", " "), r"-(merged|other|stuff|things?)\b", ""))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, exclamation or question mark before white space or the end, without quotes around; else the whole text."""
    bare = F.regexp_replace(F.trim(text), '^["\']+|["\']+$', "")
    found = F.regexp_extract(bare, r"(?s)^(.+?[.!?])(\s|$)", 1)
    return F.when(found != "", found).otherwise(bare)


def vocabulary_match(text: Column, terms: list[str]) -> Column:
    """The terms that stand in a text as words, plural endings allowed; longest first, and a match is used up. Sorted."""
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    start = F.struct(F.lower(text).alias("rest"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, term: F.when(
        F.rlike(acc["rest"], F.concat(F.lit(r"\b"), term, F.lit(r"(e?s)?\b"))),
        F.struct(F.regexp_replace(acc["rest"], F.concat(F.lit(r"\b"), term, F.lit(r"(e?s)?\b")), F.lit("#")).alias("rest"), F.array_append(acc["found"], term).alias("found")),
    ).otherwise(acc)
    return F.array_sort(F.aggregate(F.array(*[F.lit(t) for t in ordered]), start, step, lambda acc: acc["found"]))


def singular(word: Column) -> Column:
    """Forms a word may be the plural of, itself first."""
    return F.array_distinct(
        F.array_compact(
            F.array(
                word,
                F.when(F.endswith(word, F.lit("men")), F.regexp_replace(word, "men$", "man")),
                F.when(F.endswith(word, F.lit("ies")), F.regexp_replace(word, "ies$", "y")),
                F.when(F.endswith(word, F.lit("es")), F.regexp_replace(word, "es$", "")),
                F.when(F.endswith(word, F.lit("s")), F.regexp_replace(word, "s$", "")),
            )
        )
    )


def names_any(text: Column, lexicon: list[str]) -> Column:
    """Whether a word or pair of words of a text, or what it may be the plural of, is in the lexicon."""
    ws = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)
    pairs = F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    forms = F.flatten(F.transform(F.concat(ws, F.array_compact(pairs)), singular))
    return F.arrays_overlap(forms, F.array(*[F.lit(x) for x in lexicon]))


def shared_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of two strings, cut after the last separator in it. With the least and greatest of a group it is the group's."""
    n = F.least(F.length(low), F.length(high))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.left(low, i) == F.left(high, i))
    return F.regexp_extract(F.left(low, F.array_max(same)), r"^(.*[-_ #/])?", 1)


def json_bytes(value: Column) -> Column:
    return F.octet_length(F.to_json(value))
