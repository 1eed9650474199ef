"""Column functions over text: tokens, slugs, folds, identities, cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words left out of lexical queries (English).
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]
#: Function words that mark a language in mixed text.
FUNCTION_WORDS = {"fr": ["le", "la", "les", "des", "et", "que", "une", "dans"], "es": ["el", "los", "las", "de", "que", "y", "en", "una"], "de": ["der", "die", "das", "und", "nicht", "ein", "mit", "den"]}


def words(text: Column) -> Column:
    """Runs of letters, digits and combining marks of any script, in lower case and in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\pL\\pN\\pM]+"), 0)


def lexemes(text: Column) -> Column:
    """Distinct words without stop words."""
    return F.array_distinct(F.filter(words(text), lambda w: ~w.isin(STOP_WORDS)))


def fold(text: Column) -> Column:
    """Lower case, punctuation dropped, white space collapsed: the form in which texts are compared."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\pL\\pN\\pM\\s]", ""), "\\s+", " "))


def slug(text: Column) -> Column:
    """Lower case with every run of other characters as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based (SHA-1) UUID of name in the namespace."""
    raw = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(raw, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))


def clean(text: Column) -> Column:
    """Ligatures opened, ellipses and blanks made plain, spaces before punctuation dropped."""
    t = F.regexp_replace(F.regexp_replace(text, "ﬁ", "fi"), "ﬂ", "fl")
    t = F.regexp_replace(F.regexp_replace(t, "…", "..."), "[ \\t\\x{a0}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, " ([,.;:!?])", "$1"), "\\[\\d+\\]", ""))


def sentences(text: Column) -> Column:
    """Pieces between runs of ., ! or ? and blanks, trimmed; empty ones are left out."""
    return F.filter(F.transform(F.split(text, "[.!?]+\\s+"), F.trim), lambda s: s != "")


def shingles(ws: Column, k: int) -> Column:
    """Distinct hashes of all runs of k words."""
    n = F.size(ws)
    runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.array_join(F.slice(ws, i, k), " ")))
    return F.when(n >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def containment(a: Column, b: Column) -> Column:
    """Share of a's members that b has too; 0 if a is empty."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
