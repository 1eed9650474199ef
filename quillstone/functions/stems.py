"""English stems by suffix rules, told for distinct words and joined with the rest.

The rules are Porter's (1980). A word's form has v for its vowels (y counts as one behind a consonant)
and c for all else; conditions on a stem are regular expressions over the form. A step is one
chain of branches in generated code: the longest suffix that a word ends with decides, whether or
not its condition holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize

_0, _1, _V = "^c*v+c", "^c*v+c+v+c", "v"  # measure above 0, above 1, a vowel
#: Porter's steps as (suffix, what replaces it, condition on the stem's form).
STEPS = {
    "1a": [("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", "")],
    "1b": [("eed", "ee", _0), ("ed", "\t", _V), ("ing", "\t", _V)],  # the tab marks a stem that may get an e back
    "1c": [("y", "i", _V)],
    "2": [(a, b, _0) for a, b in (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
        ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))],
    "3": [(a, b, _0) for a, b in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))],
    "4": [(a, "", _1) for a in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")],
    "5a": [("e", "", _1)],
}


def _form(w: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace(w, "(^|[aeiou])y", "$1Y"), "aeiouy", "vvvvvv"), "[^v]", "c")


def _step(rules: list[tuple[str, str, str]]) -> Column:
    """Of the word w with its form f."""
    cases = []
    for suffix, new, condition in sorted(rules, key=lambda r: -len(r[0])):
        n = f"length(w) - {len(suffix) - (suffix in ('sion', 'tion'))}"  # -ion goes behind s or t, which stay
        done = f"concat(left(w, {n}), '{new}')"
        cases.append(f"WHEN endswith(w, '{suffix}') THEN " + (f"IF(left(f, {n}) RLIKE '{condition}', {done}, w)" if condition else done))
    return F.expr(f"CASE {' '.join(cases)} ELSE w END")


def stems(vocabulary: DataFrame) -> DataFrame:
    """(word, stem) of the distinct words vocabulary(word), in lower case. Words under three letters, or with others than a to z, stay."""
    d = vocabulary.select("word", F.col("word").alias("w"))
    for name, rules in STEPS.items():
        # a step reads the step before it as a column, so that no expression is repeated inside itself
        d = d.withColumn("f", _form(F.col("w"))).withColumn("w", _step(rules))
        if name == "1b":
            s = F.regexp_replace("w", "\t$", "")
            d = d.withColumn("s", s).withColumn("f", _form(F.col("s")))
            short = F.col("f").rlike("^c*v+c+$") & F.col("f").rlike("cvc$") & ~F.col("s").rlike("[wxy]$")
            back = F.when(F.col("s").rlike("(at|bl|iz)$"), F.concat("s", F.lit("e"))).when(F.col("s").rlike("(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"), F.substr(F.col("s"), F.lit(1), F.length("s") - 1)).when(short, F.concat("s", F.lit("e"))).otherwise(F.col("s"))
            d = d.withColumn("w", F.when(F.endswith("w", F.lit("\t")), back).otherwise(F.col("w")))
    # step 5: at measure one a final e goes too, unless the stem before it ends consonant, vowel, consonant; of ll one stays above measure one
    d = d.withColumn("f", _form(F.col("w"))).withColumn("b", F.substr(F.col("f"), F.lit(1), F.length("w") - 1))
    one = F.endswith("w", F.lit("e")) & F.col("b").rlike(_0) & ~(F.col("b").rlike("cvc$") & ~F.col("w").rlike("[wxy]e$"))
    d = d.withColumn("w", F.when(one, F.substr(F.col("w"), F.lit(1), F.length("w") - 1)).when(F.endswith("w", F.lit("ll")) & F.col("b").rlike(_1), F.substr(F.col("w"), F.lit(1), F.length("w") - 1)).otherwise(F.col("w")))
    plain = F.col("word").rlike("^[a-z]{3,}$")
    # written here: else a later filter on the stem would be moved below the steps, with all of them inside it
    return materialize(d.select("word", F.when(plain, F.col("w")).otherwise(F.col("word")).alias("stem")), "stems")


def stems_sql(vocabulary: str, prefix: str = "st") -> str:
    """DuckDB CTEs that end in <prefix>(word, stem) over the relation vocabulary(word)."""
    form = lambda w: f"regexp_replace(translate(regexp_replace({w}, '(^|[aeiou])y', '\\1Y', 'g'), 'aeiouy', 'vvvvvv'), '[^v]', 'c', 'g')"
    out, last = [f"{prefix}0 AS (SELECT word, word AS w FROM {vocabulary})"], f"{prefix}0"
    for i, (name, rules) in enumerate(STEPS.items(), 1):
        cases = []
        for suffix, new, condition in sorted(rules, key=lambda r: -len(r[0])):
            n = f"length(w) - {len(suffix) - (suffix in ('sion', 'tion'))}"
            done = f"left(w, {n}) || '{new}'"
            cases.append(f"WHEN ends_with(w, '{suffix}') THEN " + (f"CASE WHEN regexp_matches(left(f, {n}), '{condition}') THEN {done} ELSE w END" if condition else done))
        out.append(f"{prefix}{i} AS (SELECT word, CASE {' '.join(cases)} ELSE w END AS w FROM (SELECT *, {form('w')} AS f FROM {last}))")
        last = f"{prefix}{i}"
        if name == "1b":
            out.append(f"""{last}b AS (SELECT word, CASE WHEN NOT ends_with(w, '\t') THEN w WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e' WHEN regexp_matches(s, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$') THEN left(s, length(s) - 1)
  WHEN regexp_matches(f, '^c*v+c+$') AND regexp_matches(f, 'cvc$') AND NOT regexp_matches(s, '[wxy]$') THEN s || 'e' ELSE s END AS w FROM (SELECT *, {form('s')} AS f FROM (SELECT *, rtrim(w, '\t') AS s FROM {last})))""")
            last += "b"
    out.append(f"""{prefix} AS (SELECT word, CASE WHEN NOT regexp_matches(word, '^[a-z]{{3,}}$') THEN word WHEN ends_with(w, 'e') AND regexp_matches(b, '{_0}') AND NOT (regexp_matches(b, 'cvc$') AND NOT regexp_matches(w, '[wxy]e$')) THEN left(w, length(w) - 1)
  WHEN ends_with(w, 'll') AND regexp_matches(b, '{_1}') THEN left(w, length(w) - 1) ELSE w END AS stem FROM (SELECT *, left({form('w')}, length(w) - 1) AS b FROM {last}))""")
    return ",\n".join(out)
