"""Benchmark decontamination by template windows. DataFrame functions only.

Numbers, names and units become typed placeholders; windows of five template words, and of five
plain lower-case words, are hashed and joined with the benchmark's. A document holds an item if it has at least 0.8 of the item's
distinct plain windows, or of its template windows and, at one place at least, a reading of the item's slots that does not
contradict itself: wherever the item repeats a slot value, the document repeats one value too.
Names are told by their case. Where a document is all in capitals or small letters they aren't, so
an item with names is also looked for by its windows without names, of which there must be three.
So a question asked again with other numbers is found, and chance agreement of loose windows is
not; further places that hold the template with other values change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, materialize

NAME, UNIT, NUM = "\ue002", "\ue003", "\ue004"
#: Units that count as such after a number.
UNITS = "kg|g|mg|km|m|cm|mm|mi|miles|ft|feet|inches|lb|lbs|oz|l|ml|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|percent|usd|eur|dollars|euros|cents|mph|kmh|degrees"
#: Words that are no names though a sentence starts with them (English, German, French, Spanish).
COMMON = (
    "a|about|after|all|also|although|an|and|another|any|are|as|at|be|because|before|both|but|by|can|could|did|do|does|during|each|either|every|few|find|for|from|given|had|has|have|he|her|here|his|how|however|i|if|in|into|is|it|its|let|many|may|more|most|much|my|no|not|now|of|on|once|one|only|or|other|our|she|should|since|so|some|such|suppose|than|that|the|their|then|there|these|they|this|those|though|thus|to|under|until|was|we|were|what|when|where|which|while|who|whom|whose|why|will|with|would|yes|you|your"
    "|aber|als|am|auch|auf|aus|bei|das|dem|den|der|des|die|durch|ein|eine|einem|einen|einer|er|es|für|ich|im|ist|kann|man|mit|nach|nicht|oder|sie|sind|und|vom|von|vor|wann|war|warum|was|wenn|wer|wie|wieviel|wir|wird|wo|zu|zum|zur"
    "|au|aux|avec|ce|ces|cette|comment|dans|de|du|elle|elles|en|est|et|il|ils|je|la|le|les|leur|mais|nous|où|ou|par|pas|pour|pourquoi|quand|que|quel|quelle|qui|sa|si|son|sur|un|une|vous"
    "|al|como|cómo|con|cuál|cuando|cuándo|cuánto|cuántos|del|donde|dónde|el|ella|ellos|ese|esta|este|hay|las|lo|los|para|pero|por|qué|quién|se|sin|su|una|uno|y"
)
#: A capitalised word that starts there and is not a common one.
NAMED = rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{M}}\p{{Nd}}])(?<!\p{{L}}['’-])(?!(?iu:{COMMON})(?![\p{{L}}\p{{M}}]))\p{{Lu}}\p{{Ll}}+"
MEASURED = rf"(\p{{Nd}}\s+)({UNITS})([\s.,;:!?]|$)"
DROPPED = rf"[^\p{{L}}\p{{M}}\p{{Nd}}{NAME}{UNIT}\s]+"
NUMBER = r"(^|\s)[^\s\p{Nd}]*\p{Nd}\S*"
SLOT = rf"([{NAME}{UNIT}])\S+"


def words_of(text: Column) -> Column:
    """Lower-case words without punctuation; names and units carry a marker in front."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(t.rlike(f"[{NAME}{UNIT}{NUM}]"), F.translate(t, NAME + UNIT + NUM, "")).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, NAMED, f"{NAME}$0"), MEASURED, f"$1{UNIT}$2$3")
    return F.lower(F.regexp_replace(t, DROPPED, ""))


def template_of(words: Column) -> Column:
    """The words with each slot replaced by its type's placeholder."""
    return F.regexp_replace(F.regexp_replace(words, NUMBER, f"$1{NUM}"), SLOT, "$1")


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def _windows(rows: DataFrame, keep: list[str], sizes: list[tuple[str, str, Column]], k: int) -> DataFrame:
    """(keep..., kind, at, h, w1..wk): the windows of word arrays, one row each.

    sizes: (kind, array column, words in a window). Neighbouring words are zipped and exploded, so
    hashing runs in generated code and no array travels with the rows. A window of fewer than k
    words has null words at its end; arrays shorter than the window have none.
    """
    runs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("w"), n.cast("int").alias("n")) for kind, c, n in sizes])
    rows = rows.select(*keep, F.explode(runs).alias("r")).select(*keep, "r.kind", F.col("r.w").alias("w"), F.col("r.n").alias("n"))
    many = F.greatest(F.size("w") - F.col("n") + 1, F.lit(0))
    none = F.array().cast("array<string>")
    parts = [F.when((F.col("n") > i) & (many > 0), F.slice("w", i + 1, many)).otherwise(none) for i in range(k)]
    cut = F.arrays_zip(*[p.alias(f"w{i + 1}") for i, p in enumerate(parts)])
    # outer: else a test of the arrays' size repeats all the work above
    z = rows.select(*keep, "kind", F.posexplode_outer(cut).alias("at", "z")).select(*keep, "kind", "at", *[F.col("z")[f"w{i + 1}"].alias(f"w{i + 1}") for i in range(k)])
    return z.withColumn("h", F.when(F.col("w1").isNotNull(), F.xxhash64("kind", *[f"w{i + 1}" for i in range(k)])))


def find(docs: DataFrame, benchmark: DataFrame, *, key: str, text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 5, share: float = 0.8) -> DataFrame:
    """Pairs (key, item_id, matched, windows) of documents and the items that they hold.

    docs.key must identify a row. Windows of the template and of the plain lower-case words are
    counted apart; the greater share is reported, and what the plain words show needs no reading
    of slots. Items are rows: repeated items are found separately if their ids differ. Null,
    empty or punctuation-only texts hold nothing and are held by nothing; windows of placeholders
    alone don't count. An item shorter than k words is one window over its whole text: its plain
    words are found anywhere, its template (which says too little) only as a whole document.
    Empty tables: no pairs. Which side of the window join is broadcast is left to Spark's size check.
    """
    plain = lambda w: _split(F.regexp_replace(w, f"[{NAME}{UNIT}]", ""))
    least = lambda c: F.least(F.lit(k), F.size(c))
    b = benchmark.select(F.col(item).cast("long").alias("item_id"), words_of(F.col(item_text)).alias("_w"))
    caseless = lambda w: _split(template_of(F.regexp_replace(w, NAME, "")))
    b = b.select("item_id", _split(F.col("_w")).alias("w"), _split(template_of(F.col("_w"))).alias("t"), plain(F.col("_w")).alias("p"), caseless(F.col("_w")).alias("c")).filter(F.size("t") > 0)
    short = sorted(r.n for r in b.filter(F.size("t") < k).select(F.size("t").alias("n")).distinct().collect())  # less than k numbers
    literal = lambda ws: F.exists(ws, lambda w: ~w.isin(NAME, UNIT, NUM))
    starts = F.sequence(F.lit(0), F.greatest(F.size("t") - k, F.lit(0)))
    bw = _windows(b, ["item_id", "t"], [("t", "t", least("t")), ("p", "p", least("p")), ("c", "c", least("c"))], k)
    here, named = F.slice("t", F.col("at") + 1, k), F.array_contains("t", NAME)
    bw = bw.filter(literal(here) & ((F.col("kind") != "c") | (named & ~F.array_contains(here, NAME)))).select("item_id", "kind", "h").distinct()
    items = bw.groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("windows")).filter((F.col("kind") != "c") | (F.col("windows") >= 3))
    bw = materialize(bw.join(items, ["item_id", "kind"]).select("h", "item_id", F.col("kind").alias("of"), "windows"), "decontam-items")

    by_case = not bw.filter("of = 'c'").isEmpty()
    dw = docs.select(key, words_of(F.col(text)).alias("_w")).select(key, _split(template_of(F.col("_w"))).alias("_t"), plain(F.col("_w")).alias("_p"), *([caseless(F.col("_w")).alias("_c")] if by_case else []))
    sizes = [("t", "_t", least("_t")), ("p", "_p", least("_p")), *[("p", "_p", F.when(F.size("_p") > n, F.lit(n)).otherwise(F.lit(k + 1))) for n in short]]
    sizes += [("c", "_c", least("_c"))] if by_case else []
    hits = _windows(dw, [key], sizes, k).select(key, "h").join(bw, "h").select(key, "item_id", F.col("of").alias("kind"), "windows", "h").distinct()
    hits = hits.groupBy(key, "item_id", "kind").agg(F.count(F.lit(1)).alias("matched"), F.first("windows").alias("windows"))
    told = materialize(hits.filter(F.col("matched") >= share * F.col("windows")), "decontam-hits")
    best = F.max(F.struct(F.col("matched") / F.col("windows"), "matched", "windows")).alias("m")
    hits = told.groupBy(key, "item_id").agg(best).select(key, "item_id", "m.matched", "m.windows")

    slotted = b.filter(F.exists("t", lambda w: w.isin(NAME, UNIT, NUM)))
    asked = told.filter("kind <> 'p'").join(told.filter("kind = 'p'"), [key, "item_id"], "left_anti").join(slotted.select("item_id"), "item_id", "left_semi")
    asked = asked.groupBy(key, "item_id").agg(F.max_by("windows", "kind").alias("windows"))  # of the template, if it told
    if asked.isEmpty():
        return hits
    # the item's windows and the document's are laid over each other to read the slots
    cut = lambda ws: F.transform(starts, lambda i: F.struct(F.array_join(F.slice("t", i + 1, k), " ").alias("tw"), F.slice(ws, i + 1, k).alias("ww"), F.slice("t", i + 1, k).alias("tt")))
    iw = slotted.select("item_id", F.size("t").alias("n"), F.posexplode_outer(cut(F.col("w"))).alias("p", "x")).select("item_id", "n", "p", "x.tw", F.col("x.ww").alias("iww"), "x.tt").filter(literal(F.col("tt")))
    held = docs.join(asked.select(key).distinct(), key, "left_semi").select(key, words_of(F.col(text)).alias("_w")).distinct()
    held = held.select(key, _split(F.col("_w")).alias("w"), _split(template_of(F.col("_w"))).alias("t")).filter(F.size("t") > 0)
    hw = held.select(key, F.posexplode_outer(cut(F.col("w"))).alias("q", "x")).select(key, "q", "x.tw", F.col("x.ww").alias("dww"))
    read = materialize(hw.join(asked.select(key, "item_id", "windows"), key).join(iw, ["item_id", "tw"]), "decontam-read")
    pair = [key, "item_id"]
    # over the whole document, as for an item in scattered pieces, and at each place by itself
    loose = _agreed(read.select(*pair, "tw", "tt", "iww", "dww").distinct(), pair, share)
    bare = read.groupBy(*pair).agg(F.max(F.exists("tt", lambda w: w.isin(NAME, UNIT, NUM))).alias("s")).filter("NOT s").select(*pair)  # nothing but names was left to read
    kept = loose.union(bare).union(_agreed(_places(read, pair, share), [*pair, "place"], share).select(*pair)).distinct()
    bad = read.select(*pair).distinct().join(kept, pair, "left_anti")
    return hits.join(bad, pair, "left_anti")


def _places(read: DataFrame, pair: list[str], share: float) -> DataFrame:
    """Readings of an item at each place of a document that holds the share of its windows.

    A place is a range of offsets between document and item as wide as the item; ranges overlap
    by half, so that inserted or dropped words don't tear a place apart. There, a window of the
    item is read at the one offset that most windows have.
    """
    off, n = F.col("q") - F.col("p"), F.col("n")
    ranges = F.array(*[F.struct(F.lit(i).alias("half"), F.floor((2 * off + i * n) / (2 * n)).alias("at")) for i in (0, 1)])
    at = read.select("*", off.alias("off"), F.explode(ranges).alias("place"))
    common = at.groupBy(*pair, "place", "off").agg(F.count(F.lit(1)).alias("c"))
    one = at.join(common, [*pair, "place", "off"]).groupBy(*pair, "place", "p", "windows", "tw", "tt", "iww").agg(F.max_by("dww", F.struct("c", -F.col("off"))).alias("dww"))
    whole = one.groupBy(*pair, "place", "windows").agg(F.count_distinct("tw").alias("m")).filter(F.col("m") >= share * F.col("windows"))
    return one.join(whole.select(*pair, "place"), [*pair, "place"], "left_semi")


def _agreed(read: DataFrame, by: list[str], share: float) -> DataFrame:
    """Groups whose slot values are read in one way: of a value's readings, the best have the share."""
    slots = read.select(*by, F.explode(F.arrays_zip("tt", "iww", "dww")).alias("z")).filter(F.col("z.tt").isin(NAME, UNIT, NUM))
    seen = slots.groupBy(*by, "z.iww", "z.dww").agg(F.count(F.lit(1)).alias("n"))
    agreed = seen.groupBy(*by, "iww").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return agreed.groupBy(*by).agg(F.sum("best").alias("best"), F.sum("n").alias("n")).filter(F.col("best") >= share * F.col("n")).select(*by)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Distinct rows (doc_id, item_id, matched, windows): what find() reports, by doc_id.

    Repeated doc_ids count as one document here; null doc_ids are left out.
    """
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.xxhash64(F.col(text)).alias("_h"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("_key", F.struct("doc_id", "_h")).drop("_h")
    got = find(rows, benchmark, key="_key", text="text", **options)
    return got.select("_key.doc_id", "item_id", "matched", "windows").groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("windows").alias("windows"))


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no item, with docs' own columns. Rows with null text stay; so do other columns, whatever their names."""
    (key,) = fresh(docs, "key")
    digest = F.xxhash64(F.col(text), F.length(F.col(text)))
    rows = docs.select(digest.alias("_key"), F.col(text).alias("text"))
    held = materialize(find(rows, benchmark, key="_key", text="text", **options).select(F.col("_key").alias(key)).distinct(), "decontam-held")
    return docs.withColumn(key, digest).join(held, key, "left_anti").select(*docs.columns)
