"""Editorial work on a corpus: labels, fragments, fixes, registry pairing, role ranges, sync plans and assertions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import containment, fold, shingles, words
from ..store import materialize

#: Words that stay small inside a title, and valid Roman numerals.
SMALL_WORDS = ["a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
ROMAN = "^C{0,3}(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


#: Brackets that nest.
BRACKETS = {"[": "]", "(": ")", "{": "}"}


def bracket_spans(text: str, kind: str = "[") -> tuple[list[tuple[int, int]], list[tuple[int, str]]]:
    """Outermost balanced spans (start, end) of a kind, and unbalanced brackets (place, bracket) of any kind.

    A stack of open brackets: a closing one ends the nearest open one of its kind, and what was
    opened within stays unbalanced; without one it is unbalanced itself.
    """
    closes, stack, done, odd = {c: o for o, c in BRACKETS.items()}, [], [], []
    for m in re.finditer(r"[\[\](){}]", text):
        b, at = m[0], m.start()
        if b in BRACKETS:
            stack.append((b, at))
        elif any(o == closes[b] for o, _ in stack):
            while stack[-1][0] != closes[b]:
                odd.append((stack[-1][1], stack.pop()[0]))
            start = stack.pop()[1]
            if closes[b] == kind:
                while done and done[-1][0] > start:
                    done.pop()
                done.append((start, at + 1))
        else:
            odd.append((at, b))
    return done, sorted(odd + [(at, b) for b, at in stack])


def without_brackets(rows: DataFrame, kind: str = "[", keep: str = r"^\[\s*\d+\s*\]$") -> DataFrame:
    """rows (id, text) with text, removed (array of start and span, starts in the source) and odd (array of place and bracket).

    Balanced spans of `kind` go whole, with all that nests in them, but for those that match
    `keep` (numbers of notes). Putting the removed spans back at their starts gives the source.
    Unbalanced brackets stay and are told. Null texts stay null.
    """
    stays = re.compile(keep)
    spans, odds = "removed array<struct<start:int,span:string>>", "odd array<struct<place:int,bracket:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone, odd = [], [], []
            for t in b.column("text").to_pylist():
                found, left = bracket_spans(t or "", kind)
                found = [(i, j) for i, j in found if not stays.match(t[i:j])]
                out, at = [], 0
                for i, j in found:
                    out.append(t[at:i])
                    at = j
                texts.append(None if t is None else "".join(out) + t[at:])
                gone.append([{"start": i, "span": t[i:j]} for i, j in found])
                odd.append([{"place": i, "bracket": x} for i, x in left])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string()), pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("span", pa.string())]))), pa.array(odd, pa.list_(pa.struct([("place", pa.int32()), ("bracket", pa.string())])))], ["id", "text", "removed", "odd"])

    return rows.select("id", "text").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string, {spans}, {odds}")


def changes_unexplained(before: DataFrame, after: DataFrame, removed: DataFrame) -> DataFrame:
    """(id) of texts whose change the log doesn't explain: before(id, text) isn't after(id, text) with removed(id, start, span) put back."""
    log = removed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "span"))).alias("z"))
    j = before.select("id", F.col("text").alias("was")).join(after.select("id", F.col("text").alias("is")), "id", "full_outer").join(log, "id", "left")
    start = F.struct(F.coalesce("is", F.lit("")).alias("t"))
    back = F.aggregate(F.coalesce("z", F.array().cast(log.schema["z"].dataType)), start, lambda s, x: F.struct(F.concat(F.substr(s["t"], F.lit(1), x["start"]), x["span"], F.substr(s["t"], x["start"] + 1)).alias("t")), lambda s: s["t"])
    return j.filter(~F.coalesce("was", F.lit("")).eqNullSafe(back)).select("id")


def recurring_endings(docs: DataFrame, lines: int = 4, least: int = 3) -> DataFrame:
    """(source, line, n): lines that end `least` different texts of a source or more.

    docs: (id, source, text). A line counts if it is among a text's last `lines` lines that aren't
    blank, whatever its case and blanks. Copies of a text count once, so they make no footer.
    """
    texts = docs.filter("text IS NOT NULL").groupBy("source", F.xxhash64("text").alias("_h"), F.length("text").alias("_n")).agg(F.first(_last_lines(F.col("text"), lines)).alias("_l"))
    return texts.select("source", F.explode(F.array_distinct(F.transform("_l", _line_key))).alias("line")).groupBy("source", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _last_lines(text: Column, lines: int) -> Column:
    """The last lines that aren't blank, the last one first."""
    return F.slice(F.reverse(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")), 1, lines)


def _line_key(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "\\s+", " ")))


def without_footers(docs: DataFrame, footers: DataFrame, lines: int = 4) -> DataFrame:
    """docs (id, source, text) with the run of footer lines at each text's end cut off, and `cut`, how many went.

    footers: (source, line), as recurring_endings finds them or as a list gives them. Null texts stay.
    """
    tail = docs.filter("text IS NOT NULL").select("id", "source", F.posexplode(F.transform(_last_lines(F.col("text"), lines), _line_key)).alias("at", "line"))
    known = footers.select("source", "line").distinct().withColumn("_f", F.lit(True))
    stays = tail.join(known, ["source", "line"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("_all"), F.min(F.when(F.col("_f").isNull(), F.col("at"))).alias("_stop"))
    cut = F.coalesce("_stop", "_all", F.lit(0))
    kept = F.split("text", "\n")
    # the place of each line that isn't blank; what lies behind the last one that stays goes
    full = F.filter(F.transform(kept, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    last = F.when(cut == 0, F.size(kept)).otherwise(F.coalesce(F.get(full, F.size(full) - cut - 1) + 1, F.lit(0)))
    return docs.join(stays, "id", "left").select("id", "source", F.array_join(F.slice(kept, F.lit(1), last), "\n").alias("text"), cut.alias("cut"))


def label_case(label: Column) -> Column:
    """A label all in capitals with title case; Roman numerals stay, small words are small but at the start. Others stay."""
    lower = lambda w, i: F.when((i > 0) & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(F.concat(F.left(w, F.lit(1)), F.lower(F.substr(w, F.lit(2)))))
    titled = F.transform(F.split(label, " "), lambda w, i: F.when((w != "") & w.rlike(ROMAN), w).otherwise(lower(w, i)))
    return F.when(label.rlike("[A-Z]") & (label == F.upper(label)), F.array_join(titled, " ")).otherwise(label)


def fragment(text: Column, most: int = 8, least: int = 3, restarts: int = 3) -> Column:
    """The words by which a page can be searched for a passage, or null.

    From the first line of `most` words or more, else the first line: the first stretch without
    numbers, brackets or note marks that has `least` words, among the first restarts + 1.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r]+", " "))), lambda x: x != "")
    long = F.filter(lines, lambda x: F.size(F.split(x, " ")) >= most)
    line = F.coalesce(F.get(long, F.lit(0)), F.get(lines, F.lit(0)))
    cut = F.regexp_replace(F.regexp_replace(line, "([^ ]*?)[\\[\\]*†‡][^ ]*", "$1 |"), "[^ ]*[0-9|][^ ]*", "|")
    parts = F.transform(F.slice(F.split(cut, "\\|"), 1, restarts + 1), lambda p: F.slice(F.filter(F.split(p, " "), lambda w: w != ""), 1, most))
    found = F.get(F.filter(parts, lambda p: F.size(p) >= least), F.lit(0))
    return F.regexp_replace(F.array_join(found, " "), "[-–—]+$", "")


def fragment_url(url: Column, words_: Column) -> Column:
    """url with a text fragment; `-` is syntax there and is encoded too."""
    encoded = F.replace(F.replace(F.replace(F.url_encode(words_), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("-"), F.lit("%2D"))
    return F.concat(url, F.when(F.contains(url, F.lit("#")), "").otherwise("#"), F.lit(":~:text="), encoded)


def removed_spans(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, place, span): a log of everything the pattern takes out of the text, in order."""
    return rows.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("place", "span"))


def overlap_chunks(text: Column, target: int, overlap: int = 0, reach: int = 500, least: int = 40) -> Column:
    """An array of pieces, each cut at the last blank up to `reach` characters past the target; neighbours share `overlap` characters.

    Without a blank there the cut is at the target. Empty pieces are left out; without overlap a
    last piece under `least` characters joins the one before it. Null and empty texts: no piece.
    An aggregate in the JVM; each round reads the text once, so time grows with pieces times length.
    """
    size, whole = F.lit(max(1, target)), F.length(text)
    rounds = 3 * F.floor(whole / max(1, target - overlap)) + 3  # three rounds go on by target - overlap at least
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("cuts"))

    def onward(state: Column, _: Column) -> Column:
        at, due = state["at"], state["at"] + size
        seen = F.substr(text, at + 2, size + (reach - 1))  # where a blank may stand in: behind the first character, before due + reach
        back = F.instr(F.reverse(seen), " ")
        blank = F.when(back > 0, at + 1 + F.length(seen) - back).otherwise(due)
        end = F.when(due >= whole, whole).otherwise(blank)
        after = F.when(end >= whole, whole).when(end - overlap > at, end - overlap).otherwise(end)
        told = F.struct(at.cast("int").alias("a"), end.cast("int").alias("b"))
        going = at < whole
        return F.struct(F.when(going, after).otherwise(at).cast("int").alias("at"), F.when(going, F.array_append(state["cuts"], told)).otherwise(state["cuts"]).alias("cuts"))

    cuts = F.aggregate(F.sequence(F.lit(1), rounds.cast("int")), begin, onward)["cuts"]
    cut = F.transform(cuts, lambda c: F.regexp_replace(F.substr(text, c["a"] + 1, c["b"] - c["a"]), "^\\s+|\\s+$", ""))
    pieces = F.filter(cut, lambda p: p != "")
    if overlap:
        return F.coalesce(pieces, F.array().cast("array<string>"))
    n = F.size(pieces)
    short = (n > 1) & (F.length(F.get(pieces, n - 1)) < least)
    joined = F.concat(F.slice(pieces, F.lit(1), n - 2), F.array(F.concat_ws(" ", F.get(pieces, n - 2), F.get(pieces, n - 1))))
    return F.coalesce(F.when(short, joined).otherwise(pieces), F.array().cast("array<string>"))


def classification_problems(facets: DataFrame, labels: DataFrame, contents: DataFrame) -> DataFrame:
    """(passage, facet_id, problem): labels must match facets one to one, and explicit evidence stand in the passage.

    facets: (passage, facet_id); labels: (passage, facet_id, grounding, evidence); contents: (passage, content).
    """
    key = ["passage", "facet_id"]
    n = labels.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    paired = facets.select(*key).distinct().withColumn("_f", F.lit(True)).join(n, key, "full_outer")
    ids = paired.select(*key, F.when(F.col("n").isNull(), "missing").when(F.col("_f").isNull(), "unknown").when(F.col("n") > 1, "duplicate").alias("problem"))
    told = labels.join(contents, "passage").select(*key, F.when(F.trim(F.coalesce("evidence", F.lit(""))) == "", "no_evidence")
        .when((F.col("grounding") == "explicit") & ~F.contains(fold(F.col("content")), fold(F.col("evidence"))), "not_contiguous").alias("problem"))
    return ids.filter("problem IS NOT NULL").unionByName(told.filter("problem IS NOT NULL").distinct())


def range_problems(rows: DataFrame, ranges: DataFrame, role: str) -> DataFrame:
    """(document, position, problem): rows within declared ranges must have the role, others must not.

    rows: (document, position, role); ranges: (document, first, last), which may overlap.
    """
    inside = rows.join(ranges, "document").filter(F.col("position").between(F.col("first"), F.col("last"))).select("document", "position").distinct().withColumn("_in", F.lit(True))
    has, within = F.col("role").eqNullSafe(role), F.col("_in").isNotNull()
    problem = F.when(within & ~has, "role_missing").when(~within & has, "role_outside")
    return rows.join(inside, ["document", "position"], "left").select("document", "position", problem.alias("problem")).filter("problem IS NOT NULL")


def word_shares(units: DataFrame, citing: DataFrame) -> DataFrame:
    """(unit, share): how many of a unit's words, repeats included, the passages that cite it hold.

    units: (unit, text); citing: (first, last, text) cites every unit from first to last.
    """
    count = lambda d, n: d.groupBy("unit", "w").agg(F.count(F.lit(1)).alias(n))
    own = count(units.select("unit", F.explode(words(F.col("text"))).alias("w")), "n")
    held = citing.select("first", "last", "w", "n") if "w" in citing.columns else citing.select("first", "last", F.explode(words(F.col("text"))).alias("w")).groupBy("first", "last", "w").agg(F.count(F.lit(1)).alias("n"))
    held = held.select(F.explode(F.sequence("first", "last")).alias("unit"), "w", "n").groupBy("unit", "w").agg(F.sum("n").alias("m"))
    return own.join(held, ["unit", "w"], "left").groupBy("unit").agg(F.round(F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n"), 6).alias("share"))


def number_agreement(rows: DataFrame) -> DataFrame:
    """(agree, read): rows whose text holds a number of at most four digits, and those where the mapped one is among them.

    rows: (text, page).
    """
    found = F.regexp_extract_all("text", F.lit("\\b\\d{1,4}\\b"), F.lit(0))
    hit = F.array_contains(F.transform(found, lambda x: x.cast("long")), F.col("page"))
    return rows.filter(F.size(found) > 0).agg(F.sum(hit.cast("long")).alias("agree"), F.count(F.lit(1)).alias("read"))


def _shingled(rows: DataFrame, p: str, k: int = 8) -> DataFrame:
    """id and content's shingles, prefixed; words stand in a column of their own so that they are found once."""
    return rows.withColumn("_w", words(F.col("content"))).withColumn(f"{p}_s", shingles(F.col("_w"), k)).drop("_w")


def freeze_pairs(live: DataFrame, built: DataFrame, least: float = 0.5) -> DataFrame:
    """(live_id, built_id, method): one built passage for each live one, none twice.

    By anchor where half the shingles agree (or the texts are equal), then equal texts in
    order, then what is left of a unit in order. live, built: (id, document, unit, anchor, position, content).
    """
    a = _shingled(live, "l").select(F.col("id").alias("live_id"), "document", "anchor", "l_s", F.col("content").alias("lc"))
    b = _shingled(built, "b").select(F.col("id").alias("built_id"), "document", "anchor", "b_s", F.col("content").alias("bc"))
    near = F.greatest(containment(F.col("l_s"), F.col("b_s")), containment(F.col("b_s"), F.col("l_s"))) >= least
    pairs = a.join(b, ["document", "anchor"]).filter((F.col("lc") == F.col("bc")) | near).groupBy("live_id").agg(F.min("built_id").alias("built_id")).groupBy("built_id").agg(F.min("live_id").alias("live_id")).select("live_id", "built_id", F.lit("anchor").alias("method"))
    pairs = materialize(pairs, "freeze-anchor")
    for method, keys in (("text", ["document", "_t"]), ("unit", ["document", "unit"])):
        rest = lambda d, c: d.withColumn("_t", fold(F.col("content"))).join(pairs.select(F.col(c).alias("id")), "id", "left_anti")  # noqa: E731, B023
        numbered = lambda d, c: rest(d, c).withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("position", "id"))).select(F.col("id").alias(c), *keys, "_r")  # noqa: E731, B023
        pairs = pairs.unionByName(numbered(live, "live_id").join(numbered(built, "built_id"), [*keys, "_r"]).select("live_id", "built_id", F.lit(method).alias("method")))
    return pairs


def text_holders(lost: DataFrame, built: DataFrame, opening: int = 8) -> DataFrame:
    """(id, holder): the one passage of its document with a lost text's opening words; else the one that shares most shingles, unless tied.

    lost, built: (id, document, content).
    """
    first = lambda d: d.withColumn("_w", words(F.col("content")))
    runs = lambda d, c: d.select(F.col("id").alias(c), "document", F.explode(shingles(F.col("_w"), opening)).alias("h"))
    l_, b_ = first(lost), first(built)
    opens = l_.filter(F.size("_w") >= opening).select("id", "document", F.xxhash64(F.array_join(F.slice("_w", 1, opening), " ")).alias("h"))
    sole = opens.join(runs(b_, "holder"), ["document", "h"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("holder").alias("holder")).filter("n = 1").select("id", F.col("holder").alias("by_opening"))
    shared = runs(l_, "id").join(runs(b_, "holder"), ["document", "h"]).groupBy("id", "holder").agg(F.count(F.lit(1)).alias("n"))
    top = shared.groupBy("id").agg(F.max("n").alias("n"))
    best = shared.join(top, ["id", "n"]).groupBy("id").agg(F.count(F.lit(1)).alias("ties"), F.min("holder").alias("by_share")).filter("ties = 1").select("id", "by_share")
    return lost.select("id").join(sole, "id", "left").join(best, "id", "left").select("id", F.coalesce("by_opening", "by_share").alias("holder"))


def kept_text(low: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, status): a passage that keeps its id but little of its text needs an entry with a reason; an entry without such a passage is stale."""
    j = low.select("id", F.lit(True).alias("_low")).join(entries.select("id", "reason"), "id", "full_outer")
    return j.select("id", F.when(F.col("_low").isNull(), "stale").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no_reason").otherwise("kept").alias("status"))


def access_plan(live: DataFrame, inventory: DataFrame) -> DataFrame:
    """(document, before, after, reason): what readers may see of each live document by the rights inventory.

    live: (document, access, url, file); inventory: (document, allowed, url, file). Without a row:
    excerpt. Another edition (other url, or other file where a url is missing): held at excerpt.
    """
    j = live.join(inventory.select("document", "allowed", F.col("url").alias("i_url"), F.col("file").alias("i_file")), "document", "left")
    differs = F.when(F.col("url").isNotNull() & F.col("i_url").isNotNull(), F.col("url") != F.col("i_url")).otherwise(F.coalesce(F.col("file") != F.col("i_file"), F.lit(False)))
    reason = F.when(F.col("allowed").isNull(), "no_row").when((F.col("allowed") == "full") & differs, "other_edition").otherwise("inventory")
    return j.select("document", F.col("access").alias("before"), F.when(reason == "inventory", F.col("allowed")).otherwise("excerpt").alias("after"), reason.alias("reason"))


def apply_fixes(passages: DataFrame, fixes: DataFrame) -> DataFrame:
    """(id, status, text) of every fix: applied where what it seeks stands exactly once in the passage's own text.

    passages: (id, text); fixes: (fix, id, find, replace, why).
    """
    times = F.coalesce((F.length("text") - F.length(F.replace("text", "find", F.lit("")))) / F.nullif(F.length("find"), F.lit(0)), F.lit(0.0))
    status = F.when(F.col("text").isNull(), "no_passage").when(F.trim(F.coalesce("why", F.lit(""))) == "", "no_reason").when(times != 1, "not_once").otherwise("applied")
    j = fixes.join(passages, "id", "left")
    return j.select("fix", "id", status.alias("status"), F.when(status == "applied", F.replace("text", "find", "replace")).alias("text"))


def overrides_applied(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """(id, text): each row's replacements, one after the other in their order; rows without any stay.

    rows: (id, text); overrides: (id, step, find, replace).
    """
    steps = overrides.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("step", "find", "replace"))).alias("_s"))
    done = F.aggregate("_s", F.col("text"), lambda t, x: F.replace(t, x["find"], x["replace"]))
    return rows.join(steps, "id", "left").select("id", F.coalesce(done, F.col("text")).alias("text"))


def registry_problems(works: DataFrame, facts: DataFrame, passages: DataFrame, redirects: DataFrame) -> DataFrame:
    """(key, problem) of a registry: documents without a work or facts, repeated anchors, redirects to nothing or onto themselves.

    works, facts: (document); passages: (id, document, anchor); redirects: (old_id, new_id).
    """
    docs = passages.select("document").distinct()
    told = lambda d, key, name: d.select(F.col(key).cast("string").alias("key"), F.lit(name).alias("problem"))
    ids = passages.select(F.col("id").alias("new_id")).distinct()
    twice = passages.groupBy("document", "anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.concat_ws("#", F.col("document").cast("string"), "anchor").alias("key"))
    out = told(docs.join(works, "document", "left_anti"), "document", "no_work").unionByName(told(docs.join(facts, "document", "left_anti"), "document", "no_facts"))
    out = out.unionByName(told(facts.join(docs, "document", "left_anti"), "document", "facts_of_nothing")).unionByName(told(twice, "key", "anchor_twice"))
    out = out.unionByName(told(redirects.join(ids, "new_id", "left_anti"), "old_id", "redirect_to_nothing"))
    return out.unionByName(told(redirects.join(ids.withColumnRenamed("new_id", "old_id"), "old_id", "left_semi"), "old_id", "redirect_of_built"))


def result_checks(results: DataFrame, checks: DataFrame) -> DataFrame:
    """(check_id, passed): assertions on ranked results.

    results: (query_id, rank, item); checks: (check_id, query_id, kind, item): `some` the item is
    among the results, `first` it leads them, `none` it isn't among them.
    """
    held = results.select("query_id", "item", "rank").groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    found = F.col("rank").isNotNull()
    passed = F.when(F.col("kind") == "some", found).when(F.col("kind") == "first", found & (F.col("rank") == 1)).otherwise(~found)
    return checks.join(held, ["query_id", "item"], "left").select("check_id", passed.alias("passed"))


def stitch_replies(rows: DataFrame) -> DataFrame:
    """For each reply, the span of the objection with its number that it answers.

    rows: (document, chapter, position, role, number, opens_new). The nearest such objection before
    it counts, unless a reply stands between that and the last determination: then it belongs to
    another article. A split objection is one span, up to a part that opens a new argument.
    """
    order = W.partitionBy("document", "chapter").orderBy("position")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    at = lambda role, w: F.max(F.when(F.col("role") == role, F.col("position"))).over(w)
    kind = F.when(F.col("role") == "objection", F.col("number"))
    m = rows.withColumn("_kind", kind).withColumn("_reply", at("reply", before))
    m = m.withColumn("_bar", F.last(F.when(F.col("role") == "determination", F.struct(F.col("_reply").alias("r"))), True).over(before)["r"])
    m = m.withColumn("_run", F.sum((~F.col("_kind").eqNullSafe(F.lag("_kind").over(order))).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    m = m.withColumn("_objection", at("objection", W.partitionBy("document", "chapter", "number").orderBy("position").rowsBetween(W.unboundedPreceding, -1)))
    in_run = W.partitionBy("document", "chapter", "_run")
    spans = m.filter("_kind IS NOT NULL").withColumn("obj_from", F.min("position").over(in_run)).withColumn("_last", F.max("position").over(in_run))
    stop = F.min(F.when(F.col("opens_new") & (F.col("position") > F.col("obj_from")), F.col("position"))).over(in_run)
    spans = spans.withColumn("obj_to", F.coalesce(stop - 1, "_last")).select("document", "chapter", F.col("position").alias("_objection"), "obj_from", "obj_to")
    replies = m.filter("role = 'reply' AND _objection IS NOT NULL AND (_bar IS NULL OR _objection > _bar)").select("document", "chapter", "position", "_objection")
    return replies.join(spans, ["document", "chapter", "_objection"]).select("document", "chapter", "position", "obj_from", "obj_to")


def restored_results(saved: DataFrame, moves: DataFrame, visible: DataFrame) -> DataFrame:
    """(search, rank, passage, status) of a saved search: each passage as it is now; the first of those that became one stays.

    saved: (search, rank, passage); moves: (old_id, new_id); visible: (passage).
    """
    seen = visible.select("passage").distinct().withColumn("_v", F.lit(True))
    now = saved.join(moves.select(F.col("old_id").alias("passage"), "new_id"), "passage", "left")
    now = now.select("search", "rank", F.coalesce("new_id", "passage").alias("passage"), F.col("new_id").isNotNull().alias("_moved")).join(seen, "passage", "left")
    status = F.when(F.col("_v").isNull(), "gone").when(F.col("_moved"), "moved").otherwise("current")
    first = F.row_number().over(W.partitionBy("search", "passage").orderBy("rank"))
    return now.withColumn("_n", first).filter("_n = 1").select("search", "rank", "passage", status.alias("status"))
