"""Editorial operators on small hand-made rows; those that SQL can't express against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import curation, differences


def plain_chunks(text, size, shared):
    out, start = [], 0
    while start < len(text):
        stop = min(len(text), start + size)
        if stop < len(text):
            spaces = [i for i in range(start + 1, min(len(text), stop + 500)) if text[i] == " "]
            stop = spaces[-1] if spaces else stop
        out.append(text[start:stop].strip())
        if stop >= len(text):
            break
        start = stop - shared if stop - shared > start else stop
    out = [x for x in out if x]
    if shared == 0 and len(out) > 1 and len(out[-1]) < 40:
        out[-2:] = [out[-2] + " " + out[-1]]
    return out


def test_overlap_chunks_as_plain(spark):
    rng = random.Random(3)
    texts = ["", "one", "x" * 1500, "a " + "x" * 3000, "x" * 1190 + " tail"] + [" ".join("w" * rng.randint(1, 12) for _ in range(n)) for n in (5, 90, 400, 1200)]
    for size, shared in ((700, 60), (700, 0), (1, 0), (50, 49)):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", curation.overlap_chunks(F.col("t"), size, shared).alias("c"))
        assert {r.i: r.c for r in df.collect()} == {i: plain_chunks(t, size, shared) for i, t in enumerate(texts)}


def test_without_overlap_no_word_is_lost(spark):
    text = " ".join(f"w{i}" for i in range(900))
    cut = spark.createDataFrame([(text,), (None,)], "t string").select(curation.overlap_chunks(F.col("t"), 300).alias("c")).collect()
    assert " ".join(cut[0].c).split() == text.split() and cut[1].c == []


def test_footers(spark):
    """Endings that recur over a source's different texts go; copies, other sources and lines inside stay."""
    rows = [(i, "a", f"text {i}\nEnd  of page\n\n About us ") for i in range(3)] + [(3, "a", "END OF PAGE\nmore text"), (4, "b", "text\nEnd of page"), (5, "b", "same\nonly"), (6, "b", "same\nonly"), (7, "b", "same\nonly"), (8, "a", "about us"), (9, "a", None), (10, None, "x")]
    docs = spark.createDataFrame(rows, "id int, source string, text string")
    found = curation.recurring_endings(docs)
    assert {(r.source, r.line, r.n) for r in found.collect()} == {("a", "end of page", 4), ("a", "about us", 4)}
    got = {r.id: (r.text, r.cut) for r in curation.without_footers(docs, found).collect()}
    assert got[0] == ("text 0", 2) and got[3] == ("END OF PAGE\nmore text", 0) and got[4] == ("text\nEnd of page", 0) and got[7][1] == 0 and got[8] == ("", 1) and got[9] == (None, 0) and got[10] == ("x", 0)


@pytest.mark.parametrize("before,after,status,changed", [("a b c", None, "failed", None), ("a b c", " a b c ", "unchanged", 0), ("a b c", "a b d", "accepted", 1), ("a  b", "a b", "accepted", 0), ("a b c", "a x d", "too_many_words", None), ("a b", "a\n\nb", "paragraphs", None), (None, "", "unchanged", 0)])
def test_corrections(spark, before, after, status, changed):
    got = differences.corrections(spark.createDataFrame([(1, before, after)], "id int, before string, after string")).first()
    assert (got.status, got.changed) == (status, changed)


KINDS = [("The king", "the KING", "identical"), ("the king came", "the old king came", "restored"), ("his honour came", "his honor came", "spelling"), ("the bums of oldtestament and 12 so vl", "the burns of old testament and so vi", "misprint"), ("the king came", "the queen left", "substantive"), (None, "", "identical"), ("gone words", "", "substantive"), ("7", None, "misprint")]


@pytest.mark.parametrize("old,new,kind", KINDS)
def test_change_kinds(spark, old, new, kind):
    variants = spark.createDataFrame([("honour", "honor")], "word string, canonical string")
    assert differences.change_kinds(spark.createDataFrame([(1, old, new)], "id int, old string, new string"), variants).first().kind == kind


def test_change_kinds_bound_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, long, long + " " + long), (2, long, long.replace("w", "w1")), (3, long, long.replace("w77 ", "w7q "))]
    assert {r.id: r.kind for r in differences.change_kinds(spark.createDataFrame(rows, "id int, old string, new string")).collect()} == {1: "restored", 2: "substantive", 3: "misprint"}
    assert differences.change_kinds(spark.createDataFrame([], "id int, old string, new string")).count() == 0 == differences.corrections(spark.createDataFrame([], "id int, before string, after string")).count()


def test_hunks_are_least():
    rng = random.Random(9)
    for _ in range(400):
        a, b = (rng.choices("abc", k=rng.randrange(9)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        least, most = len(a) + len(b) - 2 * best[-1][-1], rng.randrange(12)
        got = differences.hunks(a, b, most)
        assert (got is None) == (least > most)
        if got is not None:
            assert sum(i2 - i1 + j2 - j1 for i1, i2, j1, j2 in got) == least
            out, at = [], 0
            for i1, i2, j1, j2 in got:
                out, at = out + a[at:i1] + b[j1:j2], i2
            assert out + a[at:] == b


def test_fragment_passes_over_numbers_and_headings(spark):
    rows = [("HEADING\nIn the beginning there was light upon the waters deep", "In the beginning there was light upon the"), ("one 2 three four five-", "three four five"), ("a 1 b", None), ("", None), (None, None)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", curation.fragment(F.col("t"))).collect()
    assert [r[1] for r in sorted(got)] == [w for _, w in rows]


def test_freeze_pairs_takes_nothing_twice(spark):
    cols = "id int, document int, unit int, anchor string, position int, content string"
    live = spark.createDataFrame([(1, 1, 0, "a", 0, "Amen."), (2, 1, 0, "b", 1, "Amen."), (3, 1, 1, "c", 2, "other words")], cols)
    built = spark.createDataFrame([(11, 1, 0, "x", 0, "amen"), (12, 1, 0, "b", 1, "Amen."), (13, 1, 1, "y", 2, "new text")], cols)
    got = {(r.live_id, r.built_id, r.method) for r in curation.freeze_pairs(live, built).collect()}
    assert got == {(2, 12, "anchor"), (1, 11, "text"), (3, 13, "unit")}


def test_text_holder_needs_one_best(spark):
    w = "a b c d e f g h i j"
    lost = spark.createDataFrame([(1, 1, w), (2, 2, w), (3, 1, "short")], "id int, document int, content string")
    built = spark.createDataFrame([(11, 1, f"x {w} y"), (12, 2, w), (13, 2, w)], "id int, document int, content string")
    assert {r.id: r.holder for r in curation.text_holders(lost, built).collect()} == {1: 11, 2: None, 3: None}


def test_reply_does_not_reach_the_article_before(spark):
    o, r, d = "objection", "reply", "determination"
    kinds = [(o, 1, False), (o, 1, False), (o, 1, True), (d, None, False), (r, 1, False), (o, 2, False), (d, None, False), (r, 1, False), (r, 2, False)]
    rows = spark.createDataFrame([(1, 1, i, *k) for i, k in enumerate(kinds)], "document int, chapter int, position int, role string, number int, opens_new boolean")
    got = {x.position: (x.obj_from, x.obj_to) for x in curation.stitch_replies(rows).collect()}
    assert got == {4: (0, 1), 8: (5, 5)}


def test_fix_must_stand_once(spark):
    p = spark.createDataFrame([(1, "a.c abc a.c"), (2, "teh end")], "id int, text string")
    f = spark.createDataFrame([(1, 1, "a.c", "x", "why"), (2, 2, "teh", "the", "why"), (3, 2, "teh", "the", " "), (4, 9, "q", "r", "why"), (5, 2, "", "r", "why")], "fix int, id int, find string, replace string, why string")
    assert {r.fix: (r.status, r.text) for r in curation.apply_fixes(p, f).collect()} == {1: ("not_once", None), 2: ("applied", "the end"), 3: ("no_reason", None), 4: ("no_passage", None), 5: ("not_once", None)}


def test_empty_tables(spark):
    p = spark.createDataFrame([], "id int, document int, content string")
    assert curation.text_holders(p, p).count() == 0
    assert curation.result_checks(spark.createDataFrame([], "query_id int, rank int, item int"), spark.createDataFrame([(1, 1, "none", 5)], "check_id int, query_id int, kind string, item int")).first().passed


def test_corrections_of_a_long_line(spark, tmp_path):
    """A line of 10,000 words is corrected and judged: places beyond whole numbers' squares count, and no word is looked for among all others."""
    from quillstone import catalog

    line = " ".join(f"w{i}" for i in range(10_000))
    spark.createDataFrame([(22, line, "en", "src0", len(line))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    row = catalog.QUERIES["corrections_judged"](spark, str(tmp_path)).first()
    ks = [(2_200_000 * 7 + i * i * 31) % 97 for i in range(1, 10_001)]
    runs = [0]
    for k in ks:
        if k == 1 or k > 3:
            runs.append(0)
        runs[-1] += k <= 3
    n = sum(runs)  # neighbours that all changed are one stretch, as long as its longer side
    assert (row.id, row.status, row.changed) == (2_200_000, "accepted", n) and n <= 500


def test_description_leak_at_every_offset(spark, tmp_path):
    """A run of 40 characters is found wherever it stands, 39 are not; a document of 100,000 characters takes one pass."""
    import random

    from quillstone import catalog

    r = random.Random(5)
    word = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    items = [(k, word(90)) for k in range(45)]
    docs = [(k, word(k) + t[7 : 7 + 40] + word(30)) for k, t in items] + [(100 + k, word(k) + t[7 : 7 + 39] + word(30)) for k, t in items] + [(200, word(100_000) + items[3][1][:40]), (201, items[4][1][50:]), (202, "short"), (203, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["description_leak"](spark, str(tmp_path))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    text = dict(docs)
    want = {(k, d) for k, t in items for d, x in text.items() if x and any(t[i : i + 40] in x for i in range(51))}
    assert {(x.item_id, x.doc_id) for x in got.collect()} == want and {(3, 200), (4, 201)} <= want


def test_changes_within_removed_spans(spark, tmp_path):
    """A line whose small letters all stand in what is taken out is changed too, as its SQL says."""
    import duckdb

    from quillstone import catalog

    lines = [f"A of some words. {k}" if k % 50 == 7 else f"Line {k}" for k in range(120)] + ["NO SMALL LETTERS"] * 50
    docs = [(1, "\n".join(lines)), (2, "\n".join(["X"] * 7 + ["STILL NONE"])), (3, "\n".join(["X"] * 7 + ["B of it, and more. C of that. D"]))]
    spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(r[0] for r in con.execute(catalog.ORACLES["unexplained_changes"]).fetchall())
    assert sorted(x.id for x in catalog.QUERIES["unexplained_changes"](spark, str(tmp_path)).collect()) == want == [100007, 100057, 100107, 300007]
