"""Packing, forward matching, brackets and assembly on small hand-made rows, against plain versions."""

import random

from quillstone.operators import curation, ranking, units


def test_packed_units(spark):
    """No unit up to the cap is cut; pieces keep to the cap; joined parts are the text."""
    r = random.Random(2)
    rows = [(d, i, f"§{i}", " ".join("w" * r.randint(1, 9) for _ in range(r.choice([1, 5, 30, 120])))) for d in range(3) for i in range(25)] + [(9, 0, "x", "y" * 500), (9, 1, None, " "), (9, 2, None, None), (9, 3, None, "end")]
    got = units.packed(spark.createDataFrame(rows, "document int, unit int, label string, text string"), 100).collect()
    text = {(d, u): t for d, u, _, t in rows if t and t.strip()}
    parts, held = {}, {}
    for x in sorted(got, key=lambda x: (x.document, x.unit, x.part)):
        parts.setdefault((x.document, x.unit), []).append(x.text)
        held.setdefault((x.document, x.piece), []).append(x.text)
    assert parts.keys() == text.keys() and all("".join("".join(p).split()) == "".join(text[k].split()) for k, p in parts.items())
    assert all(len(p) == 1 for k, p in parts.items() if len(text[k]) <= 100) and all(len("\n\n".join(h)) <= 100 for h in held.values())
    assert all(len("\n\n".join(held[d, p] + held[d, p + 1][:1])) > 100 for d, p in held if (d, p + 1) in held)


def test_pieces_tell_labels_and_openings(spark):
    rows = [(1, 0, "a", "one two"), (1, 1, "b", "x" * 15), (1, 2, "c", "end")]
    got = {r.piece: (r.first, r.last, r.opens, r.text) for r in units.pieces(units.packed(spark.createDataFrame(rows, "document int, unit int, label string, text string"), 10)).collect()}
    assert got == {0: (0, 0, True, "one two"), 1: (1, 1, True, "x" * 10), 2: (1, 2, False, "xxxxx\n\nend")}


def test_matched_forward_never_goes_back(spark):
    w = lambda s, n=9: " ".join(f"{s}{i}" for i in range(n))
    us = [(1, 0, w("a")), (1, 1, w("b")), (1, 2, w("a")), (1, 3, "short one"), (1, 4, w("c") + " " + w("d")), (1, 200, w("e"))]
    ps = [(1, 0, w("b")), (1, 1, w("a") + " more"), (1, 2, "nothing like it in there at all"), (1, 3, "Short one!"), (1, 4, w("d")), (1, 5, w("a")), (1, 6, w("e")), (2, 0, w("a")), (1, 7, "")]
    got = {(r.document, r.position): (r.unit, r.at_start) for r in units.matched_forward(spark.createDataFrame(ps, "document int, position int, content string"), spark.createDataFrame(us, "document int, unit int, text string")).collect()}
    assert got == {(1, 0): (1, True), (1, 1): (2, True), (1, 2): (None, None), (1, 3): (3, True), (1, 4): (4, False), (1, 5): (None, None), (1, 6): (None, None), (1, 7): (None, None), (2, 0): (None, None)}


def test_brackets_nest_and_rebuild(spark):
    texts = ["a [b (c [d] e) f] g", "[1] kept [ 22 ] too", "open [ not (closed", "] early [x]", "[a (b] c)", "", None, "[[[x]]] y", "(a [b) c] d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    done = curation.without_brackets(rows)
    got = {r.id: (r.text, [tuple(x) for x in r.removed], [tuple(x) for x in r.odd]) for r in done.collect()}
    assert got[0] == ("a  g", [(2, "[b (c [d] e) f]")], []) and got[1] == (texts[1], [], []) and got[2] == (texts[2], [], [(5, "["), (11, "(")])
    assert got[3] == ("] early ", [(8, "[x]")], [(0, "]")]) and got[4] == (" c)", [(0, "[a (b]")], [(3, "("), (8, ")")]) and got[5] == ("", [], []) and got[6] == (None, [], []) and got[7][0] == " y"
    assert got[8] == (texts[8], [], [(3, "["), (8, "]")])
    log = done.selectExpr("id", "explode(removed) AS r").select("id", "r.start", "r.span")
    assert curation.changes_unexplained(rows, done, log).count() == 0
    other = done.selectExpr("id", "CASE WHEN id = 3 THEN 'other' ELSE text END AS text")
    assert [r.id for r in curation.changes_unexplained(rows, other, log).collect()] == [3]


def test_assembled_spans_once(spark):
    passages = spark.createDataFrame([(1, 0, i, f"p{i}" if i != 4 else " ") for i in range(200)], "document int, chapter int, position int, content string")
    results = spark.createDataFrame([(1, 1, 0, 3), (2, 1, 0, 150), (3, 9, 0, 0)], "id int, document int, chapter int, position int")
    spans = spark.createDataFrame([(1, 1, 0, 2, 5), (1, 1, 0, 5, 6), (1, 1, 0, 9, 9), (2, 1, 0, 60, 70)], "id int, document int, chapter int, first int, last int")
    got = {r.id: (r.first, r.last, r.n, r.text) for r in ranking.assembled(results, spans, passages).collect()}
    assert got[1] == (2, 9, 5, "p2\n\np3\n\np5\n\np6\n\np9") and got[2][:3] == (60, 150, 12) and got[3] == (None, None, 0, None)


def test_matched_forward_sends_no_runs_out(spark):
    """The runs of a small table are many; no join sends them through the driver."""
    rows = [(d, k, f"some words of line {k} in document {d} stand here") for d in range(3) for k in range(8)]
    got = units.matched_forward(spark.createDataFrame(rows, "document int, position int, content string"), spark.createDataFrame(rows, "document int, unit int, text string"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.document, r.position, r.unit, r.at_start) for r in got.collect()) == [(d, k, k, True) for d, k, _ in rows]
