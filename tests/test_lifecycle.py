"""What saved passages and links show, on small hand-made rows."""

from quillstone.operators import lifecycle, saved

MOVES = "entity string, old_id long, new_id long, kind string"
STONES = "entity string, id long, reason string"


def tables(spark):
    passages = [(i, d, f"a{i}", f"c{d}", r) for i, d, r in [(1, 1, False), (2, 1, True), (3, 1, True), (4, 1, True), (5, 1, True), (6, 1, True), (7, 1, True), (8, 2, False), (9, 2, True), (10, 3, True), (11, 1, True), (12, 4, True)]]
    docs = [(1, False), (2, True), (3, True), (4, True), (5, False)]
    moves = [("passage", 2, 1, "moved"), ("passage", 3, 2, "merged"), ("passage", 4, 3, "moved"), ("passage", 5, 4, "moved"), ("passage", 6, 7, "moved"), ("passage", 11, 11, "moved"), ("document", 2, 5, "edition"), ("document", 4, 3, "edition")]
    stones = [("passage", 7, "out"), ("document", 3, "whole"), ("passage", 5, "late")]
    return (spark.createDataFrame(passages, "id long, document long, anchor string, chapter string, retired boolean"), spark.createDataFrame(docs, "document long, retired boolean"), spark.createDataFrame(moves, MOVES), spark.createDataFrame(stones, STONES))


def test_every_status(spark):
    p, d, m, t = tables(spark)
    asked = spark.createDataFrame([(i,) for i in [*range(1, 13), 1, 99]], "id long")
    got = {r.id: (r.status, r.target, r.target_document, r.reason) for r in lifecycle.passage_status(asked, p, d, m, t).collect()}
    assert got == {
        1: ("current", None, None, None), 2: ("moved", 1, None, None), 3: ("moved", 1, None, None), 4: ("moved", 1, None, None),  # up to three moves
        5: ("removed", None, None, "late"), 6: ("removed", None, None, "out"), 7: ("removed", None, None, "out"),  # a fourth is not made
        8: ("moved", None, 5, None), 9: ("moved", None, 5, None), 10: ("removed", None, None, "whole"), 11: ("kept", None, None, None), 12: ("removed", None, None, "whole"),
    }


def test_locations(spark):
    p, d, m, t = tables(spark)
    sent = spark.createDataFrame([("anchor", 9, "x", 1, "y", "moved"), ("anchor", 1, "y", 1, "a1", "moved"), ("anchor", 9, "z", 9, "w", "moved"), ("anchor", 9, "v", 1, "a6", "moved"), ("chapter", 9, "x", 1, "c1", "moved")], "entity string, old_document long, old_key string, new_document long, new_key string, kind string")
    asked = spark.createDataFrame([(1, "anchor", 1, "a1"), (2, "anchor", 9, "x"), (3, "anchor", 9, "z"), (4, "anchor", 9, "v"), (5, "anchor", 1, "a2"), (6, "chapter", 9, "x"), (7, "anchor", 9, "?"), (8, "anchor", 1, None)], "request long, entity string, document long, key string")
    got = {r.request: (r.status, r.document, r.key, r.target, r.reason) for r in lifecycle.location_status(asked, p, d, sent, m, t).collect()}
    assert got == {1: ("current", 1, "a1", None, None), 2: ("moved", 1, "a1", None, None), 3: ("moved", 9, "w", None, None), 4: ("removed", 1, "a6", None, "out"), 5: ("moved", 1, "a2", 1, None), 6: ("moved", 1, "c1", None, None), 7: ("unknown", 9, "?", None, None), 8: ("unknown", 1, None, None, None)}


def test_restored_lists_show_a_passage_once(spark):
    p, d, m, t = tables(spark)
    saved = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (1, 3, 7), (1, 4, 6), (1, 5, 99), (2, 1, 1)], "search long, rank int, passage long")
    got = sorted((r.search, r["rank"], r.status, r.shown) for r in lifecycle.restored(saved, lifecycle.passage_status(saved.selectExpr("passage AS id"), p, d, m, t)).collect())
    assert got == [(1, 1, "moved", 1), (1, 3, "removed", None), (1, 4, "removed", None), (2, 1, "current", 1)]


def test_bookmarks_begin_anew_after_a_delete(spark):
    held = spark.createDataFrame([(1, 1, "old", 5), (1, 2, "kept", 6), (2, 1, None, 7)], "user int, passage int, note string, created long")
    changes = spark.createDataFrame([(1, 1, 1, 10, "put", None), (1, 2, 2, 11, "delete", None), (1, 2, 3, 12, "put", "new"), (2, 1, 4, 13, "put", "first"), (2, 1, 5, 13, "put", "second"), (3, 9, 6, 14, "delete", None), (4, 1, 7, 15, "put", "x"), (4, 1, 8, 16, "delete", None)], "user int, passage int, seq int, at long, action string, note string")
    got = {(r.user, r.passage): (r.note, r.created) for r in saved.bookmarks_after(held, changes).collect()}
    assert got == {(1, 1): ("old", 5), (1, 2): ("new", 12), (2, 1): ("second", 7)}
    assert saved.bookmarks_after(held.limit(0), changes.limit(0)).count() == 0


def test_deleting_searches_cascades(spark):
    searches = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "search int, user int")
    rest = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "search int, x string")
    a, b, c = saved.without_searches(spark.createDataFrame([(1, 1), (1, 1), (2, 1), (9, 9)], "search int, user int"), searches, rest, rest)
    assert {r.search for r in a.collect()} == {2, 3} and {r.x for r in b.collect()} == {"b", "c", "d"} and {(r.search, r.x) for r in c.collect()} == {(None, "a"), (2, "b"), (3, "c"), (None, "d")}
