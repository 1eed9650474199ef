"""Scanned pages on small hand-made rows."""

from quillstone.operators import scans


def test_furniture_recurs(spark):
    rows = [(1, p, i, t) for p in range(3) for i, t in enumerate([f"Book One {p}", "body text", str(p + 10)])] + [(2, 0, 0, "Book One 1"), (2, 0, 1, "end")]
    got = {(r.document, r.page, r.line): r.kind for r in scans.furniture(spark.createDataFrame(rows, "document int, page int, line int, text string")).collect()}
    assert got == {(1, p, i): k for p in range(3) for i, k in ((0, "running_head"), (2, "page_number"))}


def test_mended_keeps_true_hyphens(spark):
    rows = [(1, 0, 0, "the begin-"), (1, 0, 1, "ning of Jean-"), (1, 0, 2, "Paul"), (1, 1, 0, "ends with -")]
    got = {r.paragraph: (r.lines, r.text) for r in scans.mended(spark.createDataFrame(rows, "document int, paragraph int, line int, text string")).collect()}
    assert got == {0: (3, "the beginning of Jean- Paul"), 1: (1, "ends with -")}


def test_reading_order_of_bands_and_columns(spark):
    boxes = [(1, 1, 0.0, 10.0, 0.0), (1, 2, 5.5, 10.0, 1.0), (1, 3, 0.0, 4.5, 2.0), (1, 4, 5.5, 10.0, 2.0), (1, 5, 0.0, 10.0, 3.0), (1, 6, 0.0, 4.0, 4.0), (2, 7, 1.0, 1.0, 0.0)]
    got = scans.reading_order(spark.createDataFrame(boxes, "page int, id int, x0 double, x1 double, y double")).collect()
    assert [r.id for r in sorted(got, key=lambda r: (r.page, r.place))] == [1, 3, 2, 4, 5, 6, 7]


def page(number, columns, rows, heads=()):
    """Lines set in columns of 100 units; heads run across above the row of their number."""
    n, out = 0, []
    for a, b in zip([0, *heads], [*heads, rows]):
        if a in heads:
            out.append((number, n, 3.0, columns * 100.0 - 25, a * 10.0 - 5))
            n += 1
        for c in range(columns):
            for r in range(a, b):
                out.append((number, n, c * 100.0 + r % 3, c * 100.0 + 80 + r % 7, r * 10.0 + c % 2))
                n += 1
    return out


BOX = "page int, id int, x0 double, x1 double, y double"


def test_columns_are_found(spark):
    """One to four columns, with and without headings across, and a stray mark in a gutter."""
    pages = [page(1, 1, 9), page(2, 2, 9), page(3, 3, 9, (4,)), page(4, 4, 12), page(5, 2, 12, (3, 7)), [*page(6, 3, 12), (6, 900, 92.0, 99.0, 300.0)]]
    got = scans.reading_order(spark.createDataFrame([b for p in pages for b in p], BOX)).collect()
    for n, p in enumerate(pages, 1):
        mine = [r.id for r in sorted((r for r in got if r.page == n and r.id < 900), key=lambda r: r.place)]
        assert mine == [b[1] for b in p if b[1] < 900]
        assert len({r.column for r in got if r.page == n} - {-1}) == [1, 2, 3, 4, 2, 3][n - 1]


def test_ragged_edges_are_no_gutters(spark):
    """One of ten lines reaches beyond its column's others, on the outer side, and a heading reaches further still."""
    right = [*page(1, 2, 5)[:-1], (1, 9, 100.0, 189.0, 41.0), (1, 20, 3.0, 195.0, 25.0)]
    left = [(2, i, 200 - x1, 200 - x0, y) for _, i, x0, x1, y in right]
    got = scans.reading_order(spark.createDataFrame(right + left, BOX)).collect()
    columns = {(r.page, r.id): r.column for r in got}
    assert columns == {(p, i): -1 if i == 20 else (i > 4) != (p == 2) for p in (1, 2) for i in [*range(10), 20]}


def test_parallel_and_stacked(spark):
    both = page(1, 2, 6, (3,))
    df = spark.createDataFrame(both, BOX)
    ids = lambda keep: [r.id for r in sorted(scans.reading_order(df, keep).collect(), key=lambda r: r.place)]
    across = [b[1] for b in both if b[3] - b[2] > 150]
    assert ids("left") == [b[1] for b in both if b[2] < 50] and ids("right") == [b[1] for b in both if b[2] > 50 or b[1] in across]
    stacked = spark.createDataFrame([(1, i, 0.0, 90.0, i * 10.0 + (25 if i > 4 else 0)) for i in range(10)], BOX)
    assert [r.id for r in sorted(scans.reading_order(stacked, "lower").collect(), key=lambda r: r.place)] == [5, 6, 7, 8, 9]


LINE = "document int, page int, line int, x0 double, x1 double, y double, text string"


def test_notes_marked_carried_and_none(spark):
    """A marked block, one that goes on over the page, a gap without a marker, and a page of even lines."""
    body = lambda p, n: [(1, p, i, 0.0, 100.0, i * 10.0, f"Line {i}") for i in range(n)]
    notes = lambda p, n, first: [(1, p, 50 + i, 0.0, 95.0, 116.0 + i * 6, first if i == 0 else "more of it") for i in range(n)]
    rows = body(1, 11) + notes(1, 3, "* See above") + body(2, 11) + notes(2, 2, "went on here") + body(3, 11) + notes(3, 2, "Body after a gap") + body(5, 12)
    got = {(r.page, r.line): r.note for r in scans.note_blocks(spark.createDataFrame(rows, LINE)).collect()}
    assert {k for k, v in got.items() if v} == {(1, 50), (1, 51), (1, 52), (2, 50), (2, 51)} and len(got) == len(rows)


def test_paragraphs_cross_pages(spark):
    rows = [(1, 1, 0, 5.0, 100.0, 0.0, "First one"), (1, 1, 1, 0.0, 100.0, 10.0, "goes on"), (1, 1, 2, 0.0, 100.0, 20.0, "to the un-"), (1, 2, 0, 5.0, 100.0, 0.0, "broken end"), (1, 2, 1, 0.0, 60.0, 10.0, "of it."), (1, 2, 2, 0.0, 100.0, 20.0, "Second one"), (1, 2, 3, 0.0, 100.0, 30.0, "and on"), (2, 1, 0, 0.0, 90.0, 0.0, "other")]
    got = {(r.document, r.page, r.line): r.paragraph for r in scans.paragraph_starts(spark.createDataFrame(rows, LINE)).collect()}
    assert [got[1, *k] for k in ((1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3))] == [1, 1, 1, 1, 1, 2, 2] and got[2, 1, 0] == 1


def test_empty(spark):
    assert scans.reading_order(spark.createDataFrame([], BOX)).count() == 0 == scans.note_blocks(spark.createDataFrame([], LINE)).count()
    assert scans.furniture(spark.createDataFrame([], "document int, page int, line int, text string")).count() == 0
