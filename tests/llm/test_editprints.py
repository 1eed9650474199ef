"""Edit-distance fingerprints against plain walks and plain edit distances."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import editprints as ep

SF = "/root/testdata/sf0.001"


def plain_print(text):
    """Step by step, as the walk is defined."""
    wait, steps, salts, _ = ep.tables()
    at, left, seen = 0, 0, []
    kinds = ep.classes(ep.codes(text))
    for step in range(10 * len(text) + 10):
        if left == 0:
            if at == len(text):
                break
            left, c = wait[kinds[at]][step % ep.PERIOD], ord(text[at])
            at += 1
        seen.append(c)
        left -= 1
    return bytes(((seen[s] + 1) * int(k) * 0x9E3779B97F4A7C15 % 2**64) >> 56 for s, k in zip(steps, salts, strict=True) if s < len(seen))


def plain(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = []
    for (i, t), (_, o) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + o[:half]
        a, b, c = map(plain_print, (t, e, o))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), ep.likeness(a, b), ep.likeness(a, c)))
    return sorted(out)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in ep.compared(df).collect()), key=lambda r: (r[0] is None, r))


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    out = got(df)
    assert out == plain(rows) and got(df.repartition(7)) == out
    told = [r for r in out if r[1] >= 20]
    assert sum(r[5] > r[6] for r in told) >= 0.97 * len(told)  # copies may come next to each other


def test_awkward(spark):
    """Null, empty, short and very long texts, repeated rows, null ids, clashing columns."""
    rows = [(9, None, 1), (8, "", 1), (7, "x", 1), (6, "ab", 1), (5, "z" * 200_000, 1), (4, "über café \U0001f600 中文" * 9, 1), (3, "same", 1), (3, "same", 1), (None, "nobody's", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, edge int")
    out = got(df)
    assert [r[0] for r in out] == [3, 3, 4, 5, 6, 7, 8, 9, None] and out[0][1:] != out[1][1:]
    by = {r[0]: r for r in out}
    assert by[9][1:4] == (0, hashlib.sha256(b"").hexdigest(), "") and by[9][5] == by[9][6] == 1.0
    assert by[None][2] == hashlib.sha256("nobody's"[:4].encode()).hexdigest()  # the next one is 9's null text
    assert by[6][2] == hashlib.sha256(b"az").hexdigest() and by[7][5] == 1.0
    assert got(spark.createDataFrame(rows[:1], df.schema))[0][5:] == (1.0, 1.0) and got(df.limit(0)) == []


def test_many_ranges(spark):
    """Ranges of one row, and more ranges than rows."""
    rows = [(i, f"text {i} " * (i % 5 + 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in ("60", "3"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert got(df) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        was, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
    return row[-1]


def edit(r, text, n):
    t = list(text)
    for _ in range(n):
        at, how = r.randrange(len(t) + 1), r.randrange(3)
        if how == 0 or at == len(t):
            t.insert(at, r.choice("abcdefgh "))
        elif how == 1:
            del t[at]
        else:
            t[at] = r.choice("abcdefgh ")
    return "".join(t)


def test_edit_distance():
    r = random.Random(1)
    for _ in range(300):
        a = "".join(r.choices("ab", k=r.randrange(0, 30)))
        b = edit(r, a, r.randrange(0, 8)) if r.random() < 0.7 else "".join(r.choices("ab", k=r.randrange(0, 30)))
        d, k = plain_distance(a, b), r.randrange(0, 10)
        assert ep.edit_distance(ep.codes(a), ep.codes(b), k) == (d if d <= k else None)


@pytest.mark.parametrize("seed", [2])
def test_near_texts(spark, seed):
    """Planted edits of various lengths: pairs are exact, and nearly all are found (at least 0.95)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(2, 9)))
    texts = []
    for n in (4, 12, 40, 120, 400):
        for _ in range(6):
            base = " ".join(word() for _ in range(n))
            texts += [base, base, *(edit(r, base, r.randrange(1, 13)) for _ in range(4))]
    df = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")
    found, classes = ep.near_texts(df, F.col("doc_id") % 6 == 0)
    rep = {}
    for i, t in enumerate(texts):
        rep.setdefault(t, i)
    want = {}
    for a in {rep[t] for i, t in enumerate(texts) if i % 6 == 0}:
        for b in rep.values():
            x, y = texts[a], texts[b]
            if a != b and abs(len(x) - len(y)) <= 16:
                d = plain_distance(x, y) if max(len(x), len(y)) < 300 else ep.edit_distance(ep.codes(x), ep.codes(y), 16)
                if d is not None and d <= min(16, max(len(x), len(y)) // 5):
                    want[a, b] = d
    out = {(p.query_id, p.doc_id): p.distance for p in found.collect()}
    assert out.items() <= want.items() and len(out) >= 0.95 * len(want) and len(want) > 100
    told = dict(map(tuple, classes.collect()))
    assert len(told) == len(texts) + 2 and all(told[i] == rep[t] for i, t in enumerate(texts)) and told[900] == told[901] == 900


def test_likeness():
    assert ep.likeness(b"", b"") == 1 and ep.likeness(b"a", b"") == 0 and ep.likeness(b"abcd", b"abxd") == 0.75
    r = np.random.default_rng(1)
    t = "".join(map(chr, r.integers(97, 123, 3000)))
    a, b = ep.prints([t, edit(random.Random(3), t, 8)])
    assert ep.likeness(a.bytes, b.bytes) > 0.6


def test_walks_side_by_side(monkeypatch):
    """Groups, single texts and blocks of a long text give the same bytes."""
    r = random.Random(6)
    texts = ["".join(r.choices("abc é\U0001f600", k=r.choice([0, 1, 2, 30, 300, 900]))) for _ in range(60)]
    want = [(p.bytes, p.half) for p in ep.prints(texts)]
    assert [w[0] for w in want] == list(map(plain_print, texts))
    assert [(p.bytes, p.half) for t in texts for p in ep.prints([t])] == want
    monkeypatch.setattr(ep, "LONG", 7)
    assert [(p.bytes, p.half) for p in ep.prints(texts)] == want
