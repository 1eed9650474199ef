"""Reversed search against a plain scorer."""

import math
import random
import re
from collections import Counter

import pytest

from quillstone.llm import reversed as rev

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    toks = [(d, Counter(cut(t))) for d, t in docs]
    toks = [(d, c) for d, c in toks if c]
    n, length = len(toks), sum(sum(c.values()) for _, c in toks)
    df = Counter(t for _, c in toks for t in c)
    held = {}
    for i, t in items:
        held.setdefault(i, set()).update(cut(t))
    out = []
    for i, ts in held.items():
        scored = []
        for d, c in toks:
            m = 10 + 90 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def got(docs, items, **more):
    return sorted((tuple(r) for r in rev.search(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def pairs(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_given_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert got(docs, items) == want and got(docs.repartition(7), items, block_bytes=3000) == want


def test_awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, clashing columns, other letters and controls."""
    r = random.Random(5)
    docs = [(1, None, 0, 0), (2, "", 0, 0), (3, "...", 0, 0), (None, "alpha beta", 0, 0), (4, "alpha beta", 0, 0), (4, "alpha beta", 0, 0), (5, "ALPHA\x00beta Ünder über   naïve", 0, 0), (6, "gamma " * 50_000 + "ÄPFEL", 0, 0)]
    docs += [(100 + i, " ".join(r.choices(["alpha", "beta", "gamma", "delta", "x1", "Äpfel"], k=r.randrange(1, 9))), 0, 0) for i in range(80)]
    items = [(1, "Alpha, beta!", 0, 0), (2, None, 0, 0), (3, "?!", 0, 0), (4, "nowhere", 0, 0), (5, "gamma gamma delta Äpfel ÄPFEL", 0, 0), (6, "x1", 0, 0), (6, "delta", 0, 0), (None, "beta", 0, 0), (7, "beta", 0, 0), (7, "beta", 0, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n long, item long")
    i = spark.createDataFrame(items, "item_id long, text string, rank long, part long")
    want = plain([x[:2] for x in docs], [x[:2] for x in items])
    assert got(d.repartition(6), i) == want and got(d, i, block_bytes=10) == want and got(d, i, top=3) == plain([x[:2] for x in docs], [x[:2] for x in items], 3)


@pytest.mark.parametrize("which", ["docs", "items", "both"])
def test_empty(spark, which):
    docs = spark.createDataFrame([] if which != "items" else [(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([] if which != "docs" else [(1, "a")], "item_id long, text string")
    assert got(docs, items) == []
