"""Prefix trie against a plain enumeration of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, d long, hi long"


def rebuilt(rows):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            role, text = r[2] or "", r[3] or ""
            sym = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[r[0]].append(((r[1] is not None, r[1] or 0, sym), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain(rows):
    members = defaultdict(list)
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))) for p, m in members.items()}
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()),
        key=repr,
    )


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df, **more):
    return sorted((tuple(r[n] for n in NAMES) for r in trie.prefix_trie(df, **more).collect()), key=repr)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert got(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_awkward(spark):
    """Null and equal turns, null roles and texts, repeated rows, gaps in ids, copies, nested ends, clashing columns."""
    r = random.Random(3)
    rows = [(None, 1, "user", "nobody", 1, 1), (7, None, None, None, 1, 1), (7, None, "", "é" * 5000, 1, 1), (7, 1, "user", "same", 1, 1), (7, 1, "user", "same", 1, 1), (7, 1, "assistant", "tie", 1, 1)]
    for c in range(10, 70):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", r.choice("ab"), 1, 1) for t in range(r.randrange(1, 14))]
    for c in range(100, 160):  # copies and prefixes of one long conversation
        rows += [(c, t, "user", f"turn {t}", 1, 1) for t in range(r.choice([3, 20, 20, 41]))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows)
    assert got(df) == want and got(df, batches=1) == want and got(df, batches=5) == want


def test_blocks(spark, monkeypatch):
    """Blocks far shorter than the conversations give the same rows."""
    monkeypatch.setattr(trie, "BLOCK", 4)
    r = random.Random(4)
    rows = [(c, t, "user", r.choice("aab"), 0, 0) for c in range(30) for t in range(r.randrange(1, 40))]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("f", trie.two_fattest(F.col("a"), F.col("b")))
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in df.collect())


def test_joined_digest(spark):
    """A key of many values is hashed from pieces of several ranges."""
    rows = [(1, i) for i in range(20000)] + [(2, 5), (2, 1), (3, 9)]
    out = dict(map(tuple, trie.joined_digest(spark.createDataFrame(rows, "k long, v long").repartition(7), "k", "v", 100).collect()))
    want = {k: hashlib.sha256(",".join(str(v) for kk, v in sorted(rows) if kk == k).encode()).hexdigest() for k in (1, 2, 3)}
    assert out == want


@pytest.mark.parametrize("batches", [2])
def test_long(spark, batches):
    rows = [(c, t, "user", f"t{t if t < 600 * c or t % 2 else -c}", 0, 0) for c in range(1, 4) for t in range(1500)]
    assert got(spark.createDataFrame(rows, SCHEMA), batches=batches) == plain(rows)
