"""Cases in which an operator once did less than the whole job."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import ann, decontam, neardup, secret_scan, simhash

SF = "/root/testdata/sf0.01"


def components(ids, near):
    root = {i: i for i in ids}
    for i, j in near:
        a, b = root[i], root[j]
        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    return root


def alike(texts, k=5):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}
    return [(i, j) for i, j in itertools.combinations(texts, 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def grouping(pairs):
    by = {}
    for i, g in pairs:
        by.setdefault(g, set()).add(i)
    return {frozenset(x) for x in by.values()}


def test_near_dedup_recall(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    near = alike(texts)
    assert any(texts[i] != texts[j] for i, j in near)
    want = components(texts, near)
    assert {r.doc_id for r in corpus_pipeline.dedup(spark, docs, SF).collect()} == {i for i, g in want.items() if i == g}


def test_near_dedup_mixed_bands(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts, base = {}, []
    for g in range(4):  # drifting chains over a common stem: bands hold near, far and middling texts
        base = (base or r.choices(words, k=150))[:90] + r.choices(words, k=60)
        now = list(base)
        for i in range(12):
            now[r.randrange(len(now))] = r.choice(words)
            texts[g * 100 + i] = " ".join(now)
    texts |= {900: "", 901: None, 902: "one two", 903: "One  two", 904: "one three"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    from pyspark.sql import functions as F

    got = neardup.groups(docs, ["doc_id"], digest=F.xxhash64("text")).collect()
    assert grouping((x.doc_id, x.root) for x in got) == grouping(components(texts, alike(texts)).items())
    assert neardup.groups(docs.limit(0), ["doc_id"], digest=F.xxhash64("text")).count() == 0


def test_near_dedup_sends_links_not_pairs():
    """A block of many middling and near texts gives fewer links than roots, and the brute-force groups."""
    r = random.Random(5)
    base, texts = [f"v{i}" for i in range(200)], {}
    for i in range(150):
        now = list(base)
        for _ in range(r.choice((1, 2, 9))):
            now[r.randrange(200)] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(now)
    sets = [neardup.shingles(t, 5) for t in texts.values()]
    side = (np.arange(150), np.arange(150), np.stack([neardup.signature(s).astype(np.uint16) for s in sets]), sets)
    links = [x for band in range(neardup.BANDS) for x in neardup.joining(side, side, band, 0.8)]
    assert grouping(components(texts, links).items()) == grouping(components(texts, alike(texts)).items())
    assert all(len(list(neardup.joining(side, side, band, 0.8))) < 150 for band in range(neardup.BANDS))


TRAIN = "When a train leaves Boston at 40 km per hour how long does it take to cover 120 km of track without a stop"
PEARS = "3 pears cost 4 dollars in town, 6 pears cost 8 dollars in town, 9 pears cost 12 dollars in town, so say what 3 pears and 9 pears cost"
GIFTS = "they say that Anna gave 5 apples to Tom and then Tom gave some apples back to Anna before lunch was made by Anna for Tom"


def holds(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}


def changed(text, **by):
    return " ".join(by.get(w.strip(",."), w) if w.strip(",.").isalpha() else by.get("n" + w, w) for w in text.split())


def test_decontamination_many_places(spark):
    again = [changed(TRAIN, n40=str(50 + i), n120=str(700 + i), Boston="Dover") for i in range(6)]
    other = changed(PEARS, n3="5", n4="7", n6="11", n8="13", n9="17", n12="19")
    torn = changed(TRAIN, n40="51", n120="333").replace("how long", "how very long")
    texts = [f"{TRAIN}. and {again[0]}", ". and ".join([*again, TRAIN, *again]), ". so ".join(again), f"first {PEARS} then", f"first {other} then", f"{torn}. and " + ". and ".join(again)]
    texts += [changed(GIFTS, Anna="Eve", Tom="Max"), "they say that Eve gave 5 apples to Max and then Ida gave some apples back to Leo before lunch was made by Ben for Kim"]
    got = holds(spark, texts, [TRAIN, PEARS, GIFTS])
    assert got == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 0), (6, 2)}


def test_decontamination_names_and_blanks(spark):
    item = "Karla bought pens and paper at the shop. Peter bought rather more of them. Maria then paid for all that they had"
    again = item.replace("Karla", "Ines").replace("Peter", "Boris").replace("Maria", "Olga")
    texts = [
        f"well {again} indeed", TRAIN.lower(), TRAIN.replace(" Boston", "\nBoston"), TRAIN.replace(" Boston", "  Boston").upper(), again.replace("Boris", "\n  Boris"),
        "he said: Call me Ishmael! and left", "call me later", "Call Me\tIshmael", "I was there at 42", "Olga went home. Boris did not.",
    ]
    got = holds(spark, texts, [item, TRAIN, "Call me Ishmael", "42"])
    assert got == {(0, 0), (4, 0), (1, 1), (2, 1), (3, 1), (5, 2), (7, 2)}


def test_decontamination_names_in_any_case(spark):
    """An item asked again with other names and numbers is found in capitals and in small letters; other questions aren't."""
    item = "Karla bought 12 pens and some paper at the shop on the corner. Peter then bought rather more of them than all the others had. Karla paid 12 coins for all that they had taken away"
    again = changed(item.replace("Karla", "Ines").replace("Peter", "Boris"), n12="31")
    torn = changed(again, n31="31", n12="77").replace("paid 31", "paid 90")
    other = "ines went to the shop on the corner and bought 31 pens. boris then ran away with all the paper that they had"
    texts = [again, again.lower(), again.upper(), f"so {again.lower()} and so on", other, torn.lower(), "", None]
    assert holds(spark, texts, [item]) == {(0, 0), (1, 0), (2, 0), (3, 0)}


def test_language_stage_rejects_noise(spark):
    """Random letters, other scripts and one word over and over go; every document of the table that has prose stays."""
    import corpus_pipeline

    r = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = ["".join(r.choices(letters, k=300)), " ".join("".join(r.choices(letters, k=6)) for _ in range(60)), "漢字" * 100, "zzz " * 200, "".join(r.choices("0123456789abcdef", k=400)), "привет мир " * 20]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10_000_000 + i, t, None, "noise", len(t)) for i, t in enumerate(noise)], docs.schema)
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(more), SF).collect()}
    assert got == {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_dedup_long_texts_and_copies(spark, monkeypatch):
    """Blocks of few hashes: long near copies, and many copies of one text, still fall into one group each."""
    from quillstone.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK_HASHES", 500)
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    near = [" ".join(base[: 40 * i] + ["other"] + base[40 * i + 1 :]) for i in range(1, 30)]
    rows = [(i, t) for i, t in enumerate(near)] + [(100 + i, "the same text over and over again") for i in range(300)] + [(500, " ".join(reversed(base)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.groups(docs, ["doc_id"], digest=F.xxhash64("text")).collect()
    roots = {}
    for x in got:
        roots.setdefault(x.root, set()).add(x.doc_id)
    assert sorted(map(len, roots.values())) == [1, 29, 300]


def test_ann_extreme_magnitudes(spark):
    """Vectors whose squares leave double precision take part like all others."""
    r = np.random.default_rng(3)
    rows = [(i, (r.standard_normal(4) * 1e200).tolist()) for i in range(12)] + [(100, [5e-324, 0.0, 0.0, 0.0]), (101, [1e-200, 2e-200, 0.0, 0.0]), (200, [1.0, 2.0, 3.0, 4.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=14).collect()
    at = dict(rows)
    assert len(got) == 3 * 14
    for x in got:
        a, b = (np.array(at[i], dtype=np.longdouble) for i in (x.query_id, x.vec_id))
        assert x.score == pytest.approx(float(np.sqrt(((a - b) ** 2).sum())), rel=1e-12)
    for q in (0, 100, 200):
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)
        assert [(x.score, x.vec_id) for x in mine] == sorted((x.score, x.vec_id) for x in mine)


def test_ann_rows_hold_one_vector(spark, monkeypatch):
    """What goes to a task is one vector a row, whatever the number of queries; groups, blocks and record batches of any size find the same."""
    r = np.random.default_rng(8)
    vs = {i: r.integers(-4, 5, 6).astype(float) + 0.5 for i in range(0, 900, 2)}
    df, fed, was = spark.createDataFrame([(i, v.tolist()) for i, v in vs.items()], "vec_id long, embedding array<double>"), [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: fed.append(self) or was(self, *a, **b))
    for name, n in (("QUERY_BLOCK", 4), ("HELD", 2), ("ROW_BLOCK", 7)):
        monkeypatch.setattr(ann, name, n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    arrays = [F.max(F.size(c)).alias(c) for c, kind in fed[0].dtypes if kind.startswith("array")]
    assert set(fed[0].agg(*arrays).first()) == {6}
    want = [(q, i + 1, v) for q in vs if q % 20 == 0 for i, (_, v) in enumerate(sorted((float(((vs[q] - x) ** 2).sum()), v) for v, x in vs.items() if v != q)[:5])]
    assert sorted((x.query_id, x["rank"], x.vec_id) for x in got) == sorted(want)


def test_secrets_of_one_repository(spark):
    import corpus_pipeline

    key, bare, shared = "token=live9876543210ab", "Zx8Kq2LmN4pR7sT1vW3yB6cD", "secret=sample12345678"
    rows = [(i, f"file {i} {key} and {bare} here", "en", "one") for i in range(40)] + [(100 + i, f"page {i} {shared}", "en", f"repo{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.n_live, r.n_shared) for r in secret_scan.scan(docs).collect()}
    assert all(got[i] == ((2, 0) if i < 100 else (0, 1)) for i in got) and len(got) == len(rows)
    assert {r.doc_id for r in corpus_pipeline.secrets(spark, docs, SF).collect()} == set(range(100, 105))


def test_near_dedup_null_and_repeated_ids(spark):
    import corpus_pipeline

    words = [" ".join(f"t{i}w{j}" for j in range(40)) for i in range(6)]
    rows = [(None, words[0], "en"), (None, words[1], "en"), (7, words[2], "en"), (7, words[3], "en"), (8, words[4], "en"), (9, words[4] + " end", "en"), (None, words[5], "en"), (3, words[5], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.text, r.doc_id) for r in corpus_pipeline.dedup(spark, docs, SF).collect())
    assert got == sorted([(words[0], None), (words[1], None), (words[2], 7), (words[3], 7), (words[4], 8), (words[5], 3)])


def test_simhash_nearest(spark):
    """All pairs within the radius and ratio of sizes, in one block and in many; a dense group sends a few pairs for each member, and stays whole."""
    r = random.Random(12)
    rows = []
    for g in range(30):
        fp, size = r.getrandbits(64), r.choice((2, 4, 5, 100, 10**6))
        for i in range(4):
            bits = r.sample(range(64), r.randrange(9))
            rows.append((10 * g + i - 150, (fp ^ sum(1 << b for b in bits)) - 2**63, max(1, size * r.choice((5, 5, 6, 4)) // 5)))
    df = spark.createDataFrame(rows, "node long, fp long, size long")
    want = {(max(a, b), min(a, b)) for (a, x, m), (b, y, n) in itertools.combinations(rows, 2) if ((x + 2**63) ^ (y + 2**63)).bit_count() <= 10 and min(m, n) >= 0.8 * max(m, n)}
    for block in (32768, 7):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(simhash, "BLOCK", block)
            assert {(x.a, x.b) for x in simhash.nearest(df, 10, 0.8).collect()} == want and len(want) > 50
    dense = spark.range(3000).selectExpr("id AS node", "7L AS fp", "50L AS size")
    got = {(x.a, x.b) for x in simhash.nearest(dense, 10, 0.8).collect()}
    assert len(got) <= simhash.PARTNERS * 3000 and {a for a, b in got if b == 0} == set(range(1, 3000))
    assert simhash.nearest(df.limit(0), 10, 0.8).count() == 0


def test_near_dedup_by_fingerprints(spark, monkeypatch):
    """The stage goes by SimHash: with no band in common, near copies are still found; what is only near by fingerprint stays."""
    import corpus_pipeline

    monkeypatch.setattr(neardup, "bands", lambda low: np.frombuffer(np.random.default_rng(low).bytes(8 * neardup.BANDS), np.uint64))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").filter("length(text) < 20000")
    texts = {r.doc_id: r.text for r in docs.filter("doc_id < 700").collect()}
    r = random.Random(4)
    for i in list(texts)[:40]:  # changed words of long texts
        words = (texts[i] or "").split()
        if len(words) > 60:
            words[r.randrange(len(words))] = "altogether"
            texts[10**6 + i] = " ".join(words)
    now = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = components(texts, alike(texts))
    assert sum(i >= 10**6 and want[i] < 10**6 for i in texts) > 20
    assert {x.doc_id for x in corpus_pipeline.dedup(spark, now, SF).collect()} == {i for i, g in want.items() if i == g}
