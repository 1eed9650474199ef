"""Files, snapshots and versions."""

import datetime as dt

import pytest

from quillstone.operators import remap
from quillstone.sources import files, versions


def test_jsonl_refuses(spark, tmp_path):
    good, twice, bad = (tmp_path / n for n in ("good.jsonl", "twice.jsonl", "bad.jsonl"))
    good.write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n')
    twice.write_text('{"k": 1, "v": "a"}\n{"k": 1, "v": "b"}\n')
    bad.write_text('{"k": 1, "v": "a"}\n{"k": 2, "v"\n')
    assert files.read_jsonl(spark, str(good), "k long, v string", ["k"]).count() == 2
    with pytest.raises(ValueError, match="repeated"):
        files.read_jsonl(spark, str(twice), "k long, v string", ["k"])
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(bad), "k long, v string", ["k"])


def test_snapshot_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k long, v string")
    files.write_snapshot(rows, str(tmp_path / "s"))
    back = files.read_snapshot(spark, str(tmp_path / "s"), "k long, v string")
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    rows.limit(1).write.mode("overwrite").json(str(tmp_path / "s" / "rows"))
    with pytest.raises(ValueError, match="manifest"):
        files.read_snapshot(spark, str(tmp_path / "s"), "k long, v string")


def test_lock_and_cache(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("a")
    (tmp_path / "src" / "b.txt").write_text("b")
    found = files.file_digests(spark, str(tmp_path / "src"))
    paths = sorted(r.path for r in found.collect())
    lock = spark.createDataFrame([(paths[0], "0" * 64), ("gone", "1")], "path string, sha256 string")
    assert {(r.path, r.status) for r in files.verify_lock(found, lock).collect()} == {(paths[0], "changed"), (paths[1], "unlocked"), ("gone", "missing")}
    from pyspark.sql import functions as F

    inputs = spark.createDataFrame([("x",), ("y",)], "t string")
    cache = inputs.filter("t = 'x'").select(F.sha2("t", 256).alias("input_hash"), F.lit("m").alias("model"), F.lit(3).alias("dimensions"), F.lit(1.0).alias("value"))
    hit, miss = files.cached(inputs, cache, "t", "m", 3)
    assert [r.t for r in hit.collect()] == ["x"] and [r.t for r in miss.collect()] == ["y"]


def test_publish_and_roll_back(spark, tmp_path):
    root, now = str(tmp_path / "v"), dt.datetime(2026, 1, 1)
    make = lambda rows: spark.createDataFrame(rows, "id long, document long, position long, content string, retired boolean")
    none = make([]).select("id")
    first = make([(1, 1, 0, "a", False), (2, 1, 1, "b", False)])
    versions.publish(first, root, "r1", none, now)
    staged = make([(1, 1, 0, "A", False), (3, 1, 1, "c", False)])
    nxt = remap.apply_version(versions.current(spark, root), staged, "r2")
    versions.publish(nxt.select(first.columns), root, "r2", none, now)
    assert {r.id: (r.content, r.retired) for r in versions.current(spark, root).collect()} == {1: ("A", False), 2: ("b", True), 3: ("c", False)}
    with pytest.raises(ValueError, match="refused"):
        versions.publish(first, root, "r3", first.select("id"), now)
    with pytest.raises(ValueError, match="older"):
        versions.rollback(spark, root, now + dt.timedelta(days=15))
    assert versions.rollback(spark, root, now) == "r1"
    back = versions.current(spark, root)
    assert back.exceptAll(first).isEmpty() and first.exceptAll(back).isEmpty()
    with pytest.raises(ValueError, match="nothing"):
        versions.rollback(spark, root, now)


def test_ledger_undoes(spark):
    before = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k long, v long")
    after = spark.createDataFrame([(1, 11), (2, 20), (3, 33)], "k long, v long")
    log = versions.ledger(before, after, "k", "v")
    later = spark.createDataFrame([(1, 11), (2, 20), (3, 99)], "k long, v long")  # 3 was changed by its user since
    assert {r.k: r.v for r in versions.undo(later, log, "k", "v").collect()} == {1: 10, 2: 20, 3: 99}
