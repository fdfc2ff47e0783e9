import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.index import SearchIndex
from tessera.operators.segments import SegmentStore, segment_upsert
from tessera.plans import search

SCHEMA = "path string, seq long, removed boolean, fingerprint string, body string"


def read(rows):
    """Two units of each file."""
    halves = F.array(F.struct(F.lit(0).alias("n"), F.col("body").alias("b")), F.struct(F.lit(1).alias("n"), F.reverse("body").alias("b")))
    return rows.select("path", F.explode(halves).alias("u")).select(F.concat_ws("#", "path", "u.n").alias("unit_key"), "path", F.col("path").alias("title"), F.col("u.b").alias("body"))


def scores(index, query):
    return {r["unit_key"]: round(r["score"], 9) for r in search.retrieve(index, query).collect()}


def expected(state):
    """Last event of each path over all batches."""
    last = {}
    for path, seq, removed, mark, body in state:
        if path is not None and (path not in last or seq > last[path][0]):
            last[path] = (seq, removed, body)
    return {p: b for p, (_, removed, b) in last.items() if not removed}


def rebuilt(spark, files):
    return SearchIndex.build(read(spark.createDataFrame([(p, b) for p, b in files.items()], "path string, body string")))


def test_batches_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(1)
    words = "alpha beta gamma delta ahpla atled the of".split()
    store = SegmentStore(spark, str(tmp_path / "s"), fan=2)
    assert store.version() is None and store.index() is None and store.states() is None
    done = []
    for number in range(4):
        rows = []
        for _ in range(rng.randrange(0, 9)):
            body = " ".join(rng.choices(words, k=rng.randrange(0, 12)))
            rows.append((f"f{rng.randrange(7)}", rng.randrange(10_000), rng.random() < 0.25, None, body))
        rows = list({r[1]: r for r in rows}.values()) + [(None, 1, False, None, "alpha")]
        done += rows
        batch = spark.createDataFrame(rows, SCHEMA)
        version = store.apply(batch, number, read)
        assert store.apply(batch, number, read) == version  # a batch counts once
        files = expected(done)
        if number % 2 == 0:
            continue
        assert {r["path"] for r in store.states().where("not removed").collect()} == set(files)
        index, fresh = store.index(), rebuilt(spark, files)
        assert {r["unit_key"]: r["body"] for r in index.units.collect()} == {r["unit_key"]: r["body"] for r in fresh.units.collect()}
        if files:
            same = lambda i: sorted((r["field"], r["term"], r["unit_key"], r["tf"], list(r["positions"]), r["len"]) for r in i.postings.collect())
            assert same(index) == same(fresh)
            assert scores(index, 'alpha gamma "the of"') == scores(fresh, 'alpha gamma "the of"')
            stat = lambda i: sorted((r["field"], r["n_units"], r["total_len"], r["avg_len"]) for r in i.stats.collect())
            assert stat(index) == stat(fresh)
    assert len(store.version().segments) < 4
    whole = store.compact()
    assert len(whole.segments) == 1 and scores(store.index(), "alpha delta") == scores(rebuilt(spark, expected(done)), "alpha delta")
    assert spark.read.parquet(f"{store.path}/segments/{whole.segments[0].name}/dead").count() == 0


def sizes(root):
    return {n: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(os.path.join(root, n)) for f in fs if f.endswith(".parquet")) for n in os.listdir(root)}


def test_a_batch_writes_in_proportion_and_old_versions_go(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "s"), fan=50)
    rng = random.Random(3)
    big = [(f"f{i}", i, False, None, " ".join(f"w{rng.randrange(3000)}" for _ in range(200))) for i in range(400)]
    store.apply(spark.createDataFrame(big, SCHEMA), 0, read)
    for n in range(1, 3):
        store.apply(spark.createDataFrame([(f"f{n}", 1000 + n, False, None, "new text")], SCHEMA), n, read)
    written = sizes(str(tmp_path / "s" / "segments"))
    assert len(written) == 3 and max(v for k, v in written.items() if k != "b00000000") < 0.1 * written["b00000000"]
    assert sorted(os.listdir(tmp_path / "s" / "versions")) == ["v=1", "v=2"]
    store.compact()
    store.apply(spark.createDataFrame([("g", 5000, False, None, "more")], SCHEMA), 3, read)
    assert sorted(n[0] for n in sizes(str(tmp_path / "s" / "segments"))) == ["b", "c"]


def test_fingerprints_exclusions_and_a_failed_batch(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "s"))
    asked = []

    def counting(rows):
        asked.append(sorted(r["path"] for r in rows.collect()))
        return read(rows)

    rows = [("a/x", 1, False, "h1", "one"), ("b/y", 1, False, "h2", "two"), ("B/z", 1, None, None, "three")]
    excluded = spark.createDataFrame([("b",)], "path string")
    store.apply(spark.createDataFrame(rows, SCHEMA), 0, counting, excluded)
    store.apply(spark.createDataFrame([("a/x", 2, False, "h1", "not read"), ("c", 1, False, None, "")], SCHEMA), 1, counting)
    assert asked == [["a/x"], ["c"]]

    def broken(rows):
        raise OSError("no file")

    with pytest.raises(OSError):
        store.apply(spark.createDataFrame([("a/x", 3, False, "h9", "later")], SCHEMA), 2, broken)
    assert store.version().batch == 1 and scores(store.index(), "one").keys() == {"a/x#0"}
    store.apply(spark.createDataFrame([("a/x", 3, False, "h9", "later"), ("b/y", 9, True, None, None)], SCHEMA), 2, counting)
    assert scores(store.index(), "later").keys() == {"a/x#0"} and not scores(store.index(), "one")
    store.apply(spark.createDataFrame([("a/x", 4, True, None, None), ("c", 2, True, None, None)], SCHEMA), 3, counting)
    assert store.index().units.count() == 0 and store.version().n_units == 0
    assert segment_upsert(store, read)(spark.createDataFrame([("a/x", 5, False, None, "back")], SCHEMA), 4) is None
    assert scores(store.index(), "back").keys() == {"a/x#0"}
