import itertools
import random

from tessera.functions.present import overlap
from tessera.operators import near_copies
from tessera.operators.near_copies import body_classes, drop_near_copies_at_scale, near_class_pairs, near_unit_pairs
from tessera.plans.search import drop_near_copies

SCHEMA = "unit_key long, path string, body string, label string, snippet string, score double"


def bodies(rng, n):
    base = ["".join(rng.choices("abcde fgh", k=rng.randrange(1, 60))) for _ in range(12)]
    out = []
    for _ in range(n):
        b = rng.choice(base)
        kind = rng.randrange(7)
        if kind == 0:
            b = b[: rng.randrange(1, len(b) + 1)]
        elif kind == 1:
            b = b + "".join(rng.choices("abcde", k=rng.randrange(1, 40)))
        elif kind == 2:
            at = rng.randrange(len(b))
            b = b[:at] + "XYZ" + b[at + 2 :]
        elif kind == 3:
            b = rng.choice(["a", "ab", "abc", "bab", "aaaa", "aaaaaaaa", "ab ab", " ", "", "é", "aé"])
        elif kind == 4:
            b = b.upper() + "　 \n"
        out.append(b)
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    return [(i, f"p{rng.randrange(3)}", b, rng.choice(["L", "M", "", " "]), rng.choice([b[:8], "same", " SA me", ""]), float(rng.randrange(5))) for i, b in enumerate(bodies(rng, n))]


def test_pairs_equal_all_pairs(spark):
    rows = rows_of(1, 150)
    got = {(r["path"], r["a"], r["b"]): r["overlap"] for r in near_unit_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for x, y in itertools.combinations(rows, 2):
        if x[1] == y[1] and (o := overlap(x[2], y[2])) >= 0.45:
            want[x[1], x[0], y[0]] = o
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len(want) > 150


def test_kept_units_equal_the_bounded_selection(spark):
    rows = rows_of(2, 160) + [(1000, "q", None, None, None, 1.0), (1001, "q", "", "L", "x", 0.5), (1002, "q", "", "L", "x", 0.4), (1003, "q", "  ", "", "", 2.0)]
    units = spark.createDataFrame(rows, SCHEMA)
    kept = {r["unit_key"] for r in drop_near_copies_at_scale(units).collect()}
    filled = units.fillna("")
    assert kept == {r["unit_key"] for r in drop_near_copies(filled).collect()}
    assert {1000, 1001, 1003} <= kept and 1002 not in kept
    chain = [(i, "p", "".join(chr(97 + (i * 4 + k) % 26) for k in range(14)), "", "", -float(i)) for i in range(20)]
    units = spark.createDataFrame(chain, SCHEMA)
    assert {r["unit_key"] for r in drop_near_copies_at_scale(units).collect()} == {r["unit_key"] for r in drop_near_copies(units).collect()}


def test_many_copies_and_an_empty_table(spark):
    units = spark.range(3000).selectExpr("id as unit_key", "'p' as path", "'one body that all have' as body", "'L' as label", "cast(id as string) as snippet", "cast(id % 7 as double) as score")
    assert [r["unit_key"] for r in drop_near_copies_at_scale(units).collect()] == [6]
    assert drop_near_copies_at_scale(units.where("false")).count() == 0 and near_unit_pairs(units.where("false")).count() == 0


def test_small_files_meet_by_path_and_large_ones_by_trigrams(spark):
    units = spark.createDataFrame(rows_of(3, 150), SCHEMA)
    found = [{tuple(map(bytes, r[1:3])): (r[0], round(r[3], 9)) for r in near_class_pairs(body_classes(units), few=few).collect()} for few in (10**6, 35, 0)]
    assert len(found[0]) > 80 and found[0] == found[1] == found[2]


def test_texts_of_small_files_are_all_that_is_shuffled(spark, monkeypatch):
    """No table of trigrams is written, and no plan explodes them."""
    labels = []
    monkeypatch.setattr(near_copies, "written", lambda df, label="table", write=near_copies.written: labels.append(label) or write(df, label))
    pairs = near_unit_pairs(spark.createDataFrame(rows_of(4, 60), SCHEMA))
    assert not {"grams", "ordered", "trigrams"} & set(labels)
    assert "Generate" not in pairs._jdf.queryExecution().executedPlan().toString()
