import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import hard_negatives as hn


def brute_force(rows):
    """Plain loops over (vec_id, vector, label)."""
    base = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        base.add((i, tuple(math.floor(256 * x) for x in v), (label + 1) % 10 if i % 7 == 0 else label))
    out = set()
    for i, q, label in base:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), j, la) for j, p, la in base if len(p) == len(q))
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            inside = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out |= {(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(inside, 1)}
    return out


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, la, "x") for i, v, la in rows], "vec_id long, embedding array<float>, label int, q string").repartition(3)
    got = [tuple(r) for r in hn.mine(df, **sizes).collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(n, d, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    return [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)], rng.randrange(3)) for i in range(n)]


def test_against_brute_force_in_small_groups(spark):
    rows = vectors(600, 6, 1)
    want = brute_force(rows)
    assert len(want) > 50
    assert mined(spark, rows, shard_rows=70, block_rows=3) == want == mined(spark, rows)


def test_hot_copies_ties_and_odd_rows(spark):
    rows = vectors(300, 4, 2, 0.3)
    rows += [(1000 + i, [0.5, 0.25, 0.0, -0.5], 1) for i in range(500)]  # copies, ten of them anchors
    rows += [(2000 + i, [0.0] * 4, i % 3) for i in range(60)]
    rows += [(3000, None, 1), (3050, [float("nan"), 1.0, 1.0, 1.0], 1), (3051, [None, 1.0, 1.0, 1.0], 1), (3100, [1.0] * 4, None), (None, [1.0] * 4, 1), (3150, [float("inf")] * 4, 2)]
    rows += [(3200, [1.0, 2.0], 1), (3201, [1.0, 2.0], 1), (3202, [1.0, 1.0], 2), (3203, [0.9, 0.9], 0), (3250, [], 1), (3251, [], 1), (3252, [], 2)]
    rows += [rows[0], rows[0], rows[50]]
    assert mined(spark, rows, shard_rows=100, block_rows=4) == brute_force(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e5, 1.2e5, -3e4]) * rng.random() for _ in range(3)], i % 2) for i in range(200)]
    rows = [(i, [float(np.float32(x)) for x in v], la) for i, v, la in rows]
    assert mined(spark, rows) == brute_force(rows)


def test_empty_table_and_no_anchor(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == set()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 80), st.integers(0, 5), st.integers(0, 2**32 - 1), st.lists(st.tuples(st.integers(-60, 60), st.integers(0, 80)), min_size=1, max_size=3))
def test_the_lists_find_what_a_scan_finds(n, d, seed, spans):
    rng = np.random.default_rng(seed)
    rows, anchor, ids = rng.integers(-6, 7, (n, d)), rng.integers(-6, 7, d), rng.permutation(n)
    windows = [(a, a + b) for a, b in spans]
    found, scores, _ = hn.Lists(rows, ids).top(anchor, windows, 3)
    all_scores = rows @ anchor
    for (low, high), places, values in zip(windows, found, scores):
        want = sorted((-s, i, k) for k, (s, i) in enumerate(zip(all_scores.tolist(), ids.tolist())) if low <= s <= high)[:3]
        assert places.tolist() == [k for *_, k in want] and values.tolist() == [-s for s, *_ in want]


@pytest.mark.parametrize(("d", "most"), [(2, 0.2), (4, 0.6)])
def test_reading_stops_early_where_lists_tell_enough(d, most):
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.normal(size=(5000, d))).astype(np.int64)
    lists = hn.Lists(rows, np.arange(5000))
    scored = [lists.top(rows[i], [(-(1 << 62), 1 << 62)], 5)[2] for i in range(20)]
    assert np.mean(scored) < most * 5000
