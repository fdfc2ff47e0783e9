import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality_trees as qt


def plain_statistics(text):
    """The same by plain loops over one text."""
    raw = (text or "").encode()
    n = len(raw)
    classes = list(qt.BYTE_CLASSES.items())
    kind = lambda b: next((name for name, members in classes if b in members), "other")
    share = {name: sum(kind(b) == name for b in raw) / max(n, 1) for name in [*qt.BYTE_CLASSES, "other"]}
    per = lambda a, b: a / max(b, 1)
    marks = b"!|#$%&*@^~"
    is_upper = lambda b: kind(b) == "upper"
    is_lower = lambda b: kind(b) == "lower" or b >= 128
    words = [w for w in raw.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" ") if w]
    lines = [x for x in raw.split(b"\n") if x]
    mean = per(sum(map(len, words)), len(words))
    pairs = list(zip(words, words[1:]))
    long_lines = [x for x in lines if len(x) >= 20]
    out = {f"{k}_share": v for k, v in share.items()}
    out |= {
        "bytes": math.log1p(n), "words": math.log1p(len(words)), "word_length": mean,
        "word_length_spread": math.sqrt(max(0.0, per(sum(len(w) ** 2 for w in words), len(words)) - mean**2)),
        "long_word_share": per(sum(len(w) > 20 for w in words), len(words)),
        "capital_word_share": per(sum(sum(map(is_upper, w)) >= 2 and not any(map(is_lower, w)) for w in words), len(words)),
        "first_capital_share": per(sum(is_upper(w[0]) for w in words), len(words)),
        "marked_word_share": per(sum(any(b in marks for b in w) for w in words), len(words)),
        "digit_word_share": per(sum(any(kind(b) == "digit" for b in w) and not any(is_upper(b) or is_lower(b) for b in w) for w in words), len(words)),
        "distinct_word_share": per(len(set(words)), len(words)),
        "repeated_pair_share": 1 - per(len(set(pairs)), len(pairs)) - (not pairs),
        "doubled_byte_share": per(sum(a == b for a, b in zip(raw, raw[1:])), n),
        "doubled_sign_share": per(sum(a == b and a in marks for a, b in zip(raw, raw[1:])), n),
        "words_per_sentence": per(len(words), raw.count(b".") + raw.count(b"?") + 1), "lines": math.log1p(len(lines)),
        "line_length": per(sum(map(len, lines)), len(lines)), "distinct_line_share": per(len(set(lines)), len(lines)),
        "short_line_share": per(sum(len(x) < 20 for x in lines), len(lines)), "stop_line_share": per(sum(x.endswith(b".") for x in lines), len(lines)),
        "byte_entropy": -sum(v * math.log(v) for v in share.values() if v > 0),
        "worst_line_capitals": max((per(sum(map(is_upper, x)), sum(is_upper(b) or is_lower(b) for b in x)) for x in long_lines), default=0),
        "worst_line_marks": max((sum(b in marks for b in x) / len(x) for x in long_lines), default=0),
    }
    return [out[f] for f in qt.FEATURES]


def plain_score(model, row):
    raw = model.start
    for feature, threshold, value in zip(model.feature, model.threshold, model.value):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        raw += value[node - len(feature)]
    return 1 / (1 + math.exp(-raw))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é.!|#\n\t7?-", max_size=90)), max_size=8))
def test_statistics_equal_plain_loops(texts):
    got = qt.statistics(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), len(qt.FEATURES))
    for row, text in zip(got, texts):
        assert row == pytest.approx(plain_statistics(text), abs=1e-9)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (rng.random(300) < 0.1)).astype(float)
    model = qt.Trees(x, y, trees=1, depth=1)
    p = 1 / (1 + np.exp(-model.start))
    gain = {}
    for f in range(3):
        for cut in range(11):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= 5:
                gain[f, cut] = sum((p - y[s]).sum() ** 2 / (s.sum() * p * (1 - p) + 2.0) for s in (left, ~left))
    f, cut = max(gain, key=gain.get)
    assert (model.feature[0, 0], model.threshold[0, 0]) == (f, cut) == (1, 6)


def test_query_against_a_plain_scorer(spark, sf):
    from tessera.llm import queries

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = qt.held_out(docs["doc_id"])
    model = qt.fit(docs.where(~held), labels.where(~qt.held_out(labels["doc_id"])))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op12_quality_trees(spark, sf).collect():
        assert r["score"] == pytest.approx(plain_score(model, plain_statistics(texts[r["doc_id"]])), abs=1e-6)


def test_odd_tables(spark):
    rows = [(1, "Good text here. It is fine.", 5), (2, None, 5), (3, "", 5), (4, "JUNK!! " * 60_000, 5), (4, "JUNK!! " * 60_000, 5), (None, "Good text here.", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    schema = "doc_id long, quality int"
    assert qt.fit(docs, spark.createDataFrame([], schema)) is None
    assert qt.fit(docs, spark.createDataFrame([(1, 1), (4, 1)], schema)) is None
    assert qt.fit(docs.where("false"), spark.createDataFrame([(1, 1), (4, 0)], schema)) is None
    assert {r["score"] for r in qt.score(docs, None).collect()} == {0.5}
    model = qt.fit(docs, spark.createDataFrame([(1, 1), (4, 0), (4, 0), (2, 1), (2, 0), (3, None), (None, 1), (9, 7)], schema), least_rows=1, trees=5)
    got = qt.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], set()).add((r["score"], r["predicted"]))
    assert all(len(v) == 1 for v in by.values()) and max(by[4])[0] < max(by[1])[0]
    assert qt.score(docs.where("false"), model).count() == 0


def test_the_sample_is_bounded_and_balanced(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 40 > 0 as int) as quality")
    seen = []

    class Spy(qt.Trees):
        def __init__(self, x, y):
            seen.append(y)

    original, qt.Trees = qt.Trees, Spy
    try:
        qt.fit(docs, labels, sample_rows=300)
    finally:
        qt.Trees = original
    assert len(seen[0]) == 300 and (seen[0] == 0).sum() == 100
