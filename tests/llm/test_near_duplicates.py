import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import embedding_dedup, order_minhash
from tessera.llm.common import connected_components

VEC = "vec_id long, embedding array<float>, label int, rep string, keys int"


def brute_vectors(rows):
    ok = {}
    for i, (vec_id, v, label, *_) in enumerate(rows):
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                if ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.98:
                    links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(links[i]), low, low == rows[i][0]))
    return sorted(out)


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)  # hot buckets are dealt into blocks
    rng = np.random.default_rng(5)
    rows, base = [], rng.normal(size=(12, 64))
    for i in range(150):
        v = base[i % 12] + rng.normal(size=64) * rng.choice([0, 0.02, 0.1, 0.14])
        rows.append((i, v.astype(np.float32).tolist(), i % 2, None, 0))
    rows += [(200 + i, rows[3][1], 1, "x", None) for i in range(20)]
    rows += [(300, None, 1, "", 0), (301, [0.0] * 64, 1, "", 0), (302, [float("nan")] * 64, 1, "", 0), (303, [None] * 64, 1, "", 0), (304, rows[3][1], None, "", 0), (305, rows[3][1][:32], 1, "", 0), (306, [], 1, "", 0), (307, [1.0], 0, "", 0), (308, [2.0], 0, "", 0)]
    rows.append(rows[5])
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VEC).repartition(5))
    assert sorted(map(tuple, got.collect())) == brute_vectors(rows)


@pytest.mark.parametrize(("kind", "scales"), [("float", [1e-30, 1e-25, 1e-5, 1.0, 2.0, 1e20, 1e37]), ("double", [1e-300, 1e-200, 1e-30, 1.0, 1e20, 1e200, 1e300])])
def test_vectors_of_all_scales(spark, kind, scales):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 16))
    rows, unit = [], []
    for i in range(84):
        v = base[i % 6] + rng.normal(size=16) * rng.choice([0.0, 0.03, 0.12])
        v = v / np.abs(v).max()
        w = v * scales[i % len(scales)]
        if kind == "float":
            w = w.astype(np.float32)
            v = w.astype(float) / np.abs(w.astype(float)).max()
        rows.append((i, w.tolist(), 1 + i % 6 // 3, None, 0))
        unit.append((i, v.tolist(), 1 + i % 6 // 3))
    tiny = [(100, [5e-45 if kind == "float" else 5e-324] + [0.0] * 15, 3, None, 0), (101, [1.0] + [0.0] * 15, 3, None, 0)]
    links = {i: {j for j, w, lb in unit if j != i and lb == la and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98} for i, v, la in unit}
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows + tiny, VEC.replace("float", kind)).repartition(5)).collect()}
    assert {i: len(x) for i, x in links.items()} == {i: got[i]["n_links"] for i in links}
    assert max(map(len, links.values())) > 3 and (got[100]["n_links"], got[101]["component_id"]) == (1, 100)


def test_a_key_is_named_once():
    keys = embedding_dedup.cross_polytope_keys(np.array([[1.0, 0.0], [1e-30, 1e-30], [3.0, -3.0]]), 4, 1, 6)
    for row in keys.reshape(-1, 7):
        used = row[row >= 0].tolist()
        assert len(used) == len(set(used)) and row[0] >= 0


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5), (None, 4)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30), st.integers(0, 30))
def test_alignment_is_the_edit_distance(a, b, most):
    d = levenshtein(a, b)
    want = d if d <= most else -1
    x, y = np.array(a, "<u4"), np.array(b, "<u4")
    assert order_minhash.within(x, y, most) == want
    if a and b:
        assert order_minhash._in_band(a, b, most) == want == order_minhash._furthest(x, y, most)


def test_occurrences_and_order_matter():
    import pyarrow as pa

    texts = ["a b c d e " * 6, "a b c d e", " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(25, 50)) + " " + " ".join(f"w{i}" for i in range(25)), None, "", "!!", "one two"]
    runs, ends = order_minhash.kmers(*order_minhash.word_hashes(pa.array(texts)))
    assert np.diff(ends).tolist() == [26, 1, 46, 46, 0, 0, 0, 1]
    assert len(set(runs[:26].tolist())) == 26
    found = order_minhash.sketches(runs, ends)
    assert (found[4:7] == 0).all() and (found[2] == found[3]).sum() < 0.625 * order_minhash.SKETCHES


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage = text(60)
    rows, nearby = [], []
    for g in range(12):
        base = text(rng.choice([30, 120, 400]))
        for c in range(1 if g < 4 else 30 if g == 5 else 4):
            t = list(base)
            for _ in range(c and max(1, len(t) // 120)):
                t[rng.randrange(len(t))] = rng.choice(words)
            nearby.append((g, len(rows)))
            rows.append(" ".join(t))
    for _ in range(40):
        rows.append(" ".join(text(60) + passage + text(60)))
    rows += [rows[0]] * 5 + [None, None, "", "", "?!", "tiny text", "tiny text"]
    return rows, nearby


@pytest.mark.parametrize("members", [3, 2048])
def test_documents_against_all_pairs(spark, monkeypatch, members):
    monkeypatch.setattr(order_minhash, "MEMBERS", members)
    rows, nearby = corpus()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(rows)] + [(0, rows[0], 1, "k")], "doc_id long, text string, n int, key string").repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    plain = [None if t is None else t.split() for t in rows]
    shingles = [set() if not t else {tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in plain]
    for i in range(len(rows)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if rows[i] is not None and rows[i] == rows[j]:
                assert got[i] == got[j]
            elif a and b and len(a & b) >= 0.8 * len(a | b):
                assert got[i] == got[j], (i, j)
            elif got[i] == got[j]:
                assert len(a & b) > 0.2 * len(a | b)
    for (g, i), (h, j) in zip(nearby, nearby[1:]):
        assert (got[i] == got[j]) == (g == h)
    assert len({got[i] for i, t in enumerate(rows) if t is None}) == 2
    kept = order_minhash.kept_documents(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(got.values())) and set(kept[0].asDict()) == {"doc_id", "text", "n", "key"}
    assert order_minhash.near_duplicates(docs.where("false")).count() == 0


def edited(rng, words, text, edits):
    text = list(text)
    for at in rng.sample(range(len(text)), edits):
        text[at] = rng.choice(words)
    return text


def linked(texts):
    """The least number of each text's component, links being pairs that share a sketch and are within a fifth: all pairs are compared."""
    import pyarrow as pa

    words, bounds = order_minhash.word_hashes(pa.array([" ".join(t) for t in texts]))
    found = order_minhash.sketches(*order_minhash.kmers(words, bounds))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and (found[i] == found[j]).any() and found[i].all() and order_minhash.similarity(words[bounds[i] : bounds[i + 1]], words[bounds[j] : bounds[j + 1]]) >= 0:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def classes_of(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    return [got[i] for i in range(len(texts))]


def pairs_with_a_passage(seed, pairs=30):
    """Pairs of texts whose scattered edits break all runs but those of a passage, which all pairs share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage, texts = rng.choices(words, k=150), []
    for _ in range(pairs):
        own = rng.choices(words, k=100)
        texts += [edited(rng, words, own, 22) + passage for _ in range(2)]
    return texts


def test_scattered_edits_are_linked(spark):
    texts = pairs_with_a_passage(11, 5)
    want = linked(texts)
    assert len(set(want)) < 8  # some pairs are linked
    assert classes_of(spark, texts) == want


def test_a_member_linked_to_a_pivot_is_still_compared(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):  # the middle one is within a fifth of both others, which are not of each other
        m = rng.choices(words, k=400)
        texts += [m, m[:200] + rng.choices(words, k=8) + m[208:], m + rng.choices(words, k=95)]
    want = linked(texts)
    assert want == [i // 3 * 3 for i in range(len(texts))]
    assert classes_of(spark, texts) == want


@pytest.mark.parametrize(("members", "words"), [(2, 1 << 20), (300, 1 << 20), (300, 2000)])
def test_links_do_not_depend_on_the_size_of_a_bucket(spark, monkeypatch, members, words):
    monkeypatch.setattr(order_minhash, "MEMBERS", members)
    monkeypatch.setattr(order_minhash, "WORDS", words)
    texts = pairs_with_a_passage(13)
    assert classes_of(spark, texts) == linked(texts)


def test_recall_at_scattered_changes(spark):
    """Of 60 pairs of 300 words for each share of changed words, all below a fifth apart, at least 0.9 are linked; so are pairs that sit in one hot bucket."""
    rng = random.Random(14)
    words = [f"w{i}" for i in range(20000)]
    passage, texts, pairs = rng.choices(words, k=120), [], {}
    for share in (3, 6, 10, 15, 19):
        for hot in (False, True):
            for _ in range(60):
                own = rng.choices(words, k=180) + passage if hot else rng.choices(words, k=300)
                pairs.setdefault((share, hot), []).append(len(texts))
                texts += [own, edited(rng, words, own, 3 * share)]
    got = classes_of(spark, texts)
    for (share, hot), at in pairs.items():
        found = sum(got[i] == got[i + 1] for i in at)
        assert found >= 54, (share, hot, found)
    assert len(set(got)) >= 600  # the passage alone links nothing


def test_very_long_texts(spark):
    rng = random.Random(15)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=200_000)
    near = edited(rng, words, base, 150)
    del near[1000:1040]
    texts = [base, near, rng.choices(words, k=200_000), base[:100_000] + rng.choices(words, k=100_000)]
    assert classes_of(spark, texts) == [0, 0, 2, 3]


def test_a_million_words_align():
    rng = np.random.default_rng(16)
    a = rng.integers(0, 50_000, 1_000_000).astype("<u4")
    b = np.delete(a, rng.integers(0, len(a), 40))
    b[rng.integers(0, len(b), 60)] = 77_777
    assert 80 <= order_minhash.within(a, b, len(a) // 5) <= 100


def test_words_are_folded():
    import pyarrow as pa

    words, bounds = order_minhash.word_hashes(pa.array(["The (cat)\u2019s \u00c9T\u00c9!", None, "", "the cats \u00e9t\u00e9", " -- \u2014 ", "cats\tthe\n\u0939\u093f"]))
    assert np.diff(bounds).tolist() == [3, 0, 0, 3, 0, 3]
    assert words[:3].tolist() == words[3:6].tolist() and words[6:8].tolist() == words[[1, 0]].tolist()
    part = pa.array(["zero", "one two", "three"]).slice(1, 1)
    again, bounds = order_minhash.word_hashes(part)
    assert bounds.tolist() == [0, 2] and again.tolist() == order_minhash.word_hashes(pa.array(["one two"]))[0].tolist()


def test_repeated_ids_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long, "a", 1), (1, other, "b", 2), (1, other, "b", 2), (2, long + " end", "c", 3), (3, other, "d", 4), (None, long, "e", 5), (None, None, "f", 6), (4, None, "g", 7), (4, None, "g", 8), (5, "", "h", 9), (6, "", "h", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _nth string, digest int")
    got = sorted(map(tuple, order_minhash.near_duplicates(docs).collect()), key=str)
    assert [g for g in got if g[0] == 1] == [(1, 1, True)] * 3 and (2, 1, False) in got and (3, 1, False) in got and (4, 4, True) in got and (6, 5, False) in got
    kept = order_minhash.kept_documents(docs)
    assert kept.columns == docs.columns
    found = sorted(map(tuple, kept.collect()), key=str)
    want = [(1, long, "a", 1), (1, other, "b", 2), (None, long, "e", 5), (None, None, "f", 6), (5, "", "h", 9)]
    assert [f for f in found if f[0] != 4] == sorted(want, key=str) and sum(f[0] == 4 for f in found) == 1
    assert sorted(map(tuple, order_minhash.kept_documents(docs.repartition(5)).collect()), key=str) == found
    assert order_minhash.kept_documents(docs.where("false")).count() == 0


def test_components_of_a_hub(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HUB_PART", 4)
    edges = [(500, 500 + i) for i in range(1, 60)] + [(i, i + 1) for i in range(20)] + [(520, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert set(got.values()) == {0} and len(got) == 81
