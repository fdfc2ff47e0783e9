import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, tokens

DOCS = "doc_id long, text string, piece string, length int"
ROWS = [(1, "Hello, wörld! it's 3½ x² 日本語", "x", 1), (2, None, "x", 1), (3, "", None, None), (4, "word " * 5000, "y", 2), (5, "same text", None, 3), (6, "same text", None, 3), (6, "same text", None, 3)]


def encoded(text):
    t = tokens.load(tokens.default_path()).tokenizer
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_chunks_have_the_tokenizers_ids(text):
    import pyarrow as pa

    ids, bounds = tokens.load(tokens.default_path()).encode(pa.array([text, None, text]))
    assert ids[: bounds[1]].tolist() == encoded(text)[:-1] == ids[bounds[2] :].tolist()


def test_special_tokens_and_odd_spaces():
    import pyarrow as pa

    for text in ("<|endoftext|> a", "a\u0085b", "\x1cab", "İstanbul ΣΑΣ", "don't WE'LL", "é"):
        ids, _ = tokens.load(tokens.default_path()).encode(pa.array([text]))
        assert ids.tolist() == encoded(text)[:-1]


def test_other_vocabularies_take_the_whole_path(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    t = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    texts = pa.array(["Two  words, (here)\n", None, "", "\u65e5\u672c  x"])
    assert tokens.load(tokens.default_path()).by_chunk and not t.by_chunk
    ids, bounds = t.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [t.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts.to_pylist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab '.9\u00e9\u0130\t\n", max_size=20), max_size=8), st.integers(0, 3))
def test_chunks_are_remembered(texts, most):
    import pyarrow as pa

    t = tokens.load(tokens.default_path())
    before, tokens.CACHE_WORDS = tokens.CACHE_WORDS, most
    try:
        for _ in range(2):
            ids, bounds = t.encode(pa.array(texts, pa.string()).slice(len(texts) // 3))
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [encoded(x)[:-1] for x in texts[len(texts) // 3 :]]
    finally:
        tokens.CACHE_WORDS = before


def check_pieces(rows, docs, capacity):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for doc_id, text in {(d[0], d[1]) for d in docs}:
        ids, times = encoded(text), sum(d[0] == doc_id for d in docs)
        got = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert len(got) == times * -(-len(ids) // capacity)
        for r in got:
            part = ids[r["piece"] * capacity : (r["piece"] + 1) * capacity]
            assert (r["start"], r["length"]) == (r["piece"] * capacity, len(part))
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return used


def test_best_fit_sequences(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    for capacity in (16, 2048):
        rows = packing.best_fit_sequences(packing.token_pieces(docs, capacity=capacity), capacity, rows_per_salt=2).collect()
        check_pieces(rows, ROWS, capacity)


def test_best_fit_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.best_fit_sequences(packing.token_pieces(docs), rows_per_salt=3).collect()
    used = check_pieces(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    _, _, best = packing.best_fit_decreasing(np.array([r["length"] for r in rows]), 2048)
    assert len(used) <= best * 1.01 + 1
    assert len(used) >= -(-sum(r["length"] for r in rows) // 2048)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert packing.best_fit_sequences(packing.token_pieces(docs)).count() == 0
    assert packing.packed_matrices(docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200), st.integers(40, 64))
def test_rounds_place_every_piece(lengths, capacity):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    plan = packing.match_rounds(dict(counts), capacity)
    rows = plan.arrays()
    used = defaultdict(list)
    for length, n in counts.items():
        mine = np.flatnonzero(rows["length"] == length)
        for rank in range(n):
            i = mine[np.searchsorted(rows["first"][mine], rank, side="right") - 1]
            nth = rank - rows["first"][i]
            used[rows["base"][i] + nth // rows["per"][i]].append((rows["offset"][i] + nth % rows["per"][i] * length, length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(map(len, used.values())) == len(lengths)
    _, _, best = packing.best_fit_decreasing(np.array(lengths, int), capacity)
    assert len(used) <= best * 1.25 + 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_segment_tree_is_best_fit(lengths):
    sequence, offset, n = packing.best_fit_decreasing(np.array(lengths, int), 30)
    gaps = []
    for i in np.argsort(-np.array(lengths, int), kind="stable"):
        fit = [g for g in gaps if g >= lengths[i]]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else 30) - lengths[i])
    assert n == len(gaps)
    assert sorted(30 - np.bincount(sequence, lengths, n).astype(int)) == sorted(gaps) if n else not gaps


def test_packed_matrices_round_trip(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    for shard in (50, 1 << 20):
        parts = defaultdict(list)
        for r in packing.packed_matrices(docs.coalesce(1), capacity=64, shard_tokens=shard, pad_id=7).collect():
            ids, places = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
            cu = r["cu_seqlens"]
            assert len(ids) == 64 and cu[0] == 0 and cu[-1] == r["n_tokens"] and r["resets"] == cu[:-1]
            assert (ids[cu[-1] :] == 7).all()
            for a, b, doc, piece, start in zip(cu[:-1], cu[1:], r["doc_ids"], r["pieces"], r["starts"], strict=True):
                assert places[a:b].tolist() == list(range(b - a)) and start == piece * 64
                parts[doc].append((piece, ids[a:b].tolist()))
        for doc_id, text in {(d[0], d[1]) for d in ROWS}:
            whole = encoded(text)
            times = sum(d[0] == doc_id for d in ROWS)
            want = sorted([(i // 64, whole[i : i + 64]) for i in range(0, len(whole), 64)] * times)
            assert sorted(parts[doc_id]) == want


@pytest.mark.parametrize("capacity", [8])
def test_written_matrices(spark, tmp_path, capacity):
    packing.write_packed(spark.createDataFrame(ROWS[:1], DOCS), str(tmp_path / "m"), capacity=capacity)
    assert spark.read.parquet(str(tmp_path / "m")).count() == -(-len(encoded(ROWS[0][1])) // capacity)
