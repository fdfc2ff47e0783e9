import hashlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fill_middle as fm


def plain_model(key, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return n, "psm", a, b - a, f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


TEXTS = [None, "", "x", "ab", "a<P>b", "<S", "S>x<", "é" * 200_000, "𝒳y\u0000z\r\n" * 30_000, "word " * 40_000, "<" * 100, "<P" * 50_000, "M>" * 500]
ROWS = [(i, TEXTS[i % len(TEXTS)], "n", 7) for i in range(130)] + [(None, "null key", "n", 7), (3, TEXTS[3], "n", 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, frames string, n int").repartition(3)


def test_cuts_forms_and_digests(docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for key, text, *_ in ROWS:
        *head, out = plain_model(key, text)
        want.append((key, *head, sha(out), sha(text or "")))
    got = [tuple(r) for r in fm.fill_in_middle(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_are_one_zstandard_stream_and_whole_frames_are_kept(docs):
    stored = fm.store_frames(docs, frame_chars=1000)
    frames = {r["doc_id"]: r["frames"] for r in stored.collect()}
    arranged = fm.arrange(stored)
    texts = {r["doc_id"]: r["output"] for r in fm.output_texts(arranged).collect()}
    for r in arranged.collect():
        out = zstandard.ZstdDecompressor().stream_reader(b"".join(r["output_frames"]), read_across_frames=True).read().decode()
        assert out == plain_model(r["doc_id"], TEXTS[r["doc_id"] % len(TEXTS)] if r["doc_id"] is not None else "null key")[-1] == texts[r["doc_id"]]
        assert r["output_starts"][:1] in ([], [0]) and r["output_n"] == len(out)
        if r["form"] != "plain":
            assert len(set(frames[r["doc_id"]]) - set(r["output_frames"])) <= 2  # only frames with a cut are written anew


def test_empty_table(spark):
    assert fm.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>PSMx", max_size=60), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]), st.integers(1, 9))
def test_restores_any_text_without_marks(text, a, b, form, size):
    if any(m in text for m in (fm.PREFIX, fm.SUFFIX, fm.MIDDLE)):
        return
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    spans = {"prefix": text[:a], "middle": text[a:b], "suffix": text[b:]}
    out = "".join(m + spans[p] for m, p in fm.ORDERS[form])
    press = zstandard.ZstdCompressor()
    starts = list(range(0, len(out), size))
    frames = fm.Frames(starts, [press.compress(out[s : s + size].encode()) for s in starts], len(out))
    assert "".join(fm.restored_units(frames, form)) == text
