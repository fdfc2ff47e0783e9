"""Fill-in-the-middle over seekable compressed frames (operator 11).

A text is stored as independent zstandard frames of FRAME_CHARS code points, with the number of code points before each. A cut at
unit c is found by the cumulative counts, so only the (at most two) frames that hold a cut are decompressed; all other frames go to the output
as they are, in the order of the output, with the marks as frames between them. The frames of an output joined together are one
zstandard stream of the whole output text. Digests stream over the frames, one at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, spare_names
from tessera.llm.tokens import give_back, slices

FRAME_CHARS = 1 << 15
#: The marks of the parts. Fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Orders of the output's parts: marks with the parts that follow them. Fixed values.
ORDERS = {"psm": ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")), "spm": ((SUFFIX, "suffix"), (PREFIX, "prefix"), (MIDDLE, "middle"))}

_FRAMES = T.ArrayType(T.BinaryType())
_STARTS = T.ArrayType(T.LongType())


def draws(key: Column, seed: int = 1) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex SHA-256 of `seed:key`, as longs. A null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def store_frames(docs: DataFrame, text_col: str = "text", frame_chars: int = FRAME_CHARS, level: int = 3) -> DataFrame:
    """docs without the text, with it as frames: n (code points), marked (it holds a mark), starts and frames.

    Written once as Parquet in the shared folder and read back. A null or empty text has no frame and n 0. Columns named like the new ones are
    replaced; repeated rows stay. Batches are cut by bytes, so one text at a time is held beside its own frames.
    """
    new = ("n", "marked", "starts", "frames")
    kept = [c for c in docs.columns if c != text_col and c not in new]
    (text_name,) = spare_names(docs, "_text")
    source = docs.select(*(docs[f"`{c}`"] for c in kept), docs[f"`{text_col}`"].alias(text_name))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        for batch in batches:
            for part in slices(batch, text_name, 1 << 22):
                rows: list[tuple[int, bool, list[int], list[bytes]]] = []
                for value in part.column(text_name):
                    text = value.as_py() or ""
                    starts = list(range(0, len(text), frame_chars))
                    rows.append((len(text), any(m in text for m in (PREFIX, SUFFIX, MIDDLE)), starts, [press.compress(text[s : s + frame_chars].encode()) for s in starts]))
                n, marked, starts, frames = (list(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(marked, pa.bool_()), pa.array(starts, pa.list_(pa.int64())), pa.array(frames, pa.list_(pa.binary()))],
                    names=[*kept, *new],
                )
        give_back()

    fields = [source.schema[c] for c in kept]
    types = [T.StructField("n", T.LongType()), T.StructField("marked", T.BooleanType()), T.StructField("starts", _STARTS), T.StructField("frames", _FRAMES)]
    return materialize(source.mapInArrow(pack, T.StructType([*fields, *types])), "frames")


class Frames:
    """One text as frames with the cumulative counts before them."""

    def __init__(self, starts: list[int], frames: list[bytes], n: int):
        self.starts, self.frames, self.n = starts, frames, n
        self.open = zstandard.ZstdDecompressor()

    def text(self, i: int) -> str:
        return self.open.decompress(self.frames[i]).decode()

    def cut(self, low: int, high: int, press: zstandard.ZstdCompressor) -> Iterator[tuple[int, bytes]]:
        """(units, frame) of the units low to high: whole frames as they are, frames with a cut anew."""
        i = bisect_right(self.starts, low) - 1
        while low < high:
            begin, end = self.starts[i], self.starts[i + 1] if i + 1 < len(self.starts) else self.n
            to = min(end, high)
            yield to - low, self.frames[i] if (low, to) == (begin, end) else press.compress(self.text(i)[low - begin : to - begin].encode())
            low, i = to, i + 1

    def units(self, low: int, high: int) -> Iterator[str]:
        """The units low to high as strings of a frame each."""
        i = max(0, bisect_right(self.starts, low) - 1)
        while low < high:
            begin, end = self.starts[i], self.starts[i + 1] if i + 1 < len(self.starts) else self.n
            yield self.text(i)[low - begin : min(end, high) - begin]
            low, i = end, i + 1


def arrange(stored: DataFrame, key_col: str = "doc_id", seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """Adds form, prefix_chars, middle_chars, output_n, output_starts, output_frames to what store_frames() gave; starts and frames go.

    The cuts and the form follow from draws() of the key alone. The form is plain, and the two counts null, where the text is empty or holds a mark or
    by the third draw; else psm or spm by the fourth. A null key draws as the empty string; equal keys with equal texts give equal outputs.
    Columns named like the new ones are replaced.
    """
    new = ("form", "prefix_chars", "middle_chars", "output_n", "output_starts", "output_frames")
    h1, h2, h3, h4 = draws(F.col(f"`{key_col}`"), seed)
    base = stored.drop(*new)
    plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= fim_percent)
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    base = base.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    base = base.withColumn("prefix_chars", F.when(~plain, F.least(a, b))).withColumn("middle_chars", F.when(~plain, F.greatest(a, b) - F.least(a, b)))
    kept = [c for c in base.columns if c not in ("starts", "frames")]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        marks = {m: press.compress(m.encode()) for m in (PREFIX, SUFFIX, MIDDLE)}
        for batch in batches:
            counts, all_starts, all_frames = [], [], []
            names = ("n", "form", "prefix_chars", "middle_chars", "starts", "frames")
            for row in zip(*(batch.column(c) for c in names), strict=True):
                n, form, before, middle, starts, frames = (x.as_py() for x in row)
                pieces: list[tuple[int, bytes]] = []
                if form == "plain":
                    counts.append(n), all_starts.append(starts), all_frames.append(frames)
                    continue
                spans = {"prefix": (0, before), "middle": (before, before + middle), "suffix": (before + middle, n)}
                held = Frames(starts, frames, n)
                for mark, part in ORDERS[form]:
                    pieces.append((len(mark), marks[mark]))
                    pieces += held.cut(*spans[part], press)
                ends = np.cumsum([p[0] for p in pieces])
                counts.append(int(ends[-1])), all_starts.append([0, *ends[:-1].tolist()]), all_frames.append([p[1] for p in pieces])
            columns = [pa.array(counts, pa.int64()), pa.array(all_starts, pa.list_(pa.int64())), pa.array(all_frames, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *new[3:]])
        give_back()

    types = [T.StructField("output_n", T.LongType()), T.StructField("output_starts", _STARTS), T.StructField("output_frames", _FRAMES)]
    return base.mapInArrow(order, T.StructType([*(base.schema[c] for c in kept), *types]))


def _marks_at(output: Frames) -> dict[str, int]:
    """Unit at which each mark first occurs in the stream; frames are read one at a time, with two units carried on."""
    found: dict[str, int] = {}
    tail, at = "", 0
    for piece in output.units(0, output.n):
        window = tail + piece
        for m in (PREFIX, SUFFIX, MIDDLE):
            if m not in found and (i := window.find(m)) >= 0:
                found[m] = at - len(tail) + i
        at += len(piece)
        tail = window[-2:]
    return found


def restored_units(output: Frames, form: str) -> Iterator[str]:
    """The original text from an output and its form, in pieces. Marks do not occur in texts of other forms than plain, so each is found where it stands."""
    if form == "plain":
        yield from output.units(0, output.n)
        return
    found = _marks_at(output)
    marks = [m for m, _ in ORDERS[form]]
    ends = [*(found[m] for m in marks[1:]), output.n]
    spans = {part: (found[m] + len(m), end) for (m, part), end in zip(ORDERS[form], ends, strict=True)}
    for part in ("prefix", "middle", "suffix"):
        yield from output.units(*spans[part])


def digests(arranged: DataFrame) -> DataFrame:
    """Adds output_sha256, of the whole output, and restored_sha256, of the text rebuilt from output and form; the frames go."""
    kept = [c for c in arranged.columns if c not in ("output_starts", "output_frames", "output_sha256", "restored_sha256")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[str]] = [[], []]
            for row in zip(*(batch.column(c) for c in ("form", "output_n", "output_starts", "output_frames")), strict=True):
                form, n, starts, frames = (x.as_py() for x in row)
                held = Frames(starts, frames, n)
                for sums, pieces in zip(out, (held.units(0, n), restored_units(held, form)), strict=True):
                    digest = hashlib.sha256()
                    for piece in pieces:
                        digest.update(piece.encode())
                    sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(s, pa.string()) for s in out)], names=[*kept, "output_sha256", "restored_sha256"])
        give_back()

    fields = [arranged.schema[c] for c in kept]
    return arranged.mapInArrow(read, T.StructType([*fields, T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]))


def output_texts(arranged: DataFrame, name: str = "output") -> DataFrame:
    """arranged with its outputs as strings in place of their frames."""
    kept = [c for c in arranged.columns if c not in ("output_starts", "output_frames", name)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, Any] = {c: batch.column(c) for c in kept}
            rows = zip(*(batch.column(c) for c in ("output_n", "output_starts", "output_frames")), strict=True)
            columns[name] = pa.array(["".join(Frames(s.as_py(), f.as_py(), n.as_py()).units(0, n.as_py())) for n, s, f in rows], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return arranged.mapInArrow(read, T.StructType([*(arranged.schema[c] for c in kept), T.StructField(name, T.StringType())]))


def fill_in_middle(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key_col, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for every row of docs.

    Null and empty texts are plain with the digest of nothing; texts with a mark are plain; ties cannot arise. Empty tables give empty results.
    """
    slim = docs.select(docs[f"`{key_col}`"].alias(key_col), docs[f"`{text_col}`"].alias(text_col))
    return digests(arrange(store_frames(slim, text_col), key_col)).select(key_col, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: The same in SQL over whole texts.
ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents
), x AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d
), y AS (
  SELECT *, least(a, b) AS p, greatest(a, b) AS q, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM x
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[:p] || '<S>' || t[q + 1:] || '<M>' || t[p + 1:q] ELSE '<S>' || t[q + 1:] || '<P>' || t[:p] || '<M>' || t[p + 1:q] END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM y
"""
