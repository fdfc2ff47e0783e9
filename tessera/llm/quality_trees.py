"""Quality scores by histogram gradient-boosted trees over document statistics (operator 12).

Statistics of a whole text are sums over its bytes, words and lines, taken by arrays over many texts at once. Trees are grown in numpy on binned
statistics of a bounded, hash-chosen sample of labelled rows, and then laid out as arrays over complete binary trees, which a batch of
documents walks level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import pick, spare_names
from tessera.llm.tokens import give_back, slices

#: Classes of bytes that are counted: name -> bytes. Fixed values.
BYTE_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "newline": b"\n",
    "stop": b".", "comma": b",", "bang": b"!", "question": b"?", "pipe": b"|", "sign": b"#$%&*@^~", "bracket": b"()[]{}<>", "quote": b"\"'`", "slash": b"/\\", "joint": b"-_+=:;", "control": bytes([*range(9), *range(11, 32), 127]),
}
_OTHER = len(BYTE_CLASSES)
_CLASS = np.full(256, _OTHER, np.uint8)
for _k, _bytes in enumerate(BYTE_CLASSES.values()):
    _CLASS[np.frombuffer(_bytes, np.uint8)] = _k
_NAMES = list(BYTE_CLASSES)
FEATURES = (
    *(f"{c}_share" for c in [*_NAMES, "other"]), "bytes", "words", "word_length", "word_length_spread", "long_word_share", "capital_word_share", "first_capital_share", "marked_word_share", "digit_word_share",
    "distinct_word_share", "repeated_pair_share", "doubled_byte_share", "doubled_sign_share", "words_per_sentence", "lines", "line_length", "distinct_line_share", "short_line_share", "stop_line_share", "byte_entropy",
    "worst_line_capitals", "worst_line_marks",
)


def _spans(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], where.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by prefix sums of powers (wrapping) and the inverse power of the begin."""
    base, inverse = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(raw), base)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(raw), inverse)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    return (sums[end] - sums[begin]) * back[begin]


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each owner."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    first = np.ones(len(o), bool)
    first[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[first], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """float64 (rows, FEATURES) over whole texts; null counts as empty, and an empty text has zeros."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    size = np.diff(bounds)
    per = lambda count, of: count / np.maximum(of, 1)
    owner = np.repeat(np.arange(n), size)
    kind = _CLASS[raw]
    counts = np.bincount(owner * (_OTHER + 1) + kind, minlength=n * (_OTHER + 1)).reshape(n, _OTHER + 1).astype(float)
    out = dict(zip((f"{c}_share" for c in [*_NAMES, "other"]), (per(counts[:, k], size) for k in range(_OTHER + 1)), strict=True))
    is_of = {c: kind == k for k, c in enumerate(_NAMES)}
    letter = is_of["lower"] | is_of["upper"] | (raw >= 128)
    mark = is_of["bang"] | is_of["pipe"] | is_of["sign"]
    running = lambda where: np.concatenate([[0], np.cumsum(where, dtype=np.int64)])
    uppers, lowers, marks, digits, letters = (running(x) for x in (is_of["upper"], is_of["lower"] | (raw >= 128), mark, is_of["digit"], letter))
    # words: runs without white space, cut at the ends of texts
    solid = ~(is_of["blank"] | is_of["newline"] | (raw == 13))
    begin, end = _spans_within(solid, bounds)
    whose = owner[begin] if len(begin) else np.zeros(0, int)
    words = np.bincount(whose, minlength=n).astype(float)
    total = lambda value: np.bincount(whose, weights=value, minlength=n)
    length = (end - begin).astype(float)
    mean = per(total(length), words)
    w_upper, w_lower, w_mark, w_digit, w_letter = (x[end] - x[begin] for x in (uppers, lowers, marks, digits, letters))
    digest = _hashes(raw, begin, end)
    pair = np.flatnonzero(whose[1:] == whose[:-1]) if len(whose) > 1 else np.zeros(0, int)
    pairs = np.bincount(whose[pair], minlength=n)
    double = np.zeros(len(raw), bool)
    double[1:] = (raw[1:] == raw[:-1]) & (owner[1:] == owner[:-1])
    # lines
    l_begin, l_end = _spans_within(~is_of["newline"], bounds)
    l_whose = owner[l_begin] if len(l_begin) else np.zeros(0, int)
    lines, l_size = np.bincount(l_whose, minlength=n).astype(float), (l_end - l_begin).astype(float)
    worst = lambda top, low: _largest(np.where(l_size >= 20, (top[l_end] - top[l_begin]) / np.maximum(low, 1), 0.0), l_whose, n)
    share = counts / np.maximum(size, 1)[:, None]
    out |= {
        "bytes": np.log1p(size), "words": np.log1p(words), "word_length": mean, "word_length_spread": np.sqrt(np.maximum(per(total(length**2), words) - mean**2, 0)), "long_word_share": per(total(length > 20), words),
        "capital_word_share": per(total((w_upper >= 2) & (w_lower == 0)), words), "first_capital_share": per(total(is_of["upper"][begin]), words), "marked_word_share": per(total(w_mark > 0), words),
        "digit_word_share": per(total((w_digit > 0) & (w_letter == 0)), words), "distinct_word_share": per(_distinct(whose, digest, n), words),
        "repeated_pair_share": 1 - per(_distinct(whose[pair], digest[pair] * np.uint64(3) + digest[pair + 1], n), pairs) - (pairs == 0), "doubled_byte_share": per(np.bincount(owner[double], minlength=n), size),
        "doubled_sign_share": per(np.bincount(owner[double & mark], minlength=n), size), "words_per_sentence": per(words, counts[:, _NAMES.index("stop")] + counts[:, _NAMES.index("question")] + 1), "lines": np.log1p(lines),
        "line_length": per(np.bincount(l_whose, weights=l_size, minlength=n), lines), "distinct_line_share": per(_distinct(l_whose, _hashes(raw, l_begin, l_end), n), lines),
        "short_line_share": per(np.bincount(l_whose, weights=l_size < 20, minlength=n), lines), "stop_line_share": per(np.bincount(l_whose, weights=is_of["stop"][l_end - 1] if len(l_end) else None, minlength=n), lines),
        "byte_entropy": -np.sum(np.where(share > 0, share * np.log(np.maximum(share, 1e-300)), 0), 1),
        "worst_line_capitals": worst(uppers, letters[l_end] - letters[l_begin]), "worst_line_marks": worst(marks, l_size),
    }
    return np.stack([out[f] for f in FEATURES], 1) if n else np.zeros((0, len(FEATURES)))


def _spans_within(where: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of true, cut where a text ends."""
    begin, end = _spans(where)
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(where))]
    cut = np.unique(inner[where[inner - 1] & where[inner]]) if len(inner) else inner
    return np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))


def _largest(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, owner, value)
    return out


class Trees:
    """Boosted trees as arrays: node i of a complete tree has the children 2 i + 1 and 2 i + 2; a node that is not split sends all to the left."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least_rows: int = 5):
        self.depth = depth
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        inner = (1 << depth) - 1
        self.feature = np.zeros((trees, inner), np.int32)
        self.threshold = np.full((trees, inner), np.inf)
        self.value = np.zeros((trees, 1 << depth))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)  # bin b: edge b-1 < x <= edge b
        wide, d = bins, x.shape[1]
        raw = np.full(len(y), self.start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, many = (1 << level) - 1, 1 << level
                slot = ((node - first)[:, None] * d + np.arange(d)) * wide + binned
                hist = [np.bincount(slot.ravel(), weights=None if w is None else np.repeat(w, d), minlength=many * d * wide).reshape(many, d, wide).cumsum(2) for w in (grad, hess, None)]
                g, h, c = hist
                gt, ht, ct = (a[:, :, -1:] for a in hist)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[(c < least_rows) | (ct - c < least_rows)] = 0
                flat = gain.reshape(many, -1)
                best = flat.argmax(1)
                for k in np.flatnonzero(flat[np.arange(many), best] > 1e-9):
                    f, b = divmod(int(best[k]), wide)
                    self.feature[t, first + k], self.threshold[t, first + k] = f, edges[f][b]
                node = 2 * node + 1 + (x[np.arange(len(y)), self.feature[t, node]] > self.threshold[t, node])
            leaf = node - inner
            sums = np.bincount(leaf, weights=grad, minlength=1 << depth), np.bincount(leaf, weights=hess, minlength=1 << depth)
            self.value[t] = -rate * sums[0] / (sums[1] + ridge)
            raw += self.value[t, leaf]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        raw, every = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[every, feature[node]] > threshold[node])
            raw += value[node - len(feature)]
        return 1 / (1 + np.exp(-raw))


def held_out(key: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a row takes no part in training: the CRC-32 of its key as text leaves `fold` modulo folds. A null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, **options) -> Trees | None:
    """Trains on at most sample_rows rows of docs with a label of 0 or 1 (those of each label with the least hash of their key); the rest are no examples.

    Keys with labels of both kinds are left out, and repeated ones count once. Labels are counted first, and each takes at most half of the rows, unless the other has fewer;
    a hash threshold keeps about twice the rows wanted, so that ranks never sort a whole label. The driver gets sample_rows x len(FEATURES) numbers at most.
    Without rows of a label, or with rows of one label only, there is no model (None).
    """
    marks = pick(labels, _key=key_col, y=label_col).where("_key is not null and y in (0, 1)").groupBy("_key").agg(F.min("y").cast("int").alias("y"), F.max("y").cast("int").alias("y2")).where("y = y2").drop("y2")
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    few = min(sizes.values())
    each = {y: max(sample_rows // 2, sample_rows - few) for y in sizes}
    share = F.element_at(F.create_map(*(F.lit(v) for y, n in sizes.items() for v in (y, min(1.0, (2.0 * each[y] + 50) / n)))), F.col("y"))
    marks = marks.withColumn("draw", F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(12)), F.lit(1 << 30)) / float(1 << 30)).where(F.col("draw") < share)
    nth = F.row_number().over(Window.partitionBy("y").orderBy("draw", "_key"))
    marks = marks.withColumn("nth", nth).where(F.col("nth") <= F.element_at(F.create_map(*(F.lit(v) for y, n in each.items() for v in (y, n))), F.col("y"))).select("_key", "y")
    rows = pick(docs, key=key_col, text=text_col).join(F.broadcast(marks), F.col("key") == F.col("_key")).select("y", "key", "text")  # at most sample_rows keys

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                cells = [r.astype("<f8").tobytes() for r in statistics(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("y"), part.column("key").cast(pa.string()), pa.array(cells, pa.binary())], names=["y", "key", "cells"])

    measured = rows.mapInArrow(measure, "y int, key string, cells binary").groupBy("key").agg(F.min(F.struct("cells", "y")).alias("r")).select("key", "r.y", "r.cells")
    got = measured.toPandas().sort_values("key")
    y = got["y"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return None
    return Trees(np.stack([np.frombuffer(bytes(c), "<f8") for c in got["cells"]]), y, **options)


def score(docs: DataFrame, model: Trees | None, text_col: str = "text", score_name: str = "score", label_name: str = "predicted") -> DataFrame:
    """Adds score_name (0 to 1, higher: label 1 likelier) and label_name (1 from 0.5 on, else 0) to the rows of docs.

    Nothing but the whole text is read; a null text counts as empty and has the score of its statistics, which are zeros. Without a model all scores are 0.5.
    Repeated rows get equal values, empty tables give empty results. Where the new names are taken, the old columns are replaced.
    """
    kept = [c for c in docs.columns if c not in (score_name, label_name)]
    (text_name,) = spare_names(docs, "_text")
    source = docs.select(*(docs[f"`{c}`"] for c in kept), docs[f"`{text_col}`"].alias(text_name))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_name, 1 << 20):
                values = model.scores(statistics(part.column(text_name))) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32), pa.int32())], names=[*kept, score_name, label_name])
        give_back()

    fields = [source.schema[c] for c in kept]
    return source.mapInArrow(predict, T.StructType([*fields, T.StructField(score_name, T.DoubleType()), T.StructField(label_name, T.IntegerType())]))
