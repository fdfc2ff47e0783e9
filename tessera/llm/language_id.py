"""Language identification by hierarchical discrimination (operator 4).

First the family of a text's language is predicted by one-versus-rest linear support vector machines, then one-versus-one
machines vote between the languages of this family. Features are the relative frequencies of hashed byte trigrams of the
whole lower-cased text. The machines are trained in numpy on a bounded, hash-chosen sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import pick, spare_names
from tessera.llm.tokens import give_back, slices

#: Families of ISO 639-1 codes; a language that is in none forms a family of its own. Fixed values.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
UNKNOWN = "und"
BITS = 12


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), f"other:{lang}")


def trigram_slots(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each byte's trigram over all texts, each text's bounds, and its number of trigrams; slot 2^bits: none begins there."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    bounds = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    raw = np.frombuffer(low.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].astype(np.uint32)
    bounds = bounds - bounds[0]
    slots = np.full(len(raw) + 1, 1 << bits, np.int32)
    if len(raw) > 2:
        h = (raw[:-2] * np.uint32(2654435761)) ^ (raw[1:-1] * np.uint32(2246822519)) ^ (raw[2:] * np.uint32(3266489917))
        slots[: len(raw) - 2] = ((h * np.uint32(668265263)) >> np.uint32(32 - bits)).astype(np.int32)
    for back in (1, 2):  # the last two bytes of a text begin no trigram
        at = bounds[1:] - back
        slots[at[at >= bounds[:-1]]] = 1 << bits
    return slots, bounds, np.maximum(np.diff(bounds) - 2, 0)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between the bounds; an empty stretch gives 0. values has one more entry than the last bound."""
    out = np.add.reduceat(values, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    out[np.diff(bounds) == 0] = 0
    return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 300) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared hinge loss (accelerated gradient); y is -1 or 1, the last column of x is 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))  # both sides count alike
    step = 1.0 / (1 + 2 * cost * np.sum(weight * np.einsum("ij,ij->i", x, x)))
    w = prior = np.zeros(x.shape[1])
    for k in range(rounds):
        v = w + k / (k + 3) * (w - prior)
        slack = np.maximum(0, 1 - y * (x @ v))
        prior, w = w, v - step * (v - 2 * cost * (x.T @ (weight * y * slack)))
    return w


class LanguageModel:
    """Families, their languages, and the machines; plain arrays, so that tasks get it by value."""

    def __init__(self, langs: list[str], weights: np.ndarray | None = None):
        self.langs = langs
        self.families = sorted({family_of(x) for x in langs})
        self.of = np.array([self.families.index(family_of(x)) for x in langs], int)
        self.pairs = [(a, b) for a, b in combinations(range(len(langs)), 2) if self.of[a] == self.of[b]]
        self.weights = np.zeros((0, (1 << BITS) + 1)) if weights is None else weights
        self.family_rows = self.weights[: len(self.families) if len(self.families) > 1 else 0]

    @classmethod
    def train(cls, labels: list[str], features: np.ndarray) -> LanguageModel:
        """The machines of labelled rows of features, one row a text."""
        plan = cls(sorted(set(labels)))
        y = np.array([plan.langs.index(x) for x in labels], int)
        x = np.ones((len(features), features.shape[1] + 1))
        np.multiply(features, cls.scaled(1.0), out=x[:, :-1], dtype=np.float64)
        rows = [train_svm(x, np.where(plan.of[y] == f, 1, -1)) for f in range(len(plan.families))] if len(plan.families) > 1 else []
        rows += [train_svm(x[m], np.where(y[m] == a, 1, -1)) for a, b in plan.pairs for m in [(y == a) | (y == b)]]
        return cls(plan.langs, np.array(rows).reshape(-1, (1 << BITS) + 1))

    @staticmethod
    def scaled(features: np.ndarray | float) -> np.ndarray | float:
        return features * 30.0

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score in 0..1 for each text."""
        slots, bounds, n = trigram_slots(texts)
        per = self.scaled(1.0 / np.maximum(n, 1))
        margins = np.empty((len(self.weights), len(n)))
        for k, w in enumerate(self.weights):
            table = w.copy()
            table[-1] = 0.0  # the slot of no trigram; the bias is added below
            margins[k] = _sums(table[slots], bounds) * per + w[-1]
        sure = 1 / (1 + np.exp(-4 * margins))
        fams, every = len(self.family_rows), np.arange(len(n))
        family = margins[:fams].argmax(0) if fams else np.zeros(len(n), int)
        score = sure[family, every] if fams else np.ones(len(n))
        votes, sums = np.zeros((len(self.langs), len(n))), np.zeros((len(self.langs), len(n)))
        for k, (a, b) in enumerate(self.pairs, fams):
            votes[a] += margins[k] >= 0
            votes[b] += margins[k] < 0
            sums[a] += np.tanh(margins[k])
            sums[b] -= np.tanh(margins[k])
        total = votes + 0.5 * sums / len(self.langs)
        total[self.of[:, None] != family[None, :]] = -np.inf
        lang = total.argmax(0)
        for k, (a, b) in enumerate(self.pairs, fams):
            score = np.where(lang == a, score * sure[k], np.where(lang == b, score * (1 - sure[k]), score))
        return lang, np.clip(score, 0.0, 1.0)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_rows: int = 1600) -> LanguageModel | None:
    """Trains on at most sample_rows rows, alike many of each language (those with the least hash of their key).

    Usable rows (a label, and a letter in the text) are counted by language first; rows without a key are drawn by their text; a hash threshold keeps about twice the rows wanted, so that the exact choice by rank never
    sorts a language's rows in one task. Their features are made on all executors; one task trains on them, as they are sample_rows x 2^BITS
    numbers at most, and the driver gets the machines alone. Without any usable row there is no model (None).
    """
    rows = pick(labelled, text=text_col, lang=lang_col, key=key_col).where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()}
    if not sizes:
        return None
    each = max(1, sample_rows // len(sizes))
    share = F.element_at(F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, (2.0 * each + 50) / n)))), F.col("lang"))
    drawn_by = F.coalesce(F.col("key").cast("string"), F.col("text"))
    draw = F.pmod(F.xxhash64(drawn_by, F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("draw", draw).where(F.col("draw") < share)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))).where(F.col("nth") <= each).select("lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, bounds, n = trigram_slots(batch.column("text"))
            counts = [np.bincount(slots[a:b], minlength=(1 << BITS) + 1)[:-1] / max(1, k) for a, b, k in zip(bounds[:-1], bounds[1:], n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([c.astype("<f4").tobytes() for c in counts], pa.binary())], names=["lang", "features"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((lang, raw) for batch in batches for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("features").to_pylist(), strict=True))
        if got:
            model = LanguageModel.train([lang for lang, _ in got], np.frombuffer(b"".join(raw for _, raw in got), "<f4").reshape(len(got), -1))
            yield pa.RecordBatch.from_arrays([pa.array([model.langs]), pa.array([model.weights.astype("<f8").tobytes()], pa.binary())], names=["langs", "weights"])
        give_back()

    drawn = rows.mapInArrow(features, "lang string, features binary").repartition(1)  # sample_rows at most
    found = drawn.mapInArrow(train, "langs array<string>, weights binary").collect()
    return LanguageModel(found[0]["langs"], np.frombuffer(found[0]["weights"], "<f8").reshape(-1, (1 << BITS) + 1)) if found else None


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """Adds lang_name and score_name to the rows of docs; lang_pred is `und` with score 0 where text is null or has no letter.

    Nothing but the text is read. Empty tables give empty results; repeated rows get equal values; texts of fewer
    than three bytes are predicted from the biases. Of families with equal margins, and of languages with equal votes, the first by name is taken. Where the new names are taken, the old columns are replaced.
    """
    kept = [c for c in docs.columns if c not in (lang_name, score_name)]
    (text_name,) = spare_names(docs, "_text")
    source = docs.select(*(docs[f"`{c}`"] for c in kept), docs[f"`{text_col}`"].alias(text_name))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.langs, object) if model else None
        for batch in batches:
            for part in slices(batch, text_name, 1 << 20):
                text = part.column(text_name)
                lang, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if model:
                    letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
                    best, sure = model.predict(text)
                    lang[letters], score[letters] = names[best[letters]], sure[letters]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, lang_name, score_name])
        give_back()

    fields = [source.schema[c] for c in kept]
    return source.mapInArrow(predict, T.StructType([*fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())]))


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row takes no part in training: the CRC-32 of its key as text is divisible by folds. A null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))
