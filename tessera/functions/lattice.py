"""Morphological analysis by a word lattice: lexicon, connection costs and unknown words come as tables.

All words that begin at any character of a batch of texts are looked up at once in a double-array trie. The least-cost path through the lattice
of these words and of unknown words, which are formed by classes of characters, is found by a Viterbi search whose state at a
character is the best path for each right id. White space is no token and ends a path.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A lexicon with more words than this does not go to the executors as a broadcast; one of a natural language has fewer than half as many.
MOST_WORDS = 2_000_000
SLICE_CHARS = 1 << 18


@dataclass(frozen=True)
class Token:
    surface: str
    pos: str
    detail: str = "*"


@dataclass(frozen=True)
class Word:
    surface: str
    left: int
    right: int
    cost: int
    pos: str
    detail: str = "*"


@dataclass(frozen=True)
class CharClass:
    """Characters by ranges, and the unknown words that they form.

    Unknown words begin at a character where no word of the lexicon does, or at any if `always`. They are the runs of up to `longest` characters of the class,
    and the whole run if `grouped`; a word of n characters costs cost + n * per_char.
    """

    name: str
    ranges: tuple[tuple[str, str], ...] = ()
    always: bool = False
    grouped: bool = True
    longest: int = 0
    left: int = 0
    right: int = 0
    cost: int = 0
    per_char: int = 0
    pos: str = "名詞"
    detail: str = "*"


@dataclass(frozen=True)
class Decompose:
    """What a long word costs besides, so that compounds fall into their parts: by characters above the length, for words of kanji alone and others."""

    kanji_length: int = 2
    kanji_cost: int = 3000
    other_length: int = 7
    other_cost: int = 1700

    def of(self, surface: str) -> int:
        kanji = all("一" <= c <= "龯" or c in "々〆" for c in surface)
        length, cost = (self.kanji_length, self.kanji_cost) if kanji else (self.other_length, self.other_cost)
        return max(0, len(surface) - length) * cost


class DoubleArray:
    """Distinct byte strings as a trie in two arrays: the child of node s by code c is base[s] + c where check there is s.

    A byte's code is one more than the byte; code 0 ends a word, whose number n is kept as the base -n - 1 of that child.
    """

    def __init__(self, words: list[bytes]):
        order = sorted(range(len(words)), key=words.__getitem__)
        keys = [words[i] for i in order]
        size = 1024
        base, check = array("i", [0]) * size, array("i", [-1]) * size
        check[0] = 0
        free = 1
        todo = [(0, 0, len(keys), 0)] if keys else []
        while todo:
            node, low, high, depth = todo.pop()
            children: list[tuple[int, int, int]] = []
            at = low
            while at < high:
                code = keys[at][depth] + 1 if len(keys[at]) > depth else 0
                to = at + 1
                while to < high and (keys[to][depth] + 1 if len(keys[to]) > depth else 0) == code:
                    to += 1
                children.append((code, at, to))
                at = to
            first, codes = children[0][0], [c for c, *_ in children]
            place = max(1, free - first)
            while True:
                while place + 257 >= size:
                    base.extend(array("i", [0]) * size)
                    check.extend(array("i", [-1]) * size)
                    size *= 2
                if all(check[place + c] < 0 for c in codes):
                    break
                place += 1
            base[node] = place
            for code, a, b in children:
                check[place + code] = node
                if code:
                    todo.append((place + code, a, b, depth + 1))
                else:
                    base[place + code] = -order[a] - 1
            while free < size and check[free] >= 0:
                free += 1
        self.base, self.check = np.frombuffer(base, np.int32), np.frombuffer(check, np.int32)

    def prefixes(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words that begin at the byte offsets `at`: index into `at`, end offset and number of each."""
        node, where, live = np.zeros(len(at), np.int64), at.astype(np.int64), np.arange(len(at))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        padded = np.append(raw, np.uint8(0))
        while len(live):
            place = self.base[node].astype(np.int64)
            ends = (self.check[place] == node) & (node > 0)
            if ends.any():
                out.append((live[ends], where[ends], -self.base[place[ends]].astype(np.int64) - 1))
            step = place + padded[where] + 1
            on = (where < len(raw)) & (self.check[step] == node)
            node, where, live = step[on], where[on] + 1, live[on]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


@dataclass
class Lexicon:
    """Words, connection costs (right id of the word before, left id of the word after) and character classes; the last class without ranges takes all other characters."""

    words: list[Word]
    connections: dict[tuple[int, int], int] = field(default_factory=dict)
    classes: tuple[CharClass, ...] = ()
    decompose: Decompose | None = field(default_factory=Decompose)

    def __post_init__(self) -> None:
        surfaces: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            if w.surface:
                surfaces.setdefault(w.surface, []).append(i)
        self._ids = list(surfaces.values())
        self._trie = DoubleArray([s.encode() for s in surfaces])
        self._extra = [self.decompose.of(s) if self.decompose else 0 for s in surfaces]
        if not self.classes or self.classes[-1].ranges:
            self.classes = (*self.classes, CharClass("OTHER", cost=20_000))
        edges = sorted((lo, hi, k) for k, c in enumerate(self.classes) for lo, hi in c.ranges)
        self._low, self._high = (np.array([ord(e[i]) for e in edges], np.int64) for i in (0, 1))
        self._class = np.array([e[2] for e in edges], np.int64)

    def class_of(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point; ranges do not overlap."""
        if not len(self._low):
            return np.full(len(points), len(self.classes) - 1)
        at = np.maximum(np.searchsorted(self._low, points, side="right") - 1, 0)
        inside = (points >= self._low[at]) & (points <= self._high[at])
        return np.where(inside, self._class[at], len(self.classes) - 1)

    def analyze_all(self, texts: Iterable[str]) -> list[list[Token]]:
        """Tokens of each text; texts are taken together up to SLICE_CHARS (a longer one alone)."""
        out, part, size = [], [], 0
        for text in texts:
            if part and size + len(text) > SLICE_CHARS:
                out += self._analyze(part)
                part, size = [], 0
            part.append(text)
            size += len(text)
        return out + self._analyze(part)

    def _analyze(self, texts: list[str]) -> list[list[Token]]:
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        which, end, number = self._trie.prefixes(raw, starts)
        order = np.argsort(which, kind="stable")
        chars = np.searchsorted(starts, end[order])
        bounds = np.searchsorted(which[order], np.arange(len(starts) + 1)).tolist()
        ends, numbers, kinds = chars.tolist(), number[order].tolist(), self.class_of(points).tolist()
        out, at = [], 0
        for text in texts:
            stop, tokens = at + len(text), []
            while at < stop:
                if whole[at].isspace():
                    at += 1
                    continue
                to = at
                while to < stop and not whole[to].isspace():
                    to += 1
                tokens += self._best_path(whole, at, to, bounds, ends, numbers, kinds)
                at = to
            out.append(tokens)
        return out

    def analyze(self, text: str) -> list[Token]:
        return self.analyze_all([text])[0]

    def candidates(self, whole: str, at: int, stop: int, bounds: list[int], ends: list[int], numbers: list[int], kinds: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
        """(end, left id, right id, cost, word or -1 - class) of the lattice's words that begin at a character."""
        known = False
        for k in range(bounds[at], bounds[at + 1]):
            if ends[k] <= stop:
                known = True
                for i in self._ids[numbers[k]]:
                    w = self.words[i]
                    yield ends[k], w.left, w.right, w.cost + self._extra[numbers[k]], i
        kind = kinds[at]
        c = self.classes[kind]
        if known and not c.always:
            return
        run = at + 1
        while run < stop and kinds[run] == kind and (c.grouped or run - at < max(1, c.longest)):
            run += 1
        lengths = {*range(1, min(c.longest, run - at) + 1), *([run - at] if c.grouped else [])} or {1}
        for n in sorted(lengths):
            yield at + n, c.left, c.right, c.cost + n * c.per_char, -1 - kind

    def _best_path(self, whole: str, at: int, stop: int, *lattice: list[int]) -> list[Token]:
        cost_of = self.connections
        # best[i][right id] = (cost, begin of the last word, right id before it, word)
        best: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in range(stop - at + 1)]
        best[0][0] = (0, 0, 0, 0)
        for i in range(stop - at):
            if not best[i]:
                continue
            before = list(best[i].items())
            for end, left, right, cost, word in self.candidates(whole, at + i, stop, *lattice):
                total, r = min((state[0] + cost_of.get((r, left), 0), r) for r, state in before)
                held = best[end - at].get(right)
                if held is None or total + cost < held[0]:
                    best[end - at][right] = (total + cost, i, r, word)
        _, r = min((state[0] + cost_of.get((r, 0), 0), r) for r, state in best[-1].items())
        found, i = [], stop - at
        while i:
            _, begin, r, word = best[i][r]
            kind = self.words[word] if word >= 0 else self.classes[-1 - word]
            found.append(Token(whole[at + begin : at + i], kind.pos, kind.detail))
            i = begin
        return found[::-1]


def lexicon_from_tables(words: DataFrame, connections: DataFrame, classes: DataFrame, decompose: Decompose | None = Decompose()) -> Lexicon:
    """A lexicon from tables.

    words: surface, left_id, right_id, cost, pos, detail. connections: right_id, left_id, cost (pairs that are missing cost 0). classes: name, ranges
    (array of struct first, last), always, grouped, longest, left_id, right_id, cost, per_char, pos, detail. Words are counted before they come to the driver; more than MOST_WORDS are an error.
    Null or empty surfaces are left out, repeated rows have no effect.
    """
    known = words.where("surface is not null and surface <> ''").select("surface", "left_id", "right_id", "cost", "pos", "detail").distinct()
    if known.count() > MOST_WORDS:
        raise ValueError(f"a lexicon holds at most {MOST_WORDS} words")
    entries = sorted((Word(r[0], r[1], r[2], r[3], r[4], r[5] or "*") for r in known.toLocalIterator()), key=lambda w: (w.surface, w.cost, w.left, w.right, w.pos, w.detail))
    costs = {(r["right_id"], r["left_id"]): r["cost"] for r in connections.collect()}
    kinds = [
        CharClass(r["name"], tuple((x["first"], x["last"]) for x in r["ranges"] or ()), r["always"], r["grouped"], r["longest"], r["left_id"], r["right_id"], r["cost"], r["per_char"], r["pos"], r["detail"] or "*")
        for r in sorted(classes.collect(), key=lambda r: (not r["ranges"], r["name"]))
    ]
    return Lexicon(entries, costs, tuple(kinds), decompose)


_TOKENS = T.ArrayType(T.StructType([T.StructField("surface", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("detail", T.StringType())]))


def analyzer_columns(spark: SparkSession, lexicon: Lexicon) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Two functions of a text column: its surfaces, and its tokens as structs; null for null. The lexicon goes to each executor once."""
    shared = spark.sparkContext.broadcast(lexicon)

    def each(batches: Iterator[pd.Series], of: Callable[[Token], object]) -> Iterator[pd.Series]:
        for texts in batches:
            found = shared.value.analyze_all(texts.fillna(""))
            yield pd.Series([None if t is None else [of(x) for x in f] for t, f in zip(texts, found, strict=True)], dtype=object)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def surfaces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from each(batches, lambda t: t.surface)

    @F.pandas_udf(_TOKENS)
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from each(batches, lambda t: {"surface": t.surface, "pos": t.pos, "detail": t.detail})

    return surfaces, tokens
