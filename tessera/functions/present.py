"""Presentation columns: snippets, highlights, scores."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.functions.analysis import STOP_SURFACES
from tessera.functions.automaton import SuffixAutomaton

RADIUS = 100


#: Stop surfaces are no longer than this, so that any longer part of a query may be an anchor.
LONGEST_STOP = max(map(len, STOP_SURFACES))


class Anchors:
    """Where the snippets of a query's hits are cut: around the longest mark found without case, else the query, else its longest part that is no stop word, else at the head.

    Of marks and parts of one length the first counts. The query's parts are one suffix automaton, which every body is read through once.
    """

    def __init__(self, query: str, marks: list[str]):
        self.query = query.strip()
        self.marks = [m.lower() for m in sorted((m for m in marks if m), key=len, reverse=True)]
        self.widths = sorted(map(len, filter(None, marks)), reverse=True)
        self.low = self.query.lower()
        #: Lower case is letter by letter, so that places in it are places in the query.
        self.plain = len(self.low) == len(self.query) and "Σ" not in self.query
        self.automaton = SuffixAutomaton(self.low) if self.plain else None

    def _part(self, low: str) -> tuple[int, int] | None:
        """Place and length of the longest part of the query, of two characters at least, that is no stop word."""
        q, most = self.query, len(self.query) - 1
        if self.automaton is not None:
            most, _, at = self.automaton.longest_in(low)
            if most > LONGEST_STOP:
                return at, most
        for n in range(most, 1, -1):
            for i in range(len(q) - n + 1):
                part = q[i : i + n]
                if part not in STOP_SURFACES and (at := low.find(part.lower())) >= 0:
                    return at, n
        return None

    def find(self, body: str) -> tuple[int, int] | None:
        """Place and length of a body's anchor."""
        low = body.lower()
        for mark, width in zip(self.marks, self.widths, strict=True):
            if (at := low.find(mark)) >= 0:
                return at, width
        if self.query and (at := low.find(self.low)) >= 0:
            return at, len(self.query)
        return self._part(low)

    def snippet(self, body: str, radius: int = RADIUS) -> str:
        """A window around the anchor with an ellipsis where text is left out."""
        start, end = 0, min(len(body), radius)
        if (found := self.find(body)) is not None:
            at, width = found
            start, end = max(0, at - radius // 3), min(len(body), at + width + radius * 2 // 3)
        return ("…" if start else "") + body[start:end] + ("…" if end < len(body) else "")


def snippet(body: str, query: str, marks: list[str], radius: int = RADIUS) -> str:
    """The snippet of one body, see Anchors."""
    return Anchors(query, marks).snippet(body, radius)


def snippet_column(body: Column, query: str, marks: list[str], radius: int = RADIUS) -> Column:
    """snippet() over a column of bodies (Arrow batches); null bodies have none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        anchors = Anchors(query, marks)
        for bodies in batches:
            yield bodies.map(lambda b: None if b is None else anchors.snippet(b, radius))

    return run(body)


def anchored_snippet(body: Column, marks: list[str], radius: int = RADIUS) -> Column:
    """The same for the first two anchors as an expression: the longest mark that occurs, else the head."""
    low = F.lower(body)
    at, size = F.lit(0), F.lit(0)
    for m in sorted(marks, key=len):
        found = F.locate(m.lower(), low)
        at, size = F.when(found > 0, found).otherwise(at), F.when(found > 0, F.lit(len(m))).otherwise(size)
    start = F.when(at > 0, F.greatest(at - 1 - radius // 3, F.lit(0))).otherwise(F.lit(0))
    end = F.least(F.when(at > 0, at - 1 + size + radius * 2 // 3).otherwise(F.lit(radius)), F.length(body))
    cut = F.substring(body, start + 1, end - start)
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.length(body), "…").otherwise(""))


def marks_in(text: Column, marks: list[str]) -> Column:
    """Those marks that the text contains, longest first (ties: as given)."""
    ordered = sorted(marks, key=len, reverse=True)
    return F.filter(F.array(*(F.lit(m) for m in ordered)).cast("array<string>"), lambda m: F.contains(text, m))


def highlight(text: Column, marks: list[str]) -> Column:
    """The text with <mark> around every mark, longest first, without case."""
    if not marks:
        return text
    either = "|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True))
    return F.regexp_replace(text, f"(?i)({either})", "<mark>$1</mark>")


def score_bucket(score: Column, window: Window | None = None) -> Column:
    """1 to 5 by share of the best score; 1 where that is not above 0."""
    top = F.max(score).over(window if window is not None else Window.partitionBy())
    return F.when(top <= 0, 1).otherwise(F.least(F.greatest(F.ceil(score / top * 5), F.lit(1)), F.lit(5))).cast("int")


def normalized(text: Column) -> Column:
    """Lower case without white space, for comparing bodies."""
    return F.lower(F.regexp_replace(text, r"[\s　 ]+", ""))


def trigrams(text: Column) -> Column:
    """The set of character trigrams of a normalized text; shorter ones stand for themselves."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(cut))


def trigram_codes(text: Column) -> Column:
    """trigrams() as numbers, a code point (from 1) in 21 bits each: equal where they are equal, made in one pass, and cheaper to compare."""
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long") + 1)
    at = lambda c, i, unit: F.coalesce(F.get(c, i), F.lit(0)) * F.lit(unit).cast("long")
    codes = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 3, F.lit(0))), lambda i: at(c, i, 1 << 42) + at(c, i + 1, 1 << 21) + at(c, i + 2, 1))
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.element_at(F.transform(F.array(points), codes), 1)))


def overlap_ratio(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Overlap of two normalized bodies with their trigrams: 1 if equal, length ratio if contained, else Dice; 0 if one is empty."""
    la, lb = F.length(a), F.length(b)
    inside = F.when(la <= lb, F.contains(b, a)).otherwise(F.contains(a, b))
    ratio = F.least(la, lb) / F.greatest(la, lb)
    dice = 2.0 * F.size(F.array_intersect(ta, tb)) / (F.size(ta) + F.size(tb))
    return F.when((la == 0) | (lb == 0), 0.0).when(a == b, 1.0).when(inside, ratio).otherwise(dice)


def overlap(a: str, b: str) -> float:
    """overlap_ratio() of two plain strings."""
    a, b = ("".join(x.split()).lower() for x in (a, b))
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if short in long:
        return len(short) / len(long)
    ta, tb = ({x[i : i + 3] for i in range(max(1, len(x) - 2))} for x in (a, b))
    return 2 * len(ta & tb) / (len(ta) + len(tb))


def proximity(text: str, tokens: list[str]) -> tuple[int, int, float]:
    """How many distinct tokens occur (case matters), the least window of characters that covers these, and its compactness."""
    hits = sorted((m.start(), m.end(), i) for i, t in enumerate(tokens) if t for m in re.finditer(re.escape(t), text))
    present = {i for *_, i in hits}
    if not present:
        return 0, 0, 0.05
    best, last = len(text), {}
    for start, end, i in hits:
        last[i] = start
        if len(last) == len(present):
            best = min(best, end - min(last.values()))
    ideal = sum(len(tokens[i]) for i in present)
    return len(present), max(1, best), min(1.0, max(0.05, ideal / max(1, best)))


def proximity_column(text: Column, tokens: list[str]) -> Column:
    """proximity() over a column: struct(overlap, span, compactness). A plain function, whose Python process holds a hundred texts at once; an Arrow batch has 10,000."""

    @F.udf("overlap int, span int, compactness double", useArrow=False)
    def run(t: str | None) -> tuple[int, int, float]:
        return proximity(t or "", tokens)

    return run(text)


def pretty_json(text: str) -> str:
    """Indented JSON, or the text itself where it is none."""
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return text


def hit_offset(text: str, probe: str) -> int | None:
    """Where a stretch (up to 200 characters, at least 8 without white space) occurs in a text, white space aside."""
    bare = "".join(probe.split())[:200]
    if len(bare) < 8:
        return None
    places = [i for i, c in enumerate(text) if not c.isspace()]
    at = "".join(text.split()).find(bare)
    return places[at] if at >= 0 else None


def markdown_breaks(text: Column) -> Column:
    """Line breaks before headings and list items that follow text on the same line."""
    return F.regexp_replace(text, r"(?<=[^\n#*\-\s])[ \t]+(?=(?:#{1,6} |[-*] |\d+\. ))", "\n")
