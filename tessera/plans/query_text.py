"""The query language: parsing, dictionary rewriting, term selection. A query is a single string, so this is plain Python; rewriter() serves columns of queries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.analysis import ANALYZERS, dropped_from_content, is_index_symbol, is_noise, is_symbol
from tessera.functions.lattice import MOST_WORDS, DoubleArray

#: What separates terms of a query. Fixed value.
DELIMITERS = " \t\n\r　,，、"
_D = re.escape(DELIMITERS)
_ATOM = re.compile(rf'(?P<no>-(?=[^{_D}]))?(?:"(?P<phrase>[^"]*)"|(?P<open>".*\Z)|(?P<term>[^{_D}"][^{_D}]*))|(?P<gap>[{_D}]+)', re.S)


@dataclass
class ParsedQuery:
    includes: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    exclude_phrases: list[str] = field(default_factory=list)


def parse(raw: str) -> ParsedQuery:
    """Free terms, "required phrases", -excluded terms and -"excluded phrases".

    A quote without its end makes the rest of the query one term that keeps the quote; a hyphen within a word, or before a gap or
    the end, is a literal; blank phrases vanish.
    """
    out = ParsedQuery()
    for m in _ATOM.finditer(raw):
        if m["gap"]:
            continue
        if m["phrase"] is not None:
            if m["phrase"].strip():
                (out.exclude_phrases if m["no"] else out.phrases).append(m["phrase"].strip())
        else:
            text = (m["open"] or m["term"]).strip()
            if text:
                (out.excludes if m["no"] else out.includes).append(text)
    return out


class WordMatcher:
    """Registered words in a double-array trie: matches() finds them from left to right, of those that begin at one place the longest, none within another."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted({w.strip() for w in words if w and w.strip()})
        self.trie = DoubleArray([w.encode("utf-8", "surrogatepass") for w in self.words])

    def matches(self, text: str) -> list[tuple[int, int]]:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        which, end, _ = self.trie.prefixes(raw, starts)
        longest = np.zeros(len(starts), np.int64)
        np.maximum.at(longest, which, np.searchsorted(starts, end))
        out, at = [], 0
        for begin in np.flatnonzero(longest).tolist():
            if begin >= at:
                at = int(longest[begin])
                out.append((begin, at))
        return out


def rewrite_with_dictionary(query: str, dictionary: Iterable[str] | WordMatcher) -> str:
    """Wraps the longest dictionary words within free atoms in quotes, the pieces separated by spaces.

    Quoted spans stay; a hyphen is copied and so binds only to the first piece.
    """
    known = dictionary if isinstance(dictionary, WordMatcher) else WordMatcher(dictionary)
    if not known.words:
        return query

    def atom(text: str) -> str:
        pieces, at = [], 0
        for begin, end in known.matches(text):
            pieces += [text[at:begin]] if begin > at else []
            pieces.append(f'"{text[begin:end]}"')
            at = end
        return " ".join([*pieces, text[at:]] if text[at:] else pieces)

    spans = re.compile(rf'-?"[^"]*(?:"|\Z)|-(?=[{_D}]|\Z)|(-?)([^{_D}"-][^{_D}]*)', re.S)
    return spans.sub(lambda m: m[0] if m[2] is None else (m[1] or "") + atom(m[2]), query)


def rewriter(words: DataFrame) -> Callable[[Column], Column]:
    """A function of a column of queries that rewrites each by a table of registered words (column `word`).

    The words go to each executor once, as a trie; they are counted first, and more than lattice.MOST_WORDS are an error.
    """
    known = words.where("word is not null and trim(word) <> ''").select("word").distinct()
    if known.count() > MOST_WORDS:
        raise ValueError(f"a dictionary holds at most {MOST_WORDS} words")
    shared = words.sparkSession.sparkContext.broadcast(WordMatcher(r[0] for r in known.toLocalIterator()))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for queries in batches:
            yield queries.map(lambda q: None if q is None else rewrite_with_dictionary(q, shared.value))

    return run


def content_tokens(text: str, analyzer: str = "unicode_word", pos_filter: bool = True) -> list[str]:
    """Distinct content terms, nouns first; if all are dropped, those that are no symbol or noise."""
    tokens = [t for t in ANALYZERS[analyzer](text) if t.surface.strip()]
    gone = {t.surface for t in tokens if (dropped_from_content(t) if pos_filter else is_noise(t.surface) or is_symbol(t))}
    kept = [t for t in tokens if t.surface not in gone and not is_index_symbol(t.surface)]
    if pos_filter:
        kept.sort(key=lambda t: t.pos != "名詞")
    found = list(dict.fromkeys(t.surface for t in kept))
    return found or list(dict.fromkeys(t.surface for t in tokens if not is_index_symbol(t.surface) and not is_noise(t.surface)))


def content_surfaces(text: str, analyzer: str = "unicode_word", pos_filter: bool = True) -> list[str]:
    """As content_tokens(), but falling back to the text itself unless that is a stop fragment."""
    found = content_tokens(text, analyzer, pos_filter)
    return found or ([text.strip()] if text.strip() and not is_noise(text) else [])


def passage_tokens(text: str, analyzer: str = "unicode_word") -> list[str]:
    """All terms in order, particles included, without symbols."""
    return [t.surface for t in ANALYZERS[analyzer](text) if t.surface.strip() and not is_index_symbol(t.surface)]


def phrase_tokens(text: str, analyzer: str = "unicode_word") -> list[str]:
    return passage_tokens(text, analyzer) or ([text.strip()] if text.strip() else [])


def highlight_terms(parsed: ParsedQuery, analyzer: str = "unicode_word", pos_filter: bool = True) -> list[str]:
    """What to mark in results: content terms and whole phrases; without the filter also raw terms and phrase pieces."""
    out: list[str] = []
    for raw in parsed.includes:
        found = content_tokens(raw, analyzer, pos_filter)
        out += ([raw] if not pos_filter or found == [raw] else []) + found
    for phrase in parsed.phrases:
        out += [phrase] if pos_filter else [phrase, *phrase_tokens(phrase, analyzer)]
    return [t for t in dict.fromkeys(out) if t and not (pos_filter and is_noise(t))]


def proximity_tokens(parsed: ParsedQuery, analyzer: str = "unicode_word", pos_filter: bool = True) -> list[str]:
    return list(dict.fromkeys([t for raw in parsed.includes for t in content_tokens(raw, analyzer, pos_filter)] + parsed.phrases))


def least_overlap(parsed: ParsedQuery, tokens: list[str], pos_filter: bool, loose: bool) -> int:
    """How many distinct tokens a hit must hold."""
    if not tokens:
        return 0
    return 1 if not parsed.includes or pos_filter or loose else -(-len(tokens) // 2)


def search_terms(query: str, analyzer: str = "unicode_word") -> list[str]:
    """Terms a query adds to the history: phrases whole, content terms, and raw terms of two characters or more."""
    parsed = parse(query)
    out = list(parsed.phrases)
    for raw in parsed.includes:
        out += content_surfaces(raw, analyzer) + ([raw] if len(raw) >= 2 else [])
    return list(dict.fromkeys(t.strip() for t in out if t.strip()))


def last_token(query: str) -> str | None:
    """The token being typed, without a leading hyphen; empty if there is none, null inside an unclosed phrase."""
    if query.count('"') % 2:
        return None
    pieces = re.findall(rf'"[^"]*"|[^{_D}"]+', query)
    if not pieces:
        return ""
    return pieces[-1].removeprefix("-").strip().strip('"')


def committed_terms(query: str) -> list[str]:
    parsed = parse(query)
    return list(dict.fromkeys(t.strip() for t in parsed.phrases + parsed.includes if t.strip()))


def apply_suggestion(query: str, term: str, kind: str) -> str:
    """The query with its last token completed (prefix), or with one more term."""
    quoted = f'"{term}"' if any(c in DELIMITERS for c in term) else term
    if kind == "prefix" and (last := re.search(rf"(-?)[^{_D}]+\Z", query)):
        return query[: last.start()] + last[1] + quoted + " "
    return query.rstrip(DELIMITERS) + (" " if query.strip(DELIMITERS) else "") + quoted + " "


def preview_terms(terms: list[str]) -> list[str]:
    """Terms to mark in a preview: markup removed, with a letter or digit, none contained in a longer one."""
    bare = dict.fromkeys(re.sub(r"[*_`#>\[\]()!]+", "", t).strip() for t in terms)
    kept: list[str] = []
    for t in sorted((t for t in bare if any(c.isalnum() for c in t)), key=len, reverse=True):
        if not any(t in k for k in kept):
            kept.append(t)
    return kept
