"""Analyzers: text to terms. Per-document analysis is column expressions; the Japanese lexicon analyzer also serves queries.

The default analyzer `unicode_word` takes lower-cased runs of letters and digits. `ja_lexicon` is a lattice over a small built-in
lexicon of function words and script runs. use_lexicon() adds an analyzer over tables of words and costs (see lattice.py).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import lattice
from tessera.functions.lattice import Token

#: Surfaces dropped from free search. Fixed value.
STOP_SURFACES = frozenset(
    "の を に は が も と で へ や か など より から まで て た れ せ し さ いる ある する なる れる られる です ます でした ました という として について".split()
)
#: Characters that alone make up a symbol of a query, and of an index token. Fixed values.
QUERY_SYMBOLS = "()「」、。・\"'（）"
INDEX_SYMBOLS = "()「」、。・\"'（），,.!？?：:；;/\\…—-～~"

#: Function words of the built-in lexicon by part of speech and detail. Fixed values.
FUNCTION_WORDS = {
    ("助詞", "*"): "の を に は が も と で へ や か より から まで など",
    ("助詞", "接続助詞"): "て ば ながら",
    ("助動詞", "*"): "た だ です ます ない でした ました",
    ("接続詞", "*"): "そして しかし また",
    ("動詞", "非自立"): "いる ある なる しまう",
    ("動詞", "接尾"): "れる られる せる させる れ られ",
    ("動詞", "自立"): "する し さ",
}
#: Stems of demonstratives, near to far and asking. Fixed value.
DEMONSTRATIVES = "こそあど"


def builtin_lexicon() -> lattice.Lexicon:
    """Function words, and demonstratives by their paradigm (stem + の, stem + うした, stem + ういう; あ lengthens); all else is unknown runs of one script."""
    listed = [lattice.Word(w, 0, 0, 100, *kind) for kind, all_of in FUNCTION_WORDS.items() for w in all_of.split()]
    long = [(s, "あ" if s == "あ" else "う") for s in DEMONSTRATIVES]
    paradigm = [s + end for s, vowel in long for end in ("の", f"{vowel}した", f"{vowel}いう")]
    hiragana = lattice.CharClass("HIRAGANA", (("ぁ", "ゖ"),), always=True, longest=12, cost=300, per_char=10, pos="動詞", detail="自立")
    noun = lambda name, *ranges: lattice.CharClass(name, ranges, always=True, cost=150, per_char=1, detail="一般")
    kanji, katakana = noun("KANJI", ("一", "龯"), ("々", "〆")), noun("KATAKANA", ("ァ", "ヴ"), ("ー", "ー"))
    latin = noun("ALPHANUMERIC", ("0", "9"), ("A", "Z"), ("a", "z"), ("０", "９"), ("Ａ", "Ｚ"), ("ａ", "ｚ"))
    other = lattice.CharClass("OTHER", grouped=False, longest=1, cost=150, pos="記号", detail="一般")
    return lattice.Lexicon([*listed, *(lattice.Word(w, 0, 0, 100, "連体詞") for w in paradigm)], {}, (hiragana, kanji, katakana, latin, other), None)


_BUILTIN = builtin_lexicon()


def words(text: Column) -> Column:
    """Terms of the default analyzer in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def is_symbol(t: Token) -> bool:
    return t.pos == "記号" or all(c in QUERY_SYMBOLS for c in t.surface)


def is_single_hiragana(text: str) -> bool:
    return len(text) == 1 and "ぁ" <= text <= "ゖ"


def is_noise(text: str) -> bool:
    t = text.strip()
    return not t or t in STOP_SURFACES or is_single_hiragana(t)


def is_index_symbol(text: str) -> bool:
    return all(c in INDEX_SYMBOLS or c.isspace() for c in text)


def dropped_from_content(t: Token) -> bool:
    """Whether a token says nothing by itself: symbols, particles, auxiliaries, connectives, dependent verbs, stop surfaces."""
    if not t.surface.strip() or is_symbol(t) or t.pos in ("助詞", "助動詞", "連体詞", "接続詞", "感動詞"):
        return True
    return (t.pos == "動詞" and t.detail in ("非自立", "接尾")) or is_noise(t.surface)


def analyze_ja(text: str) -> list[Token]:
    """Tokens by the built-in lexicon. Characters outside the listed scripts that are letters of others are nouns, not symbols."""
    return [Token(t.surface, "名詞", t.detail) if t.pos == "記号" and t.surface.isalnum() else t for t in _BUILTIN.analyze(text)]


def analyze_words(text: str) -> list[Token]:
    return [Token(w, "名詞") for w in re.findall(r"[^\W_]+", text.lower())]


#: name -> analyzer of a query string.
ANALYZERS: dict[str, Callable[[str], list[Token]]] = {"unicode_word": analyze_words, "ja_lexicon": analyze_ja}


@F.pandas_udf(T.ArrayType(T.StringType()))
def ja_terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Surfaces of the built-in Japanese analyzer."""
    for text in batches:
        found = _BUILTIN.analyze_all(text.fillna(""))
        yield pd.Series([None if t is None else [x.surface for x in f] for t, f in zip(text, found, strict=True)], dtype=object)


#: name -> terms of a text column.
TERMS: dict[str, Callable[[Column], Column]] = {"unicode_word": words, "ja_lexicon": ja_terms}


def use_lexicon(spark: SparkSession, lexicon: lattice.Lexicon, name: str = "ja_lattice") -> Callable[[Column], Column]:
    """Makes a lexicon the analyzer `name` of indexes and queries in this process; returns its tokens of a text column as structs."""
    surfaces, tokens = lattice.analyzer_columns(spark, lexicon)
    ANALYZERS[name], TERMS[name] = lexicon.analyze, surfaces
    return tokens


def terms(text: Column, analyzer: str = "unicode_word") -> Column:
    return TERMS[analyzer](text)
