import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.functions.analysis import Token, analyze_ja, dropped_from_content, is_index_symbol, is_noise
from tessera.plans import query_text as qt


@pytest.mark.parametrize("raw", ["foo bar -baz", "foo　bar　-baz", "foo,bar,-baz", "foo、bar、-baz", "foo，bar -baz"])
def test_delimiters(raw):
    p = qt.parse(raw)
    assert (p.includes, p.excludes, p.phrases) == (["foo", "bar"], ["baz"], [])


def test_phrases_and_exclusions():
    p = qt.parse('a "two words" -"not these" -gone - end-')
    assert p == qt.ParsedQuery(["a", "-", "end-"], ["two words"], ["gone"], ["not these"])


def test_unclosed_quote_blank_phrase_and_hyphens():
    assert qt.parse('x "open phrase here').includes == ["x", '"open phrase here']
    assert qt.parse('"  " ""') == qt.ParsedQuery()
    assert qt.parse("well-known").includes == ["well-known"]
    assert qt.parse("") == qt.ParsedQuery()


@given(st.text(alphabet='ab -",、　\n', max_size=25))
def test_parser_never_fails(raw):
    p = qt.parse(raw)
    assert all(x.strip() for x in p.includes + p.phrases + p.excludes + p.exclude_phrases)


def test_dictionary_rewriting():
    words = ["損害賠償", "賠償", "請求"]
    assert qt.rewrite_with_dictionary("損害賠償", words) == '"損害賠償"'
    assert qt.rewrite_with_dictionary("私の 損害賠償", words) == '私の "損害賠償"'
    assert qt.rewrite_with_dictionary("この損害賠償請求について", words) == 'この "損害賠償" "請求" について'
    assert qt.rewrite_with_dictionary('"損害賠償" -賠償x', words) == '"損害賠償" -"賠償" x'
    assert qt.rewrite_with_dictionary("a b", []) == "a b" == qt.rewrite_with_dictionary("a b", words)


def test_japanese_tokens():
    found = analyze_ja("この光景を見た、そして泣いた。")
    assert [t.surface for t in found][:3] == ["この", "光景", "を"]
    kept = [t.surface for t in found if not dropped_from_content(t)]
    assert "光景" in kept and not {"この", "を", "そして", "、", "。"} & set(kept)
    assert qt.content_tokens("この光景を見た", "ja_lexicon")[0] == "光景"
    assert "を" in qt.passage_tokens("光景を見た", "ja_lexicon")
    assert dropped_from_content(Token("し", "動詞", "自立")) and is_noise("の") and is_index_symbol("!?")


def test_term_selection():
    p = qt.parse('alpha beta "gamma delta"')
    assert qt.highlight_terms(p) == ["alpha", "beta", "gamma delta"]
    assert qt.highlight_terms(p, pos_filter=False) == ["alpha", "beta", "gamma delta", "gamma", "delta"]
    assert qt.proximity_tokens(p) == ["alpha", "beta", "gamma delta"]
    assert qt.least_overlap(p, ["a", "b", "c"], False, False) == 2 and qt.least_overlap(p, ["a"] * 3, True, False) == 1
    assert qt.least_overlap(qt.parse('"x y"'), ["x y"], False, False) == 1 and qt.least_overlap(p, [], True, False) == 0
    assert qt.search_terms('foo "a b" -no foo') == ["a b", "foo"]


def test_last_token_and_suggestions():
    assert qt.last_token("alpha be") == "be" and qt.last_token("") == "" and qt.last_token('a "open') is None and qt.last_token("x -ne") == "ne"
    assert qt.committed_terms('alpha "b c" -d') == ["b c", "alpha"]
    assert qt.apply_suggestion("alpha -be", "beta", "prefix") == "alpha -beta "
    assert qt.apply_suggestion("alpha", "b c", "cooccur") == 'alpha "b c" '
    assert qt.preview_terms(["**bold**", "bold move", "--", "x"]) == ["bold move", "x"]


@given(st.lists(st.text(alphabet="abé山", min_size=1, max_size=4), max_size=8), st.text(alphabet="abé山", max_size=20))
def test_words_match_leftmost_and_longest(words, text):
    want, at = [], 0
    while at < len(text):
        here = max((len(w) for w in words if text.startswith(w, at)), default=0)
        want += [(at, at + here)] if here else []
        at += here or 1
    assert qt.WordMatcher(words).matches(text) == want


def test_a_column_of_queries(spark):
    words = spark.createDataFrame([("損害賠償",), ("賠償",), (None,), (" ",), ("請求",), ("請求",)], "word string")
    rows = spark.createDataFrame([(1, "この損害賠償請求について"), (2, None), (3, '"損害賠償" -賠償x'), (4, "")], "i int, q string")
    got = {r["i"]: r["t"] for r in rows.select("i", qt.rewriter(words)("q").alias("t")).collect()}
    assert got == {1: 'この "損害賠償" "請求" について', 2: None, 3: '"損害賠償" -"賠償" x', 4: ""}
