import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import analysis
from tessera.functions.lattice import CharClass, Decompose, DoubleArray, Lexicon, Token, Word, lexicon_from_tables
from tessera.operators.index import SearchIndex
from tessera.plans import query_text as qt
from tessera.plans import search


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5), max_size=40), st.binary(max_size=30))
def test_double_array_finds_all_prefixes(words, text):
    words = sorted(words, key=hash)
    found = DoubleArray(words).prefixes(np.frombuffer(text, np.uint8), np.arange(len(text)))
    got = sorted(zip(*(x.tolist() for x in found)))
    assert got == sorted((i, i + len(w), n) for i in range(len(text)) for n, w in enumerate(words) if text.startswith(w, i))


def test_double_array_of_many_words():
    rng = random.Random(1)
    words = sorted({bytes(rng.choices(b"abcdefgh\xe3\x81\x82", k=rng.randrange(1, 12))) for _ in range(20_000)})
    trie = DoubleArray(words)
    raw = np.frombuffer(b"".join(words[:500]), np.uint8)
    starts = np.cumsum([0, *(len(w) for w in words[:499])])
    which, end, number = trie.prefixes(raw, starts)
    own = {(int(i), int(e)) for i, e, n in zip(which, end, number)}
    assert all((i, s + len(words[i])) in own for i, s in enumerate(starts.tolist()))


def random_lexicon(rng, decompose):
    words = [Word("".join(rng.choices("山川あア", k=rng.randrange(1, 5))), rng.randrange(3), rng.randrange(3), rng.randrange(-50, 400), rng.choice(["名詞", "助詞"])) for _ in range(rng.randrange(0, 14))]
    connections = {(r, left): rng.randrange(-100, 300) for r in range(3) for left in range(3) if rng.random() < 0.7}
    classes = [CharClass("K", (("一", "龯"),), rng.random() < 0.5, rng.random() < 0.5, rng.randrange(3), 1, 2, rng.randrange(100, 600), rng.randrange(50)), CharClass("H", (("ぁ", "ゖ"),), rng.random() < 0.5, True, 1, 2, 1, 300)]
    return Lexicon(words, connections, tuple(classes), decompose)


def all_paths(lexicon, text, at=0):
    """Every way to cover a text: lists of (surface, left, right, cost), by plain recursion."""
    if at == len(text):
        yield []
        return
    options = [(w.surface, w.left, w.right, w.cost + (lexicon.decompose.of(w.surface) if lexicon.decompose else 0)) for w in lexicon.words if text.startswith(w.surface, at)]
    kind = lambda c: next((k for k in lexicon.classes if any(a <= c <= b for a, b in k.ranges)), lexicon.classes[-1])
    c = kind(text[at])
    if not options or c.always:
        run = 1
        while at + run < len(text) and kind(text[at + run]) is c:
            run += 1
        sizes = set(range(1, min(run, c.longest) + 1)) | ({run} if c.grouped else set())
        options += [(text[at : at + n], c.left, c.right, c.cost + n * c.per_char) for n in sizes or {1}]
    for o in options:
        for rest in all_paths(lexicon, text, at + len(o[0])):
            yield [o, *rest]


def cost_of(lexicon, path):
    total, right = 0, 0
    for _, left, r, cost in path:
        total += cost + lexicon.connections.get((right, left), 0)
        right = r
    return total + lexicon.connections.get((right, 0), 0)


@pytest.mark.parametrize("seed", range(120))
def test_best_path_equals_an_exhaustive_search(seed):
    rng = random.Random(seed)
    lexicon = random_lexicon(rng, Decompose(2, 120, 3, 70) if seed % 2 else None)
    text = "".join(rng.choices("山川あアx", k=rng.randrange(1, 9)))
    paths = list(all_paths(lexicon, text))
    least = min(cost_of(lexicon, p) for p in paths)
    tokens = lexicon.analyze(text)
    assert "".join(t.surface for t in tokens) == text
    assert [t.surface for t in tokens] in [[o[0] for o in p] for p in paths if cost_of(lexicon, p) == least]


def test_batches_blanks_and_long_texts():
    rng = random.Random(4)
    lexicon = random_lexicon(rng, None)
    texts = ["", " ", "山川 あ\nア", "x" * 5000, "山あ" * 150_000, "𠮷\ud800é", "川"]
    got = lexicon.analyze_all(texts)
    assert got == [lexicon.analyze(t) for t in texts]
    assert ["".join(x.surface for x in t) for t in got] == ["".join(t.split()) for t in texts]
    assert Lexicon([]).analyze("山") == [Token("山", "名詞")]


def test_long_compounds_are_taken_apart():
    words = [Word(w, 0, 0, 1000, "名詞") for w in ("損害", "賠償", "請求")] + [Word("損害賠償", 0, 0, 1500, "名詞"), Word("損害賠償請求", 0, 0, 1600, "名詞")]
    assert [t.surface for t in Lexicon(words).analyze("損害賠償請求")] == ["損害", "賠償", "請求"]
    assert [t.surface for t in Lexicon(words, decompose=None).analyze("損害賠償請求")] == ["損害賠償請求"]


@pytest.fixture(scope="module")
def japanese(spark):
    rows = [
        ("契約", 1, 1, 3000, "名詞", "一般"), ("書", 1, 1, 5000, "名詞", "接尾"), ("損害", 1, 1, 3000, "名詞", "一般"), ("賠償", 1, 1, 3000, "名詞", "サ変接続"), ("作成", 1, 1, 3000, "名詞", "サ変接続"), ("光景", 1, 1, 3000, "名詞", "一般"), ("弁済", 1, 1, 3000, "名詞", "一般"),
        ("代位", 1, 1, 3000, "名詞", "一般"), ("による", 2, 2, 1500, "助詞", "格助詞"), ("について", 2, 2, 1500, "助詞", "格助詞"), ("の", 2, 2, 500, "助詞", "連体化"), ("を", 2, 2, 500, "助詞", "格助詞"), ("し", 3, 3, 1500, "動詞", "自立"), ("まし", 4, 4, 1000, "助動詞", None),
        ("た", 4, 4, 700, "助動詞", None), ("そうした", 5, 5, 1500, "連体詞", None), ("見慣れ", 3, 3, 4000, "動詞", "自立"), ("て", 2, 2, 900, "助詞", "接続助詞"), ("い", 3, 3, 900, "動詞", "非自立"), ("ます", 4, 4, 800, "助動詞", None), ("契約", 1, 1, 3000, "名詞", "一般"), (None, 1, 1, 1, "名詞", None), ("", 1, 1, 1, "名詞", None),
    ]
    words = spark.createDataFrame(rows, "surface string, left_id int, right_id int, cost int, pos string, detail string")
    connections = spark.createDataFrame([(1, 2, -500), (2, 1, -300), (3, 4, -800), (4, 4, -500), (1, 3, -200)], "right_id int, left_id int, cost int")
    schema = "name string, ranges array<struct<first: string, last: string>>, always boolean, grouped boolean, longest int, left_id int, right_id int, cost int, per_char int, pos string, detail string"
    kinds = [("OTHER", None, False, True, 0, 1, 1, 12000, 0, "名詞", "一般"), ("KANJI", [{"first": "一", "last": "龯"}], False, False, 2, 1, 1, 11000, 0, "名詞", "一般"), ("SIGN", [{"first": "、", "last": "。"}], False, False, 1, 0, 0, 1000, 0, "記号", "句点")]
    tokens = analysis.use_lexicon(spark, lexicon_from_tables(words, connections, spark.createDataFrame(kinds, schema)), "ja_test")
    return tokens


def test_content_and_phrases_of_japanese_queries(japanese):
    assert qt.content_tokens("契約についての損害賠償", "ja_test") == ["契約", "損害", "賠償"]
    assert qt.phrase_tokens("弁済による代位", "ja_test") == ["弁済", "による", "代位"]
    assert qt.content_tokens("契約書を作成しました", "ja_test") == ["契約", "書", "作成"]
    assert qt.content_tokens("そうした光景を見慣れています", "ja_test") == ["光景", "見慣れ"]


def test_an_index_by_a_lexicon(spark, japanese):
    bodies = ["契約書を作成しました。", "損害賠償の契約", None, "", "そうした光景を見慣れています"]
    units = spark.createDataFrame([(i, "", b, f"p/{i}.txt") for i, b in enumerate(bodies)], "unit_key long, title string, body string, path string")
    index = SearchIndex.build(units, analyzer="ja_test")
    found = lambda q: sorted(r["unit_key"] for r in search.retrieve(index, q).collect())
    assert found("契約") == [0, 1] and found("契約についての光景") == [0, 1, 4] and found('"損害賠償"') == [1] and found('契約 -"書を"') == [1]
    tokens = units.select("unit_key", japanese(F.col("body")).alias("t")).collect()
    assert [x["surface"] for x in tokens[0]["t"]] == ["契約", "書", "を", "作成", "し", "まし", "た", "。"] and tokens[2]["t"] is None and tokens[3]["t"] == []


def test_too_large_a_lexicon_is_refused(spark, monkeypatch):
    monkeypatch.setattr("tessera.functions.lattice.MOST_WORDS", 3)
    words = spark.range(4).selectExpr("cast(id as string) as surface", "0 as left_id", "0 as right_id", "1 as cost", "'名詞' as pos", "cast(null as string) as detail")
    with pytest.raises(ValueError, match="at most 3"):
        lexicon_from_tables(words, spark.createDataFrame([], "right_id int, left_id int, cost int"), spark.createDataFrame([], "name string, ranges array<struct<first: string, last: string>>"))


def test_demonstratives_follow_from_their_paradigm():
    forms = {w.surface for w in analysis.builtin_lexicon().words if w.pos == "連体詞"}
    assert {"この", "その", "あの", "どの", "そうした", "ああいう"} <= forms and len(forms) == 12
