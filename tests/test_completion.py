import random

from tessera.operators import history
from tessera.operators.completion import CompletionIndex


def test_deltas_and_compaction_against_a_set(spark, tmp_path):
    rng, root = random.Random(5), str(tmp_path)
    words = [a + b for a in ("ab", "a", "日本", "B") for b in ("", "c", "cd", "語", "z ")]
    there = {w.strip() for w in words[:9]}
    index = CompletionIndex.build(spark.createDataFrame([(w,) for w in [*words[:9], words[0], " ", None]], "word string"), root, most=2)
    for turn in range(6):
        changes = [(rng.choice(words), rng.random() < 0.5) for _ in range(6)]
        added = {w.strip() for w, gone in changes if not gone}
        there = (there - {w.strip() for w, gone in changes if gone}) | added
        assert index.apply(spark.createDataFrame(changes, "word string, removed boolean")) == turn + 1
        for prefix in ("", "ab", "日"):
            got = [r["term"] for r in CompletionIndex(spark, root).starting(prefix).collect()]
            assert sorted(got) == sorted(w for w in there if w.startswith(prefix))
    # two merges: what the first replaced has gone, what the second replaced serves readers that began before it
    assert sorted(p.name for p in tmp_path.iterdir()) == ["base-3", "base-6", "delta-4", "delta-5", "delta-6"]
    (tmp_path / "delta-9").mkdir()  # of a job that died
    assert index.version() == 6
    plan = index.starting("ab")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,ab)" in plan


def test_first_words_are_enough(spark, tmp_path):
    words = spark.createDataFrame([(f"ca{k:02}",) for k in range(40)], "word string")
    stats = spark.createDataFrame([("ca03", 1, 900), ("ca39", 2, 100), ("cab", 1, 0), ("x", 5, 900)], "term string, count long, last long")
    events = spark.createDataFrame([(0, ["ca00", "x"], 900)], "rank int, terms array<string>, t long")
    index = CompletionIndex.build(words, str(tmp_path))
    for query in ("ca", "ca00 ca", "ca01 ca02 ca0", "ca0"):
        got = [tuple(r) for r in history.suggest(events, stats, index, query, 1000, n=6).collect()]
        assert got == [tuple(r) for r in history.suggest(events, stats, words, query, 1000, n=6).collect()]
        token, committed = query.split()[-1], query.split()[:-1]
        every = history.prefix_suggestions(stats, index, token, committed, 1000).orderBy("score", ascending=False).count()
        some = {tuple(r) for r in history.prefix_suggestions(stats, index, token, committed, 1000, first=6).collect()}
        whole = sorted((tuple(r) for r in history.prefix_suggestions(stats, words, token, committed, 1000).collect()), key=lambda r: (-r[2], r[0]))
        assert len(whole) == every and set(whole[:6]) <= some <= set(whole)
