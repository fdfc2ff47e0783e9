from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import paths, present
from tessera.functions.automaton import SuffixAutomaton
from tessera.operators.index import SearchIndex, units_of
from tessera.plans import search


def plain_anchor(body, query, marks):
    """Every mark, the query, and every part of it, in order, looked for one by one."""
    low, q = body.lower(), query.strip()
    parts = (q[i : i + n] for n in range(len(q) - 1, 1, -1) for i in range(len(q) - n + 1))
    for term in (*sorted((m for m in marks if m), key=len, reverse=True), *([q] if q else []), *(p for p in parts if p not in present.STOP_SURFACES)):
        if (at := low.find(term.lower())) >= 0:
            return at, len(term)
    return None


LETTERS = st.text("abAB しまたすΣİ", max_size=14)


@settings(max_examples=600, deadline=None)
@given(st.text("abAB しまたすΣİ", max_size=60), LETTERS, st.lists(LETTERS, max_size=2))
def test_anchors_are_those_of_a_plain_search(body, query, marks):
    assert present.Anchors(query, marks).find(body) == plain_anchor(body, query, marks)


@settings(max_examples=600, deadline=None)
@given(st.text("abc", max_size=20), st.text("abcd", max_size=40))
def test_longest_common_substring(text, body):
    parts = [(n, -i) for n in range(1, len(text) + 1) for i in range(len(text) - n + 1) if text[i : i + n] in body]
    if not parts:
        assert SuffixAutomaton(text).longest_in(body) == (0, 0, 0)
        return
    n, i = max(parts)
    assert SuffixAutomaton(text).longest_in(body) == (n, -i, body.find(text[-i : n - i]))


PATHS = ["a", "A\\x.txt", "a/b/y.txt", "ab/z.txt", "a]x", "a[x", "outlook:a/e", "C:\\", "c:/a/x", "\\\\?\\C:\\a\\y", "\\\\srv\\s\\f", "\\\\?\\UNC\\srv\\s\\f", "", None]


def test_key_ranges_are_prefix_scopes(spark):
    table = spark.createDataFrame([(p,) for p in PATHS], "path string")
    stored = table.withColumn(paths.SCOPE_KEY, paths.scope_key(F.col("path")))
    for scope in ["a", "A/", "a\\b", "c:\\", "C:/A", "\\\\SRV\\s", "", "none", "outlook:a", "a["]:
        want = sorted(r[0] for r in table.where(paths.in_scope(F.col("path"), scope)).collect())
        assert sorted(r["path"] for r in paths.within_scope(stored, scope).collect()) == want, scope
        assert sorted(r["path"] for r in paths.within_scope(table, scope).collect()) == want, scope


def saved(spark, folder, rows):
    files = spark.createDataFrame(rows, "unit_key long, path string, body string")
    SearchIndex.build(units_of(files, F.col("path"), F.lit(""), F.col("body"), extra={"unit_key": F.col("unit_key")})).save(folder)
    return SearchIndex.load(spark, folder)


def test_a_scope_reaches_the_scan_and_comes_before_the_top_list(spark, tmp_path, capsys):
    rows = [(i, f"many/{i}.txt", "word word word") for i in range(500)] + [(900, "Few/x.txt", "some other text with one word in it and many more than the others have")]
    index = saved(spark, f"{tmp_path}/i", rows)
    found = search.search_units(index, "word", 1, scope="few")
    assert [r["unit_key"] for r in found.collect()] == [900] and paths.SCOPE_KEY not in found.columns
    paths.within_scope(index.units, "few").select("unit_key").explain()
    plan = capsys.readouterr().out
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert f"GreaterThanOrEqual({paths.SCOPE_KEY},few\\)" in pushed and f"LessThan({paths.SCOPE_KEY},few])" in pushed and f"EqualTo({paths.SCOPE_KEY},few)" in pushed
    assert paths.SCOPE_KEY not in search.preview(index, 900).columns


def test_an_empty_scope_is_not_searched_loosely(spark, tmp_path):
    index = saved(spark, f"{tmp_path}/i", [(1, "a/1.txt", "alpha"), (2, "b/2.txt", "beta")])
    assert search.search_units(index, "alpha", 5, scope="b").count() == 0
    assert search.search_units(index, "alpha", 5, scope="none").count() == 0
