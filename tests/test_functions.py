import pytest
from pyspark.sql import functions as F

from tessera.functions import html, paths, present, segment


def column(spark, values, f, schema="v string"):
    rows = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in rows.select(f(F.col("v"))).collect()]


def test_normalize_path(spark):
    given = ["C:/a/b/", "\\\\?\\C:\\x", "\\\\?\\UNC\\srv\\share\\f", "\\\\srv\\share\\", "C:\\", "a\\\\b", "outlook:S/E/", None]
    assert column(spark, given, paths.normalize_path) == ["C:\\a\\b", "C:\\x", "\\\\srv\\share\\f", "\\\\srv\\share", "C:\\", "a\\b", "outlook:S/E/", None]


def test_prefixes(spark):
    rows = spark.createDataFrame([("C:\\docs\\a.txt", "c:\\DOCS"), ("C:\\docs2\\a", "C:\\docs"), ("C:\\x", "C:\\"), ("C:\\docs", "C:\\docs")], "p string, q string")
    assert [r[0] for r in rows.select(paths.has_prefix(F.col("p"), F.col("q"))).collect()] == [True, False, True, True]
    moved = rows.select(paths.rewrite_prefix(F.col("p"), F.lit("C:\\docs"), F.lit("\\\\srv\\pub"))).collect()
    assert [r[0] for r in moved] == ["\\\\srv\\pub\\a.txt", "C:\\docs2\\a", "C:\\x", "\\\\srv\\pub"]


def test_names(spark):
    assert column(spark, ["a/b.TXT", "a/.hidden", "a/x.", "a.b/c", "x.tar.gz"], paths.extension) == ["txt", "", "", "", "gz"]
    assert column(spark, ["C:\\a\\b", "C:\\a", "C:\\", "\\\\s\\sh", "x"], paths.parent_path) == ["C:\\a", "C:\\", None, None, None]
    assert column(spark, ["a/b/c.txt", "x"], paths.ancestors) == [["a", "a/b"], []]
    assert column(spark, ["C:\\a\\b", "C:\\"], paths.display_name) == ["b", "C:"]
    assert column(spark, ["C:\\r\\a\\b"], lambda c: paths.relative_label(c, F.lit("C:\\r"))) == ["r/a/b"]
    assert paths.normalize_extensions([" .PDF", "pdf", "..md", ""]) == ["pdf", "md"]


def test_mail_paths(spark):
    got = column(spark, ["outlook:s/e/x", "OUTLOOK:s/e", "outlook:s", "outlook:/e", "C:\\x"], paths.parse_mail_path)
    assert [tuple(x) if x else None for x in got] == [("s", "e/x"), ("s", "e"), None, None, None]
    assert column(spark, ["me@x/Inbox/Sub", "me@x", "Inbox"], lambda c: paths.mail_label(F.lit("me@x"), c)) == ["me@x / Inbox / Sub", "me@x", "me@x / Inbox"]
    assert column(spark, ["outlook:s/e", "C:\\a\\b"], lambda c: paths.in_scope(c, "c:/a")) == [False, True]
    assert column(spark, ["outlook:s/e", "C:\\a\\b"], lambda c: paths.in_scope(c, "mailfolder:in", F.lit("IN"))) == [True, False]


def test_html_text(spark):
    page = '<html><head><title>A &amp; B</title><STYLE>x</STYLE></head><body><!-- no --><p>one<br>two</p>three&#x41;&#66;&#9999999; &amp;lt; &nope; <noscript>n</noscript>&nbsp;<b>x</b>y<script>if(a<b)</script'
    assert column(spark, [page], html.html_text) == ["A & B\n\none\ntwo\n\nthreeAB&#9999999; &lt; &nope; xy"]
    assert column(spark, [page, "<p>x</p>", "<title> </title>"], html.html_title) == ["A & B", None, None]
    assert column(spark, ["a<!-- open", "<scripty>k</scripty>", "<script>rest"], html.remove_noise) == ["a<!-- open", "<scripty>k</scripty>", ""]
    assert column(spark, ["a\t b \n\n\n \u3000c\r\n"], html.collapse_whitespace) == ["a b\n\nc"]
    assert column(spark, ["a<x", "1 < 2 > 3"], html.strip_tags) == ["a", "1  3"]
    assert column(spark, [" \n plain ", "", None], lambda c: html.mail_body(c, F.lit("<p>h</p>"))) == ["plain", "h", "h"]


@pytest.mark.parametrize(
    ("content", "text"),
    [
        ("é".encode(), "é"), (b"\xef\xbb\xbfx", "x"), ("日本".encode("cp932"), "日本"), ('<meta charset="shift_jis">日'.encode("cp932"), '<meta charset="shift_jis">日'),
        (b"<?xml encoding='iso-8859-1'?>\xe9", "<?xml encoding='iso-8859-1'?>é"), (b"\xff\xfeh\x00i\x00", "hi"), (b"caf\xe9 \xa0\xff", "café \xa0ÿ"), (b'<meta charset="bogus">a', '<meta charset="bogus">a'),
    ],
)
def test_decoding(content, text):
    assert html.decode_html(content) == text


def fold(pages):
    """A plain model of segmentation."""
    blocks = [(b.strip(), i) for i, p in enumerate(pages, 1) for b in __import__("re").split(r"\n\s*\n", "\n".join(x.rstrip() for x in p.split("\n"))) if b.strip()]
    merged = []
    for b, page in blocks:
        if merged and (len(merged[-1][0]) < 40 or len(b) < 40):
            merged[-1] = (merged[-1][0] + "\n\n" + b, merged[-1][1])
        else:
            merged.append((b, page))
    units = []
    for b, page in merged:
        start = 0
        while True:
            piece = b[start : start + 1000]
            if piece.strip():
                units.append((len(units), page, piece, "chunk" if len(b) > 1000 else "paragraph"))
            if start + 1000 >= len(b):
                break
            start += 984
    return units


def test_segmentation(spark):
    long = "".join(chr(97 + i % 23) for i in range(2500))
    cases = [["第一条（目的）\n" + "この規程は定める。" * 6 + "\n\n第二条の二 （範囲）\n" + "適用する範囲を示す。" * 6], ["Head\n\n" + "body text " * 8], [long], ["short", "also short", "x" * 50], ["  \n \n"], [], ["a" * 1000 + "\n\n" + "b" * 990 + " " * 30 + "c" * 40]]
    files = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "path int, pages array<string>")
    got = {}
    for r in segment.segment_pages(files).orderBy("path", "unit_id").collect():
        got.setdefault(r["path"], []).append((r["unit_id"], r["page"], r["text"], r["kind"], r["label"]))
    for i, c in enumerate(cases):
        assert [x[:4] for x in got.get(i, [])] == fold(c), i
    assert [x[4] for x in got[0]] == ["第一条（目的）", "第二条の二 （範囲）"]
    assert len(got[2]) == 3 and len({x[4] for x in got[2]}) == 1 and got[2][0][4] == long[:36] + "…"


def test_presentation(spark):
    assert present.snippet("x" * 50 + "needle" + "y" * 200, "", ["needle"]) == "…" + "x" * 33 + "needle" + "y" * 66 + "…"
    assert present.snippet("Some Query here", "query", []) == "Some Query here" and present.snippet("", "q", []) == ""
    assert present.snippet("abc " * 60, "zzzbc", []).startswith("abc")
    assert column(spark, ["a" * 60 + "HEAN" + "b" * 90, "none"], lambda c: present.anchored_snippet(c, ["hean"])) == ["…" + "a" * 33 + "HEAN" + "b" * 66 + "…", "none"]
    assert present.proximity("aa bb cc aa", ["aa", "cc", "zz"]) == (2, 5, 0.8) and present.proximity("q", ["z"]) == (0, 0, 0.05)
    assert present.overlap("abc def", "ABCDEF") == 1.0 and present.overlap("abcdef", "abc") == 0.5 and present.overlap("", "a") == 0.0
    assert present.overlap("the body of the text", "the body of the text!!") >= 0.45 > present.overlap("the body", "other words")
    assert present.pretty_json('{"a":1}') == '{\n  "a": 1\n}' and present.pretty_json("{") == "{"
    assert present.hit_offset("ab cd ef gh ij", "cdef ghij") == 3 and present.hit_offset("abc", "abc") is None
    assert column(spark, ["text # head", "a - item"], present.markdown_breaks) == ["text\n# head", "a\n- item"]


def test_references_are_decoded_once(spark):
    texts = ["&#38;amp;", "&#38;#60; &#60;", "&amp;lt;&lt;", "&nope;&amp&#xD800;&#x110000;&#9731;", "&copy;&euro;", "", None, "&#00065;&#x1F600;x&amp;"]
    want = ["&amp;", "&#60; <", "&lt;<", "&nope;&amp&#xD800;&#x110000;\u2603", "\u00a9\u20ac", "", None, "A\U0001f600x&"]
    assert column(spark, texts, html.decode_entities) == want


def test_folders_above_paths_of_both_kinds(spark):
    got = column(spark, ["C:\\Data\\a\\x.txt", "\\\\srv\\share\\d\\f", "/abs/y", "a\\b/c", "x"], paths.ancestors)
    assert got == [["C:\\", "C:\\Data", "C:\\Data\\a"], ["\\\\srv\\share", "\\\\srv\\share\\d"], ["/abs"], ["a", "a\\b"], []]
