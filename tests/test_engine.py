import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, federation, history, incremental
from tessera.operators.index import SearchIndex, mail_index_consistent, units_of
from tessera.plans import search
from tessera.sources import readers
from tessera.streaming import watch

BODY = [
    ("a/one.txt", "Alpha beta gamma. The quick brown fox jumps."), ("a/two.txt", "Beta alpha. A lazy dog sleeps in the warm sun today."), ("b/three.md", "alpha only here, nothing else of note to see at all"),
    ("b/four.md", "quick brown bear and quick brown fox"), ("outlook:s/e1", "alpha mail about a fox"),
]


@pytest.fixture(scope="module")
def index(spark):
    files = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(BODY)], "unit_key long, path string, body string")
    units = units_of(files, F.col("path"), F.element_at(F.split("path", "/"), -1), F.col("body"), extra={"unit_key": F.col("unit_key"), "label": F.lit("")})
    return SearchIndex.build(units.cache())


def keys(df):
    return {r["unit_key"] for r in df.collect()}


def test_boolean_algebra(index):
    got = lambda q: keys(search.retrieve(index, q))
    assert got("alpha") == {0, 1, 2, 4} and got("alpha -beta") == {2, 4} and got('"quick brown fox"') == {0, 3}
    assert got('alpha "quick brown"') == {0, 3} and got('alpha -"about a"') == {0, 1, 2} and got("alpha fox") == {0, 1, 2, 3, 4}
    assert search.retrieve(index, "-alpha") is None and search.retrieve(index, "") is None
    assert got('"fox quick"') == set() and got("four") == {3}
    for query in ("alpha fox", '"quick brown"'):
        assert got(query + " -dog") <= got(query)


def test_search_files(index):
    rows = search.search_files(index, "quick fox", 3).collect()
    assert [r["path"] for r in rows][:2] == ["b/four.md", "a/one.txt"] and "fox" in rows[0]["paragraphs"][0]["snippet"]
    assert [r["path"] for r in search.search_files(index, "quick fox", 1).collect()] == ["b/four.md"]
    assert keys(search.search_units(index, "alpha", 10, scope="B")) == {2} and keys(search.search_units(index, "alpha", 10, exts=[".MD"])) == {2}
    assert keys(search.path_matches(index, "alpha", "a/one.txt")) == {0} and keys(search.path_matches(index, "alpha", "A/ONE.txt")) == {0}
    assert search.preview(index, 3).first()["path"] == "b/four.md"


def test_near_copies_and_groups(spark):
    body = "the same long body text with many words " * 3
    rows = [(1, "f", body, "L", body[:60], 3.0), (2, "f", body + "tail", "L", body[:60], 2.0), (3, "f", "entirely different words here", "L", "x", 1.0), (4, "g", body, "", "y", 2.5)]
    hits = spark.createDataFrame(rows, "unit_key long, path string, body string, label string, snippet string, score double")
    kept = search.drop_near_copies(hits)
    assert keys(kept) == {1, 3, 4}
    files = search.group_by_file(kept, 5).collect()
    assert [(r["path"], r["match_count"], [p["id"] for p in r["paragraphs"]]) for r in files] == [("f", 2, [1, 3]), ("g", 1, [4])]
    assert [p["label"] for p in files[1]["paragraphs"]] == ["y"]


def test_save_and_load(index, spark, tmp_path):
    index.save(str(tmp_path / "i"), files=2)
    again = SearchIndex.load(spark, str(tmp_path / "i"))
    assert keys(search.retrieve(again, '"quick brown fox" -dog')) == {0, 3}
    about = spark.read.text(str(tmp_path / "i" / "about")).select(F.regexp_replace("value", r'"version": \d+', '"version": 1').alias("value"))
    about.write.mode("overwrite").text(str(tmp_path / "old" / "about"))
    assert SearchIndex.load(spark, str(tmp_path / "old")) is None and SearchIndex.load(spark, str(tmp_path / "none")) is None
    mail = spark.createDataFrame([("outlook:s/e1", "indexed")], "path string, status string")
    assert mail_index_consistent(mail, index.units) and not mail_index_consistent(mail, index.units.where("unit_key < 3"))


def test_threads_and_routes(spark):
    rows = [(1, "c", "5", 2), (2, "c", "9", 0), (3, "", "1", 1), (4, "c", "9", 3), (5, "c", "2", 7), (6, None, "x", 1)]
    hits = spark.createDataFrame(rows, "rank long, conversation_id string, mail_date string, match_count long")
    got = [tuple(r) for r in federation.collapse_threads(hits, 10).collect()]
    assert got == [(1, "c", "9", 2 + 1 + 3 + 1), (3, "", "1", 1), (6, None, "x", 1)]
    assert federation.route("hybrid", None, [], True) == (True, True, True) and federation.route("remote", "mailfolder:x", [], True) == (False, False, True)
    assert federation.route("odd", "C:\\", [], True) == (True, False, False) and federation.remote_limit(None) == 10 and federation.remote_limit(30, True) == 50
    docs = spark.createDataFrame([("file", "a"), ("email", "b"), ("file", "OUTLOOK:x/y")], "doc_kind string, path string")
    assert [r["path"] for r in federation.without_mail(docs).collect()] == ["a"]


def test_preview_order_and_groups(spark, index):
    from types import SimpleNamespace

    from tessera.functions import paths

    mail = index.units.where("unit_key = 4").withColumn("title", F.lit("mail"))
    assert federation.first_preview(4, True, index.units, mail).first()["title"] == "mail"
    assert federation.first_preview(4, False, index.units, mail).first()["title"] == "e1"
    assert paths.extensions_of(["md", "html", "odd"]) == ["md", "markdown", "html", "htm", "odd"]
    assert index.units.where(paths.matches_text(F.col("title"), F.col("path"), " ONE ")).count() == 1
    seen = []
    p = watch.Progress(lambda *x: seen.append(x), 60)
    for i in range(3):
        p.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(batchId=i, numInputRows=i * 10)))
    p.onQueryTerminated(None)
    assert seen[-1] == (2, 20) and len(seen) <= 2


def test_catalog(spark):
    words = spark.createDataFrame([("a", 1), ("b", 2)], "word string, n int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "word string, n int")
    assert sorted(map(tuple, catalog.upsert(words, new, ["word"], F.col("n")).collect())) == [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(r["word"] for r in catalog.insert_missing(words, new, ["word"]).collect()) == ["a", "b", "c"]
    s = spark.createDataFrame([("max_results", "zz"), ("mail_enabled", "TRUE"), ("mail_thread_collapse", "no"), ("remote_timeout_ms", "9")], "key string, value string")
    r = catalog.settings_record(s).first()
    assert (r["max_results"], r["mail_enabled"], r["mail_thread_collapse"], r["remote_timeout_ms"], r["search_mode"]) == (10, True, True, 500, "local")
    got = catalog.dictionary_import(spark.createDataFrame([("a",), (" ",), ("x",), ("x",)], "word string"), words).first()
    assert tuple(got) == (1, 1, 2)
    left = catalog.remove_folder({"files": spark.createDataFrame([("C:\\a\\b",), ("C:\\ab",)], "path string")}, "C:\\a")
    assert [r[0] for r in left["files"].collect()] == ["C:\\ab"]
    for definition in catalog.SCHEMAS.values():
        spark.createDataFrame([], definition)


def test_incremental(spark):
    old = spark.createDataFrame([("x", 1, 1, "h"), ("y", 1, 1, "h"), ("z", 1, 1, "h")], "path string, size long, mtime long, content_hash string")
    new = spark.createDataFrame([("x", 1, 1, "h"), ("y", 1, 2, "h"), ("n", 1, 1, "h")], old.schema)
    assert dict(map(tuple, incremental.change_states(new, old).collect())) == {"x": "unchanged", "y": "changed", "z": "orphan", "n": "new"}
    again = incremental.replace_units(old, new.where("path = 'y'"), old.where("path = 'z'"))
    assert sorted((r["path"], r["mtime"]) for r in again.collect()) == [("x", 1), ("y", 2)]
    mail = spark.createDataFrame([("p", "h", "f"), ("q", "h", "f")], "path string, content_hash string, folder_name string")
    listed = mail.withColumn("status", F.lit("indexed"))
    assert [r["path"] for r in incremental.mail_changed(mail, listed, mail.where("path = 'p'")).collect()] == ["q"]


def test_suggestions(spark):
    events = spark.createDataFrame([(0, ["apple pie", "tea"], 900), (1, ["cake", "tea"], 800), (2, ["apple", "jam"], 700)], "rank int, terms array<string>, t long")
    stats = spark.createDataFrame([("apple pie", 3, 900), ("tea", 2, 900), ("cake", 1, 800), ("jam", 1, 700)], "term string, count long, last long")
    words = spark.createDataFrame([("apple tart",), ("apple pie",)], "word string")
    rows = {r["term"]: r for r in history.suggest(events, stats, words, "app", 1000).collect()}
    assert rows["apple pie"]["kind"] == "prefix" and rows["apple pie"]["from_history"] and rows["apple pie"]["from_registered"]
    assert not rows["apple tart"]["from_history"] and rows["tea"]["kind"] == "cooccur" and rows["jam"]["kind"] == "cooccur" and "cake" not in rows
    order = [r["term"] for r in history.suggest(events, stats, words, "app", 1000).collect()]
    assert order == ["tea", "apple pie", "jam", "apple tart"]
    assert history.suggest(events, stats, words, 'x "open', 1000).count() == 0
    assert {r["term"] for r in history.suggest(events, stats, words, "tea ", 1000).collect()} >= {"apple pie", "cake"}


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:body>" + "".join(f"<w:p>{p}</w:p>" for p in paragraphs) + "</w:body></w:document>")
    return out.getvalue()


def xlsx():
    out = io.BytesIO()
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="{r}"><sheets><sheet name="S1" r:id="a"/><sheet name="Empty" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {m}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row/><row><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {m}><sheetData/></worksheet>")
    return out.getvalue()


def test_readers(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    files = {
        "a.txt": "héllo".encode(), "bad.md": b"\xff\xfe\xfa", "sub/p.HTML": "<title>T</title><p>x</p>".encode(), "e.html": b"<script>x</script>", "w.docx": docx("<w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r>", "<w:t>a</w:t><w:br/><w:t>b</w:t><w:tab/>c"),
        "broken.docx": b"zip?", "t.xlsx": xlsx(), "x.pdf": b"%PDF", "skip.exe": b"MZ",
    }
    for name, content in files.items():
        (tmp_path / "d" / name).write_bytes(content)
    found, missing = readers.scan_folders(spark, [str(tmp_path / "d"), str(tmp_path / "no")])
    rows = {r["title"]: r for r in readers.extract(found).collect()}
    assert missing == [str(tmp_path / "no")] and "skip.exe" not in rows
    assert {k: r["status"] for k, r in rows.items()} == {"a.txt": "indexed", "bad.md": "error", "p.HTML": "indexed", "e.html": "skipped", "w.docx": "indexed", "broken.docx": "error", "t.xlsx": "indexed", "x.pdf": "unsupported"}
    assert rows["w.docx"]["pages"] == ["one two\n\na\nb c"] and rows["t.xlsx"]["pages"] == ["S1\nshared\t5\nin"] and rows["p.HTML"]["pages"] == ["T\n\nT\n\nx"]
    assert rows["a.txt"]["content_hash"] == __import__("xxhash").xxh64_hexdigest("héllo".encode())
    assert tuple(readers.run_stats(readers.extract(found)).first()) == (4, 1, 3)
    assert [r[0] for r in spark.range(1).select(readers.split_form_feeds(F.lit(" a \f\f b"))).collect()] == [["a", "b"]]


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "w.csv").write_text('\ufeffsurface,pos\n# note\n\nword\n"a,b",動詞,yomi\n')
    words = readers.read_dictionary(spark, str(tmp_path / "w.csv"))
    assert sorted(map(tuple, words.collect())) == [("a,b", "動詞", "yomi"), ("word", "名詞", "")]
    readers.write_dictionary(words, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['"a,b",動詞,yomi', "word"]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(1, "p", "a", False), (2, "q", "b", False), (3, "p", "c", False), (4, "q", "", True), (5, "r", "d", False)]
    frame = spark.createDataFrame(rows, "seq long, path string, state string, removed boolean").coalesce(1)
    frame.where("seq <= 2").write.parquet(str(tmp_path / "in" / "x.parquet"))
    frame.where("seq > 2").write.parquet(str(tmp_path / "in" / "y.parquet"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = watch.index_stream(stream, watch.snapshot_upsert(str(tmp_path / "snap")), str(tmp_path / "ck"), once=True)
    q.awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/snap/v={q.lastProgress['batchId']}")
    assert sorted((r["path"], r["state"]) for r in last.collect()) == [("p", "c"), ("r", "d")]
    assert watch.sync_due(None, 10, 60) and not watch.sync_due(5, 10, 60) and not watch.sync_due(None, 10, 0) and watch.sync_since(10**9, 5000) == 10**9 - 3650 * 86400


def test_newest_message_stream(spark, tmp_path):
    frame = spark.createDataFrame([("c", "p1", 1), ("c", "p3", 5), ("c", "p2", 5), ("d", "x", 0)], "conversation_id string, path string, date long").coalesce(1)
    frame.write.parquet(str(tmp_path / "m.parquet"))
    got = []
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "m.parquet*"))
    watch.newest_message(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [("c", "p2", 5), ("d", "x", 0)]
    batch = federation.latest_only(frame).where("status = 'indexed'").select("conversation_id", "path", "date")
    assert sorted(map(tuple, batch.collect())) == sorted(got)


def test_snapshots_keep_the_highest_order_over_batches(spark, tmp_path):
    upsert = watch.snapshot_upsert(str(tmp_path / "snap"))
    schema = "path string, state string, seq long, removed boolean"
    batches = [[("p", "new", 9, False), ("q", "gone", 8, True), ("r", "a", 1, False)], [("p", "old", 3, False), ("q", "old", 2, False), ("r", "b", 5, None)], [("q", "old", 4, False), ("r", "old", 4, True)]]
    for number, rows in enumerate(batches):
        upsert(spark.createDataFrame(rows, schema), number)
    last = spark.read.parquet(f"{tmp_path}/snap/v=2")
    assert sorted(map(tuple, last.select("path", "state", "seq").collect())) == [("p", "new", 9), ("r", "b", 5)]
