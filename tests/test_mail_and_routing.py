import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, federation, mail
from tessera.operators.incremental import fingerprint
from tessera.operators.index import SearchIndex
from tessera.plans.everywhere import SideOutdated, search_everywhere, search_sides
from tessera.streaming import watch

MESSAGE = "path string, store_id string, entry_id string, subject string, body string, from_addr string, conversation_id string, folder_name string, date_unix long"


def messages(spark, rows):
    df = spark.createDataFrame([(f"outlook:s/{e}", "s", e, "subject", body, "me", conv, "in", date) for e, body, conv, date in rows], MESSAGE)
    return df.withColumn("content_hash", fingerprint("subject", "from_addr", "date_unix", "conversation_id", "body"))


def test_messages_fall_back_and_are_filtered(spark):
    schema = "store_id string, folder_id string, entry_id string, class int, subject string, plain string, html string, sender string, behalf string, conversation_id string, received long, sent long"
    rows = [
        ("s", "f", "a", None, None, " ", "<p>x</p>", None, "b", None, None, 9),
        ("s", "f", "b", 43, "t", " y ", None, None, None, "c", None, None),
        ("s", "f", "", 43, "no id", "", "", "", "", "", 9, 9),
        ("s", "f", "d", 26, "no mail", "", "", "", "", "", 9, 9),
        ("s", "g", "e", 43, "not selected", "", "", "", "", "", 9, 9),
        ("s", "f", "f", 43, "too old", "", "", "", "", "", 4, 9),
    ]
    folders = spark.createDataFrame([("s", "f", "s / f", True), ("s", "g", "s / g", False)], "store_id string, entry_id string, path_label string, selected boolean")
    got = mail.read_messages(spark.createDataFrame(rows, schema), folders, 5).select("entry_id", "subject", "body", "from_addr", "conversation_id", "folder_name", "date_unix").collect()
    assert sorted(map(tuple, got)) == [("a", "", "x", "b", "", "s / f", 9), ("b", "t", "y", "", "c", "s / f", 0)]
    assert mail.read_messages(spark.createDataFrame([], schema), folders).count() == 0


def stored(spark, path, *tables):
    for i, t in enumerate(tables):
        t.write.parquet(f"{path}/{i}")
    return [spark.read.parquet(f"{path}/{i}") for i in range(len(tables))]


def test_sync_supersedes_and_skips(spark, tmp_path):
    first = messages(spark, [("a", "one", "c", 1), ("b", "two", "c", 1), ("x", "alone", "", 1), ("y", "alone", "", 1)])
    nothing = first.where("false").drop("body").withColumn("status", first["path"])
    listed, units, states = stored(spark, tmp_path / "1", *mail.sync_messages(first, nothing, mail.mail_units(first.where("false"))))
    assert dict(map(tuple, states.collect())) == {"outlook:s/a": "indexed", "outlook:s/b": "superseded", "outlook:s/x": "indexed", "outlook:s/y": "indexed"}
    # an equally old message does not replace the indexed one; a newer one does; what is unchanged is skipped
    again = messages(spark, [("A", "early name", "c", 1), ("x", "alone", "", 1), ("y", "alone, edited", "", 1)])
    listed, units, states = stored(spark, tmp_path / "2", *mail.sync_messages(again, listed, units))
    assert dict(map(tuple, states.collect())) == {"outlook:s/A": "superseded", "outlook:s/x": "skipped", "outlook:s/y": "indexed"}
    listed, units, states = stored(spark, tmp_path / "3", *mail.sync_messages(messages(spark, [("z", "new", "c", 2)]), listed, units))
    assert mail.sync_counts(states).collect()[0] == (1, 0, 0)
    assert sorted((r["path"], r["body"]) for r in units.collect()) == [("outlook:s/x", "alone"), ("outlook:s/y", "alone, edited"), ("outlook:s/z", "new")]
    assert dict(listed.select("path", "status").collect()) == {"outlook:s/a": "superseded", "outlook:s/b": "superseded", "outlook:s/A": "superseded", "outlook:s/x": "indexed", "outlook:s/y": "indexed", "outlook:s/z": "indexed"}


def test_search_of_all_sides(spark):
    files = spark.createDataFrame([("1", "a/one.txt", "one", "alpha beta", "txt", "file")], "unit_key string, path string, title string, body string, ext string, doc_kind string")
    mails = mail.mail_units(messages(spark, [("a", "alpha first", "c", 1), ("b", "alpha last", "c", 2)]))
    local, post = (lambda: SearchIndex.build(files)), (lambda: SearchIndex.build(mails))

    def broken():
        raise OSError("not reachable")

    found = search_everywhere("alpha", 5, local=local, remote=broken, mail=post, mode="hybrid", mail_enabled=True)
    assert sorted((r["path"], r["source"], r["match_count"]) for r in found.collect()) == [("a/one.txt", "local", 1), ("outlook:s/b", "mail", 2)]
    assert search_everywhere("alpha", 5, local=local, mail=post, mail_enabled=True, scope="a").count() == 1
    assert [r["source"] for r in search_everywhere("alpha", 5, local=local, mail=post, mail_enabled=True, scope="mailfolder:in").collect()] == ["mail"]
    assert search_everywhere("alpha", 5, local=local, mail=post, scope="mailfolder:in") is None
    with pytest.raises(OSError):
        search_everywhere("alpha", 5, local=broken, remote=broken, mode="hybrid")
    assert search_sides("alpha", 5, local=lambda: None, remote=local, mode="hybrid")[1] == {"local": "outdated", "remote": "answered"}
    with pytest.raises(SideOutdated):
        search_everywhere("alpha", 5, local=lambda: None)
    dead = SearchIndex.build(files)
    dead.postings = dead.postings.withColumn("tf", F.when(F.col("tf") > 0, F.raise_error(F.lit("gone")).cast("int")))
    found, status = search_sides("alpha", 5, local=lambda: dead, remote=local, mode="hybrid")
    assert [r["source"] for r in found.collect()] == ["remote"] and status["local"].startswith("failed")
    assert search_sides("-alpha", 5, local=local)[1] == {"local": "empty"}
    words = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "word string")
    assert search_everywhere("alphabeta", 5, local=local, words=words).count() == 1


def test_catalog_rows(spark):
    t = spark.createDataFrame([("b", 1), ("A", 2), ("c", 3)], "word string, id int")
    assert [r[0] for r in catalog.listing(t, "word", order="word").collect()] == ["A", "b", "c"]
    assert catalog.remove_rows(t, t.where("id = 3"), ["word"]).count() == 2 and catalog.remove_rows(t, None, ["word"]).count() == 0
    assert catalog.find_rows(t, "id", 2).first()["word"] == "A" and catalog.find_rows(t, "id", 9).count() == 0
    new = spark.createDataFrame([("d", 4), ("d", 4)], t.schema)
    assert catalog.upsert(t, new, ["word"]).count() == 4
    assert federation.latest_only(spark.createDataFrame([(None, 1, "a"), (None, 2, "b")], "conversation_id string, date long, path string")).where("status = 'indexed'").count() == 2


def test_stream_leaves_out_excluded_paths_and_tells_changes(spark, tmp_path):
    out = str(tmp_path / "index")
    excluded = spark.createDataFrame([("SECRET",)], "path string")
    upsert = watch.snapshot_upsert(out, excluded=excluded, compare=("hash",))
    batch = lambda *rows: spark.createDataFrame(list(rows), "path string, hash string, seq long, removed boolean")
    upsert(batch(("a/x", "1", 1, False), ("secret/y", "1", 2, False), ("a/z", "1", 3, None)), 0)
    upsert(batch(("a/x", "1", 4, False), ("a/z", "2", 5, False), ("secret/y", None, 6, True)), 1)
    assert sorted(r["path"] for r in spark.read.parquet(f"{out}/v=1").collect()) == ["a/x", "a/z"]
    assert [r["path"] for r in spark.read.parquet(f"{out}/changed/v=1").collect()] == ["a/z"]


def test_watchers_follow_the_list_of_folders():
    class Query:
        isActive = True

        def stop(self):
            self.isActive = False

    a, b = Query(), Query()
    got = watch.restart_watchers({"a": a, "b": b}, ["b", "c"], lambda root: f"new {root}")
    assert got == {"b": b, "c": "new c"} and not a.isActive
