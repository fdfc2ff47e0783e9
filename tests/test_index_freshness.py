import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators.index import SearchIndex, field_lengths, field_stats
from tessera.plans import search


def test_a_replaced_table_changes_the_answers(spark, tmp_path):
    where = str(tmp_path / "documents.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(where)
    write([(1, "thion one", "en", "s", 1), (2, "hean thion", "en", "s", 1), (3, None, "en", "s", 0)])
    ids = lambda: [r["doc_id"] for r in queries.term_or_bm25_topk(spark, str(tmp_path)).collect()]
    assert ids() == [2, 1] and ids() == [2, 1]
    write([(5, "thion", "en", "s", 1)])
    assert ids() == [5]
    write([])
    assert ids() == []


def test_stored_statistics_equal_those_of_the_units(spark, tmp_path):
    units = spark.createDataFrame([(1, "a b", "x y z", "f", "file"), (2, "", None, "f", "file"), (3, "c", "x", "g", "file")], "unit_key long, title string, body string, path string, doc_kind string")
    SearchIndex.build(units).save(str(tmp_path / "i"))
    stored = SearchIndex.load(spark, str(tmp_path / "i"))
    assert sorted(stored.stats.collect()) == sorted(field_stats(field_lengths(units)).select(*stored.stats.columns).collect())


def test_passages_of_any_length(spark):
    passages = spark.createDataFrame([(1, "one"), (2, "two, three"), (3, "a b c d e f"), (4, "..."), (5, None), (6, "f one"), (6, "f one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ONE two-three"), (2, "a b c d e F one"), (3, None), (4, ""), (5, "bone three two"), (5, "a b c d e"), (7, "two three " * 4000)], "doc_id long, text string")
    got = sorted(map(tuple, search.passages_in_texts(passages, docs, "item_id", "text", "doc_id", "text").collect()))
    assert got == [(1, 1), (1, 2), (2, 1), (2, 7), (3, 2), (6, 2)]
    assert search.passages_in_texts(passages.where("false"), docs, "item_id", "text", "doc_id", "text").count() == 0


@pytest.mark.parametrize("asked", ["d/a.txt", "D/A.TXT"])
def test_units_of_a_file_come_in_document_order(spark, asked):
    rows = [(f"d/a.txt#{i}", "d/a.txt", f"word {'abcdefghijklmnop'[i] * 9} end", "") for i in range(12)] + [("d/A.txt#0", "d/A.txt", "word other", "")]
    units = spark.createDataFrame(rows, "unit_key string, path string, body string, label string").withColumn("title", F.lit("")).withColumn("ext", F.lit("txt"))
    found = [r["unit_key"] for r in search.path_matches(SearchIndex.build(units), "word", asked).collect()]
    own = [f"d/a.txt#{i}" for i in range(12)]
    assert [k for k in found if k in own] == own and ("d/A.txt#0" in found) == (asked == "D/A.TXT")
