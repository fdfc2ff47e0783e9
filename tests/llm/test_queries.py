import zlib

import pytest

from tessera.llm import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], sf)


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_language_query_on_held_out_documents(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    labelled = [r for r in held if docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in labelled) >= 0.9 * len(labelled)


def test_quality_query_on_held_out_documents(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op12_quality_trees(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.9 * len(held)
