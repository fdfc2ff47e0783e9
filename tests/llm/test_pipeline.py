from collections import Counter

import corpus_pipeline
from tessera.llm import language_id, order_minhash, packing


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120).union(spark.createDataFrame([(-1, None, None, None, None), (-2, "123", "en", "src0", 3)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "mix_sources", "pack_sequences"]
    columns, seen = docs.columns, [{r["doc_id"] for r in docs.collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= seen[-1]
        if i < 3:
            assert docs.columns == columns
        if name == "language_id":
            assert {-1, -2} <= seen[-1] - ids and len(ids) >= 0.97 * len(seen[-1])
        if name == "near_duplicates":
            assert ids == {r["class_id"] for r in order_minhash.near_duplicates(before).collect()} and docs.count() == len(ids)
        if name == "mix_sources":
            assert max(Counter(r["doc_id"] for r in docs.collect()).values()) <= 2
        if name == "pack_sequences":
            want = packing.token_pieces(before).select("doc_id", "piece", "ids_crc32").collect()
            assert sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, want))
        seen.append(ids)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == docs.columns and got.count() == docs.count()


def test_documents_without_any_label_stay(spark):
    rows = [(1, "some words", None, "s", 10), (2, None, None, "s", 0), (3, "12 !?", None, "s", 5), (4, "\u00e9t\u00e9", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_languages(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_documents_without_a_language_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id as _lang_pred", "'x' as lang_pred", "cast(2.5 as double) as score", "text as _text", "1 as _nth")
    odd = ["A.", "x", "zq 77", "\u00c8$$$ onai*** des&&&", "token = 9f8a", "Avec the. und"]
    junk = spark.createDataFrame([(-i, t, "en", "s", 1, 0, "x", 1.0, t, 1) for i, t in enumerate(odd, 1)], docs.schema)
    kept = corpus_pipeline.identify_languages(spark, docs.union(junk), sf)
    assert kept.columns == docs.columns
    rows, before = {r["doc_id"]: r for r in kept.collect()}, {r["doc_id"]: r for r in docs.collect()}
    sure = {r["doc_id"]: r["sure"] for r in language_id.identify(docs.union(junk), language_id.fit(docs.union(junk)), score_name="sure").collect()}
    assert set(rows) == {i for i, x in sure.items() if x >= corpus_pipeline.LEAST_SCORE}
    assert any(0 < sure[-i] < corpus_pipeline.LEAST_SCORE for i in range(1, 7)) and len(rows) >= 0.98 * len(before)
    assert all(before[i] == r for i, r in rows.items() if i >= 0)


def test_empty_documents_through_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[3][1](spark, docs, sf).count() == 0
