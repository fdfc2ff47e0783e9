from pyspark.sql import functions as F

from tessera import library_queries
from tessera.functions import present
from tessera.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_proximity_takes_few_texts_at_once(spark):
    texts = spark.createDataFrame([("a b thion hean",), (None,), ("",)], "t string").select(present.proximity_column(F.col("t"), ["thion", "hean"]).alias("n"))
    assert [tuple(r["n"]) for r in texts.collect()] == [(2, 10, 0.9), (0, 0, 0.05), (0, 0, 0.05)]
    assert "BatchEvalPython" in plan(texts) and "ArrowEvalPython" not in plan(texts)


def test_readers_and_samples_take_few_files_at_once(spark, sf):
    found = library_queries.mixed_formats_extracted(spark, sf)
    assert "BatchEvalPython" in plan(found) and "ArrowEvalPython" not in plan(found)
    files = spark.createDataFrame([("a.docx", "docx", b"PK"), ("b.html", "html", b"<p>x</p>"), ("c.txt", "txt", None)], "path string, ext string, content binary")
    files = files.withColumn("length", F.lit(1).cast("long")).withColumn("modificationTime", F.timestamp_seconds(F.lit(0)))
    got = {r["path"]: r for r in readers.extract(files).collect()}
    assert got["a.docx"]["status"] == "error" and got["a.docx"]["error"].startswith("BadZipFile") and got["b.html"]["pages"] == ["x"] and got["c.txt"]["content_hash"] is None
