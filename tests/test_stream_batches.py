import os

from tessera import library_queries
from tessera.operators.segments import SegmentStore


def test_events_of_many_tasks_come_in_as_many_batches_and_read_only_texts_they_name(spark, sf, tmp_path, monkeypatch):
    """The number of micro-batches, each of which reads the documents, does not grow with the tasks that read the events; texts that no change names are not dealt."""
    want = [tuple(r) for r in library_queries.stream_incremental_index(spark, sf).collect()]
    for name in os.listdir(sf):
        if name != "events.parquet":
            os.symlink(f"{sf}/{name}", tmp_path / name)
    spark.read.parquet(f"{sf}/events.parquet").repartition(12).write.parquet(str(tmp_path / "events.parquet"))
    batches, plans, apply = [], [], SegmentStore.apply

    def counting(self, changes, batch, read, excluded=None):
        def seen(rows):
            found = read(rows)
            plans.append(found._jdf.queryExecution().optimizedPlan().toString())
            return found

        batches.append(changes.count())
        return apply(self, changes, batch, seen, excluded)

    monkeypatch.setattr(SegmentStore, "apply", counting)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert spark.read.parquet(str(tmp_path / "events.parquet")).rdd.getNumPartitions() >= 12
        found = library_queries.stream_incremental_index(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in found.collect()] == want
    assert 1 < len(batches) <= 3 and sum(batches) == spark.read.parquet(f"{sf}/events.parquet").count()
    assert plans and all("LeftSemi" in p for p in plans)
