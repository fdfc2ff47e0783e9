import os
import time

from tessera.streaming.folder import quiet_events, watch_folder, with_rocksdb


def run(df, out, checkpoint):
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)


def test_created_modified_and_removed_files_over_restarts(spark, tmp_path):
    root, out, check, state = (str(tmp_path / n) for n in ("root", "out", "check", "state"))
    os.makedirs(f"{root}/a/b")

    def put(name, text):
        with open(f"{root}/{name}", "w") as f:
            f.write(text)

    seen = set()

    def events():
        """What a restart of the stream adds."""
        run(watch_folder(spark, root, state, "*.txt"), out, check)
        rows = {(os.path.relpath(r["path"], root), r["event"], r["size"], r["listing"]) for r in spark.read.parquet(out).collect()}
        new = {r[:3] for r in rows - seen}
        seen.update(rows)
        return new

    put("one.txt", "1"), put("a/b/two.txt", "22"), put("no.md", "x")
    assert events() == {("one.txt", "create", 1), ("a/b/two.txt", "create", 2)}
    assert events() == set()
    put("one.txt", "longer"), put("three.txt", ""), os.remove(f"{root}/a/b/two.txt")
    assert events() == {("one.txt", "modify", 6), ("three.txt", "create", 0), ("a/b/two.txt", "remove", None)}
    os.remove(f"{root}/three.txt"), put("three.txt", ""), put("a/b/two.txt", "back")
    assert events() >= {("a/b/two.txt", "create", 4)}
    assert len([n for n in os.listdir(state) if n.startswith("listing-")]) <= 2


def test_a_burst_is_one_row_and_silent_paths_are_not_held(spark, tmp_path):
    own = with_rocksdb(spark)
    source, got = str(tmp_path / "in"), []
    schema = "path string, seq long, event string"
    put = lambda rows: own.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put([("a", 1, "create"), ("a", 3, "modify"), ("a", 2, "modify"), ("b", 1, None)])
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def keep(batch, number):
        got.extend((r["path"], r["seq"], r["event"]) for r in batch.collect())

    query = quiet_events(stream, quiet_ms=3000).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    try:
        deadline = time.time() + 90
        put([("a", 4, "remove")])
        while len(got) < 2 and time.time() < deadline:
            time.sleep(0.2)
        put([("b", 2, "modify")])
        while len(got) < 3 and time.time() < deadline:
            time.sleep(0.2)
        time.sleep(4)
    finally:
        query.stop()
    assert sorted(got, key=str) in ([("a", 4, "remove"), ("b", 1, None), ("b", 2, "modify")], [("a", 3, "modify"), ("a", 4, "remove"), ("b", 1, None), ("b", 2, "modify")])
