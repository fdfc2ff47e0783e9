"""Streams: files and events into the index and the history, in micro-batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.incremental import without_excluded
from tessera.streaming.folder import quiet_events

QUIET_MS = 500


def watch_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """New and changed files below a folder as a stream. The source reports no removals: reconcile() finds these."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def latest_events(batch: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """The last event of each path in a micro-batch, by partial aggregation: a path with most events is no task of its own."""
    rest = [c for c in batch.columns if c != key]
    last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_e"))
    return last.select(*(F.col(key) if c == key else F.col("_e")[c].alias(c) for c in batch.columns))


def index_stream(events: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, key: str = "path", order: str = "seq", quiet_ms: int = QUIET_MS) -> StreamingQuery:
    """Hands every micro-batch of events to `upsert`, which must be repeatable for a batch id.

    A path's event is handed on, the last by `order`, when none has come for it for quiet_ms (see folder.quiet_events for the session that this needs). `once` takes what
    is there as it is and ends.
    """
    if once:
        return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    settled = quiet_events(events, key, order, quiet_ms)
    return settled.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, quiet_ms // 2)} milliseconds").start()


def restart_watchers(running: dict[str, StreamingQuery], roots: list[str], start: Callable[[str], StreamingQuery]) -> dict[str, StreamingQuery]:
    """The watchers for a new list of folders: those of folders that left it are stopped, new ones are started, others go on. Each has its own checkpoint."""
    for root in set(running) - set(roots):
        running[root].stop()
    return {root: running[root] if root in running and running[root].isActive else start(root) for root in roots}


def snapshot_upsert(path: str, key: str = "path", order: str = "seq", excluded: DataFrame | None = None, compare: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """An upsert into Parquet snapshots: batch n reads version n - 1 and writes version n below `path`; a rerun writes the same.

    Each key keeps its event of the highest order over all batches, whichever came first. Rows with removed = true delete their key; they
    stay as marks below `path`/removed, so that no older event of a later batch brings the key back. Changes of paths that lie in an `excluded` one are left out,
    removals are not. With `compare`, the rows that are new or differ from those before in one of these columns are also written
    to `path`/changed/v=n: what an indexer must read again.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        events = batch.withColumn("removed", F.coalesce("removed", F.lit(False)))
        if excluded is not None:
            allowed = without_excluded(events.where("not removed").withColumnRenamed(key, "path"), excluded).withColumnRenamed("path", key)
            events = allowed.unionByName(events.where("removed"))
        if number > 0:
            for folder, removed in ((path, False), (f"{path}/removed", True)):
                events = events.unionByName(spark.read.parquet(f"{folder}/v={number - 1}").withColumn("removed", F.lit(removed)))
        last = latest_events(events, key, order)
        last.where("not removed").drop("removed").write.mode("overwrite").parquet(f"{path}/v={number}")
        last.where("removed").drop("removed").write.mode("overwrite").parquet(f"{path}/removed/v={number}")
        if compare:
            changed = spark.read.parquet(f"{path}/v={number}")
            if number > 0:
                before = spark.read.parquet(f"{path}/v={number - 1}")
                same = reduce(Column.__and__, (changed[c].eqNullSafe(before[c]) for c in (key, *compare)))
                changed = changed.join(before, same, "left_anti")
            changed.write.mode("overwrite").parquet(f"{path}/changed/v={number}")

    return upsert


def reconcile(index: DataFrame, scanned: DataFrame) -> DataFrame:
    """The index without paths that a scan no longer finds."""
    return index.join(scanned.select("path"), "path", "left_semi")


def term_usage(events: DataFrame, term: str = "event_type", ts: str = "ts") -> DataFrame:
    """term, count, last over a stream of uses, for update mode: each update replaces the term's earlier row. Partial counts meet in the state, so no hot term is gathered."""
    uses = events.select(F.col(term).alias("term"), F.unix_timestamp(F.col(ts).cast("timestamp")).alias("t"))
    return uses.groupBy("term").agg(F.count("*").alias("count"), F.max("t").alias("last"))


def newest_message(messages: DataFrame) -> DataFrame:
    """Stateful conversation_id, path, date: the newest message of each conversation so far; of equal dates the first seen path."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        path, date = state.get if state.exists else (None, None)
        for rows in batches:
            for p, d in rows.sort_values(["date", "path"], ascending=[True, False])[["path", "date"]].itertuples(index=False):
                if date is None or d > date or (d == date and p < path):
                    path, date = p, int(d)
        state.update((path, date))
        yield pd.DataFrame({"conversation_id": [key[0]], "path": [path], "date": [date]})

    schema = "conversation_id string, path string, date long"
    return messages.groupBy("conversation_id").applyInPandasWithState(update, schema, "path string, date long", "update", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Calls `report(batch, rows)` for finished batches, at most once in `seconds`, and always for the last."""

    def __init__(self, report: Callable[[int, int], None], seconds: float = 0.1):
        self.report, self.seconds, self.at, self.held = report, seconds, 0.0, None

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.held = (event.progress.batchId, event.progress.numInputRows)
        if time.monotonic() - self.at >= self.seconds:
            self._emit()

    def onQueryTerminated(self, event) -> None:
        self._emit()

    def _emit(self) -> None:
        if self.held:
            self.report(*self.held)
            self.at, self.held = time.monotonic(), None


def sync_due(last: int | None, now: int, interval: int) -> bool:
    """Whether a periodic sync is due; an interval of 0 is manual."""
    return interval > 0 and (last is None or now - last >= interval)


def sync_since(now: int, days: int) -> int:
    return now - min(3650, max(1, days)) * 86400
