"""A folder as a stream of created, modified and removed files, and its events held back until their paths are quiet."""

from __future__ import annotations

import datetime
import fnmatch
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "path string, event string, size long, mtime timestamp, listing long"
_LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64())])


class Share(InputPartition):
    def __init__(self, start: int, end: int, share: int, shares: int):
        self.start, self.end, self.share, self.shares = start, end, share, shares


class FolderReader(DataSourceStreamReader):
    """Offsets are numbers of listings: an offset's listing is a Parquet file in the state folder, written before the offset is given out.

    A batch is the difference of two listings, found by tasks that each take the paths of one share. A listing equal to the last one makes no offset; a batch that is run again reads
    the same two listings; those before the last finished batch are deleted.
    """

    def __init__(self, options: dict[str, str]):
        self.files, self.root = fs.FileSystem.from_uri(options["path"])
        self.store, self.state = fs.FileSystem.from_uri(options["state"])
        self.glob, self.shares = options.get("glob", "*"), int(options.get("shares", "4"))
        self.root, self.state = self.root.rstrip("/"), self.state.rstrip("/")

    def _file(self, n: int) -> str:
        return f"{self.state}/listing-{n}.parquet"

    def _numbers(self) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(self.state, allow_not_found=True))
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(r"listing-(\d+)\.parquet", f.base_name)))

    def _load(self, n: int) -> pa.Table:
        if n < 0:
            return _LISTED.empty_table()
        with self.store.open_input_file(self._file(n)) as f:
            return pq.read_table(f)

    def _scan(self) -> pa.Table:
        found = self.files.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        rows = sorted((f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob))
        return pa.table(list(map(list, zip(*rows, strict=True))) if rows else [[], [], []], schema=_LISTED)

    def initialOffset(self) -> dict:
        return {"listing": -1}

    def latestOffset(self) -> dict:
        known = self._numbers()
        last = known[-1] if known else -1
        now = self._scan()
        if now.equals(self._load(last)):
            return {"listing": last}
        self.store.create_dir(self.state, recursive=True)
        with self.store.open_output_stream(f"{self.state}/.next") as f:
            pq.write_table(now, f)
        self.store.move(f"{self.state}/.next", self._file(last + 1))
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(start["listing"], end["listing"], i, self.shares) for i in range(self.shares)]

    def read(self, partition: Share) -> Iterator[tuple]:
        def own(n: int) -> dict[str, tuple[int, int]]:
            return {p: (s, t) for p, s, t in zip(*(c.to_pylist() for c in self._load(n).columns), strict=True) if zlib.crc32(p.encode()) % partition.shares == partition.share}

        before, after = own(partition.start), own(partition.end)
        for path in sorted(before.keys() | after.keys()):
            if before.get(path) != after.get(path):
                event = "create" if path not in before else "remove" if path not in after else "modify"
                size, stamp = after.get(path, (None, None))
                yield path, event, size, None if stamp is None else datetime.datetime.fromtimestamp(stamp / 1e9, datetime.timezone.utc), partition.end

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["listing"]:
                self.store.delete_file(self._file(n))


class WatchedFolder(DataSource):
    """The format `watched_folder`: path, state (a folder that all machines share, one for each stream) and, if wanted, glob and shares."""

    @classmethod
    def name(cls) -> str:
        return "watched_folder"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def watch_folder(spark: SparkSession, root: str, state: str, glob: str = "*", shares: int = 4) -> DataFrame:
    """path, event (create, modify or remove), size, mtime, listing: what changes below a folder. What is there at the start is created; events of one batch have the same listing number."""
    spark.dataSource.register(WatchedFolder)
    return spark.readStream.format("watched_folder").option("state", state).option("glob", glob).option("shares", str(shares)).load(root)


class _Quiet(StatefulProcessor):
    """Holds the last event of a path until its timer runs out; a new event sets the timer anew."""

    def __init__(self, quiet_ms: int, columns: list[str], types: str, order: str):
        self.quiet_ms, self.columns, self.types, self.order = quiet_ms, columns, types, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.types)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.columns.index(self.order)
        held = self.last.get() if self.last.exists() else None
        for batch in rows:
            for row in batch[self.columns].astype(object).where(batch[self.columns].notna(), None).itertuples(index=False, name=None):
                if held is None or row[at] >= held[at]:
                    held = row
        self.last.update(tuple(held))
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.handle.registerTimer(due)
        self.due.update((due,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self.last.get()
        self.last.clear()
        self.due.clear()
        yield pd.DataFrame([tuple(row)], columns=self.columns)

    def close(self) -> None: ...


def quiet_events(events: DataFrame, key: str = "path", order: str = "seq", quiet_ms: int = 500) -> DataFrame:
    """The events of a stream, of each key the last by `order` once no event has come for quiet_ms; no other key's events delay it.

    State and timers are keyed, so a burst is one row in the state. Needs the RocksDB state store (see with_rocksdb) and a trigger by processing time, whose
    empty batches let timers run out.
    """
    columns = events.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    processor = _Quiet(quiet_ms, columns, types, order)
    return events.groupBy(key).transformWithStateInPandas(processor, types, "Append", "ProcessingTime")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session like the given one whose streams keep their state in RocksDB."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own
