"""An inverted index that grows by segments: each batch of changes writes one, and readers see the newest whole version.

Below the folder of a store lie segments/<name>/{units, postings, dead, marks} and versions/v=<n>, one JSON row that names the live segments, oldest first, with
the statistics of all visible units. A segment covers the batches first..last. Its `dead` rows are unit keys of older segments that its changes replaced or
removed; its `marks` hold the last event of every path it saw. A unit is visible if no later segment names its key as dead. All that a batch writes is in proportion to its changes.
Compaction rewrites neighbouring segments as one, postings sorted by term, without what is dead. A version stays for one more version; what no version names goes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import analysis
from tessera.functions.paths import SCOPE_KEY, scope_key
from tessera.operators.incremental import without_excluded
from tessera.operators.index import SearchIndex, postings

#: Live segments of like size that are merged as soon as there are so many.
FAN = 4
FIELDS = ("title", "body")


@dataclass(frozen=True)
class Segment:
    name: str
    first: int
    last: int
    n_units: int
    n_postings: int


@dataclass
class Version:
    """What readers see: the live segments, the last batch in them, and n_units and total_len of the visible units by field."""

    number: int
    batch: int
    segments: list[Segment] = field(default_factory=list)
    n_units: int = 0
    total_len: dict[str, int] = field(default_factory=dict)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, files = _folder(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


class SegmentStore:
    """A store below `path` of units with the column `key`, written by one writer at a time, read by any number."""

    def __init__(self, spark: SparkSession, path: str, key: str = "unit_key", analyzer: str = "unicode_word", fan: int = FAN):
        self.spark, self.path, self.key, self.analyzer, self.fan = spark, path.rstrip("/"), key, analyzer, fan

    # --- versions

    def _versions(self) -> list[int]:
        root = f"{self.path}/versions"
        return sorted(int(n[2:]) for n in _names(self.spark, root) if n.startswith("v=") and "_SUCCESS" in _names(self.spark, f"{root}/{n}"))

    def version(self) -> Version | None:
        """The newest version that was written to its end."""
        found = self._versions()
        if not found:
            return None
        raw = json.loads(self.spark.read.text(f"{self.path}/versions/v={found[-1]}").first()[0])
        return Version(**{**raw, "segments": [Segment(**s) for s in raw["segments"]]})

    def _commit(self, version: Version) -> None:
        """Writes the version and deletes what neither it nor the one before names."""
        self.spark.createDataFrame([(json.dumps(asdict(version)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/versions/v={version.number}")
        before = [n for n in self._versions() if n < version.number]
        kept = {s.name for s in version.segments}
        if before:
            last = json.loads(self.spark.read.text(f"{self.path}/versions/v={before[-1]}").first()[0])
            kept |= {s["name"] for s in last["segments"]}
        gone = [f"versions/v={n}" for n in before[:-1]] + [f"segments/{n}" for n in _names(self.spark, f"{self.path}/segments") if n not in kept]
        for name in gone:
            at, files = _folder(self.spark, f"{self.path}/{name}")
            files.delete(at, True)

    # --- reading

    def _read(self, version: Version, what: str) -> DataFrame | None:
        """A table of all live segments with _first and _last of the segment of each row."""
        parts = [self.spark.read.parquet(f"{self.path}/segments/{s.name}/{what}").withColumns({"_first": F.lit(s.first), "_last": F.lit(s.last)}) for s in version.segments]
        if what == "units":  # segments of before the key was stored
            parts = [p if SCOPE_KEY in p.columns else p.withColumn(SCOPE_KEY, scope_key(F.col("path"))) for p in parts]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def _visible(self, version: Version, what: str) -> DataFrame | None:
        rows = self._read(version, what)
        if rows is None:
            return None
        dead = self._read(version, "dead").groupBy(self.key).agg(F.max("_first").alias("_before")).withColumnRenamed(self.key, "_key")
        return rows.join(dead, (rows[self.key] == dead["_key"]) & (rows["_last"] < dead["_before"]), "left_anti")

    def index(self) -> SearchIndex | None:
        """The visible units and postings of the newest version as a search index; null before the first batch."""
        version = self.version()
        if version is None or not version.segments:
            return None
        stats = [(f, version.n_units, n, n / version.n_units if version.n_units else 0.0) for f, n in sorted(version.total_len.items())]
        stored = self.spark.createDataFrame(stats, "field string, n_units long, total_len long, avg_len double")
        units = self._visible(version, "units").drop("_first", "_last", *(f"_len_{f}" for f in FIELDS))
        return SearchIndex(units, self._visible(version, "postings").drop("_first", "_last"), stored, self.key, self.analyzer)

    def states(self) -> DataFrame | None:
        """path, seq, removed, fingerprint: the last event of every path."""
        version = self.version()
        return None if version is None or not version.segments else self._last_marks(self._read(version, "marks"))

    @staticmethod
    def _last_marks(marks: DataFrame) -> DataFrame:
        last = marks.groupBy("path").agg(F.max_by(F.struct("seq", "removed", "fingerprint"), "seq").alias("m"))
        return last.select("path", "m.*")

    # --- writing

    def apply(self, changes: DataFrame, batch: int, read: Callable[[DataFrame], DataFrame], excluded: DataFrame | None = None) -> Version:
        """Takes a batch of events into the index: path, seq, removed, fingerprint, and whatever `read` needs to give the units of files.

        Of each path the event with the highest seq counts, over all batches. A path that lies in an `excluded` one is not indexed; removals of such paths
        count. A file whose fingerprint (if not null) is that of its last event is only marked. `read` gets the rows to index and returns units: path, title,
        body, the key, and more. Null paths are left out. A batch that is in the index already changes nothing; a batch that failed is written anew.
        """
        old = self.version() or Version(-1, -1)
        if batch <= old.batch:
            return old
        events = changes.where("path is not null").withColumn("removed", F.coalesce("removed", F.lit(False)))
        last = events.groupBy("path").agg(F.max_by(F.struct(*(c for c in events.columns if c != "path")), "seq").alias("e")).select("path", "e.*")
        if excluded is not None:
            last = without_excluded(last.where("not removed"), excluded).unionByName(last.where("removed"))
        known = self._read(old, "marks")
        if known is None:
            won = last.withColumn("_same", F.lit(False))
        else:
            touched = known.join(last.select("path"), "path", "left_semi")
            before = self._last_marks(touched).select(F.col("path").alias("_path"), F.col("seq").alias("_seq"), F.col("removed").alias("_removed"), F.col("fingerprint").alias("_fingerprint"))
            same = ~F.col("removed") & ~F.col("_removed") & (F.col("fingerprint") == F.col("_fingerprint"))
            won = last.join(before, last["path"] == before["_path"], "left").where("_seq is null or seq > _seq").withColumn("_same", F.coalesce(same, F.lit(False))).drop("_path", "_seq", "_removed", "_fingerprint")
        name = f"b{batch:08d}"
        root = f"{self.path}/segments/{name}"
        won.write.mode("overwrite").parquet(f"{root}/marks")
        won = self.spark.read.schema(won.schema).parquet(f"{root}/marks")
        new = won.where("not _same")
        visible = self._visible(old, "units")
        if visible is None:
            dead = new.where("false").select(F.lit(None).cast("string").alias(self.key), *(F.lit(0).cast("long").alias(f"_len_{f}") for f in FIELDS))
        else:
            dead = visible.join(new.select("path"), "path", "left_semi").select(self.key, *(f"_len_{f}" for f in FIELDS))
        dead.write.mode("overwrite").parquet(f"{root}/dead")
        fresh = read(new.where("not removed").drop("_same"))
        fresh = fresh.withColumns({f"_len_{f}": F.greatest(F.size(analysis.terms(F.col(f), self.analyzer)), F.lit(0)).cast("long") for f in FIELDS})
        fresh = fresh.withColumn(SCOPE_KEY, scope_key(F.col("path")))
        fresh.sortWithinPartitions(SCOPE_KEY).write.mode("overwrite").parquet(f"{root}/units")
        fresh = self.spark.read.schema(fresh.schema).parquet(f"{root}/units")
        self._write_postings(postings(fresh, self.key, FIELDS, self.analyzer), root)
        plus, minus = (self._sums(t) for t in (fresh, self.spark.read.schema(dead.schema).parquet(f"{root}/dead")))
        count = self.spark.read.parquet(f"{root}/postings").count()
        version = Version(old.number + 1, batch, [*old.segments, Segment(name, batch, batch, plus[0], count)], old.n_units + plus[0] - minus[0], {f: old.total_len.get(f, 0) + plus[1][f] - minus[1][f] for f in FIELDS})
        self._commit(version)
        while (run := self._due(version.segments)) is not None:
            version = self.compact(*run)
        return version

    def _write_postings(self, rows: DataFrame, root: str) -> None:
        """Dealt by term and a share of the keys, so that a common term fills several files, and sorted by term, so that a filter on it prunes row groups."""
        dealt = rows.repartition("term", F.pmod(F.xxhash64(self.key), F.lit(8))).sortWithinPartitions("term", self.key)
        dealt.write.mode("overwrite").parquet(f"{root}/postings")

    def _sums(self, units: DataFrame) -> tuple[int, dict[str, int]]:
        row = units.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"_len_{f}"), F.lit(0)).alias(f) for f in FIELDS)).first()
        return row["n"], {f: row[f] for f in FIELDS}

    def _due(self, segments: list[Segment]) -> tuple[int, int] | None:
        """The newest run of `fan` neighbours, none of which is more than `fan` times the others' sum: (from, to)."""
        for to in range(len(segments), self.fan - 1, -1):
            run = [s.n_postings for s in segments[to - self.fan : to]]
            if max(run) <= self.fan * (sum(run) - max(run) + 1):
                return to - self.fan, to
        return None

    def compact(self, start: int = 0, stop: int | None = None) -> Version:
        """Writes the live segments start..stop as one: visible units and postings, last marks, and the dead keys of segments still older."""
        old = self.version()
        stop = len(old.segments) if stop is None else stop
        run = old.segments[start:stop]
        first, last = run[0].first, run[-1].last
        name = f"c{first:08d}-{last:08d}-{old.number + 1}"
        root = f"{self.path}/segments/{name}"
        inner = Version(old.number, old.batch, run)
        units = self._visible(inner, "units").drop("_first", "_last")
        units.repartitionByRange(SCOPE_KEY, self.key).sortWithinPartitions(SCOPE_KEY).write.mode("overwrite").parquet(f"{root}/units")
        self._write_postings(self._visible(inner, "postings").drop("_first", "_last"), root)
        dead = self._read(inner, "dead").drop("_first", "_last")
        (dead.where("false") if start == 0 else dead.dropDuplicates([self.key])).write.mode("overwrite").parquet(f"{root}/dead")
        marks = self._read(inner, "marks")
        self._last_marks(marks).withColumn("_same", F.lit(False)).write.mode("overwrite").parquet(f"{root}/marks")
        counts = [self.spark.read.parquet(f"{root}/{t}").count() for t in ("units", "postings")]
        version = Version(old.number + 1, old.batch, [*old.segments[:start], Segment(name, first, last, *counts), *old.segments[stop:]], old.n_units, old.total_len)
        self._commit(version)
        return version


def segment_upsert(store: SegmentStore, read: Callable[[DataFrame], DataFrame], excluded: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A function for a stream's micro-batches (see watch.index_stream) that takes each into the store."""

    def upsert(batch: DataFrame, number: int) -> None:
        store.apply(batch, number, read, excluded)

    return upsert
