"""Registered words for completion: ranged by word, so that a prefix reads the row groups that hold it; kept up to date by deltas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CompletionIndex:
    """Words below a shared folder: `base-n` holds all words up to version n, `delta-n` the changes of version n.

    A delta costs what it changes. A lookup reads the newest base and the deltas after it, each by a prefix filter that reaches the Parquet
    statistics. More than `most` deltas are merged with the base; the next merge deletes what this one replaced. Folders count once they are
    complete (`_SUCCESS`), so a job that dies leaves the version before it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 8):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most

    @classmethod
    def build(cls, words: DataFrame, root: str, most: int = 8) -> CompletionIndex:
        """The index of a column `word`; blanks around words, empty and repeated words do not count."""
        index = cls(words.sparkSession, root, most)
        index._write_base(words.select(F.trim("word").alias("term")).where("term <> ''").distinct(), 0)
        return index

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _state(self) -> tuple[int, list[int], list[str]]:
        """Version of the newest base, versions of the deltas after it, and the folders that neither names."""
        fs, found = self._fs(), {}
        for s in fs.listStatus(self._path(".")):
            name = s.getPath().getName()
            if (m := re.fullmatch(r"(base|delta)-(\d+)", name)) and fs.exists(self._path(f"{name}/_SUCCESS")):
                found.setdefault(m[1], []).append(int(m[2]))
        base = max(found["base"])
        deltas = sorted(n for n in found.get("delta", []) if n > base)
        return base, deltas, [f"{kind}-{n}" for kind, ns in found.items() for n in ns if n < base or (kind, n) == ("delta", base)]

    def _write_base(self, terms: DataFrame, version: int) -> None:
        ranged = terms.repartitionByRange("term").sortWithinPartitions("term")
        ranged.write.option("parquet.block.size", 1 << 20).mode("overwrite").parquet(f"{self.root}/base-{version}")

    def version(self) -> int:
        base, deltas, _ = self._state()
        return deltas[-1] if deltas else base

    def apply(self, changes: DataFrame) -> int:
        """Writes changes (word, removed) as the next version and returns it; a word that is both added and removed in it is there."""
        version = self.version() + 1
        rows = changes.select(F.trim("word").alias("term"), F.coalesce("removed", F.lit(False)).alias("removed")).where("term <> ''")
        rows = rows.groupBy("term").agg(F.bool_and("removed").alias("removed"))
        rows.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.root}/delta-{version}")
        if len(self._state()[1]) > self.most:
            self.compact()
        return version

    def compact(self) -> None:
        """One base in place of base and deltas. Folders that an earlier merge replaced go; those that this one replaces stay for readers that began before it."""
        base, deltas, old = self._state()
        if deltas:
            self._write_base(self.starting(""), deltas[-1])
        for name in old:
            self._fs().delete(self._path(name), True)

    def starting(self, prefix: str) -> DataFrame:
        """term: the words that start with the prefix (case counts), each once; all words for an empty one."""
        base, deltas, _ = self._state()
        within = lambda df: df.where(F.col("term").startswith(prefix)) if prefix else df
        terms = within(self.spark.read.schema("term string").parquet(f"{self.root}/base-{base}"))
        if not deltas:
            return terms
        changed = [within(self.spark.read.schema("term string, removed boolean").parquet(f"{self.root}/delta-{n}")).withColumn("n", F.lit(n)) for n in deltas]
        rows = terms.select("term", F.lit(False).alias("removed"), F.lit(base).alias("n"))
        for c in changed:
            rows = rows.union(c)
        return rows.groupBy("term").agg(F.max_by("removed", "n").alias("removed")).where("not removed").select("term")
