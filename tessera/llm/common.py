"""Helpers shared by the corpus operators: scratch tables, components, column picking."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode, where driver and executors are one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="tessera-")
    return _own_dir[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back, so that nothing above is recomputed.

    The files outlive lost executors; the schema is passed on so that an empty result also reads back. They go when the driver's
    process ends, if discard() did not delete them before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Has the file system delete a written folder when the driver's process ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialize() made and nobody reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Selects df's columns under internal names, so that no other column of df can clash."""
    return df.select(*(df[f"`{old}`"].alias(new) for new, old in columns.items()))


def spare_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until no column of df has it (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Nodes with more than this part of all edges are hubs, so there are at most twice as many hubs as this.
HUB_PART = 2000


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds to each edge (u, v) m, the least of u and all its v.

    Minima and degrees come by partial aggregation. Those of hubs, at most 2 * HUB_PART by their definition, are broadcast to their edges,
    so that no task gets a hub's edges; the other nodes' edges meet in a shuffle.
    """
    low = materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "stars")
    most = low.agg(F.sum("n")).first()[0] or 0
    named = low.withColumnRenamed("u", "_u")
    hubs = F.broadcast(named.where(F.col("n") > most / HUB_PART).select("_u", "m"))
    rest = named.where(F.col("n") <= most / HUB_PART).select("_u", "m")
    on = F.col("u") == F.col("_u")
    return edges.join(hubs, on).drop("_u").unionByName(edges.join(hubs.select("_u"), on, "left_anti").join(rest.hint("merge"), on).drop("_u"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node per node of the undirected edges (a, b): columns node, component.

    Alternates large-star and small-star contraction until all nodes hang on roots. Every round shuffles edges only and
    writes them to the shared folder; see _with_least for hubs. Null ends are ignored; an empty input gives an empty result.
    """
    e = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        # done when no node has two edges and no root hangs on another
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("n")).union(e.select(F.col("v"), F.lit(0)))
        if ends.groupBy("x").agg(F.sum("n").alias("up"), F.min("n").alias("root")).where("up > 1 or (up = 1 and root = 0)").isEmpty():
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the neighbours above a node hang on the least of its neighbours and itself
        large = materialize(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        # small star: a node and its lower neighbours hang on the least of these
        small = _with_least(large).select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, e = e, materialize(small, "edges")
        discard(before, large)
    else:
        raise RuntimeError("components did not settle")
    tops = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
