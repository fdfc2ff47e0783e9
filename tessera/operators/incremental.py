"""Incremental indexing: change detection, orphans, exclusions, owners, replacement of units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import ancestors, fold_path


def change_states(scanned: DataFrame, catalog: DataFrame) -> DataFrame:
    """path, state: `new`, `unchanged` (size, mtime and hash equal), `changed`, or `orphan` (no longer there). One full join on path."""
    a = scanned.select("path", "size", "mtime", "content_hash")
    b = catalog.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("content_hash").alias("_hash"))
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("content_hash").eqNullSafe(F.col("_hash"))
    state = F.when(F.col("_path").isNull(), "new").when(F.col("path").isNull(), "orphan").when(same, "unchanged").otherwise("changed")
    return a.join(b, a["path"] == b["_path"], "full").select(F.coalesce("path", "_path").alias("path"), state.alias("state"))


def orphans(catalog: DataFrame, scanned: DataFrame) -> DataFrame:
    return catalog.join(scanned.select("path"), "path", "left_anti")


def without_excluded(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """Files that lie in no excluded path; letters and slashes of both kinds compare alike. Paths are expanded to their ancestors and joined by key."""
    parts = files.select(F.col("path").alias("_path"), F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("_p")).select("_path", fold_path(F.col("_p")).alias("_p"))
    hit = parts.join(excluded.select(fold_path(F.col("path")).alias("_p")).distinct(), "_p", "left_semi").select("_path").distinct()
    return files.join(hit, files["path"] == hit["_path"], "left_anti")


def owners(events: DataFrame, folders: DataFrame) -> DataFrame:
    """path, folder: the first registered folder (least order) that contains each path, as it was registered, else null. Compared as in without_excluded."""
    parts = events.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("_p")).select("path", fold_path(F.col("_p")).alias("_p"))
    hit = parts.join(folders.select(fold_path(F.col("path")).alias("_p"), F.col("path").alias("_folder"), "order"), "_p").groupBy("path").agg(F.min_by("_folder", "order").alias("folder"))
    return events.select("path").distinct().join(hit, "path", "left")


def replace_units(index: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The units without those of changed or removed paths, plus the fresh ones: one commit for a batch."""
    out = index.join(fresh.select("path").distinct(), "path", "left_anti")
    if gone is not None:
        out = out.join(gone.select("path"), "path", "left_anti")
    return out.unionByName(fresh, allowMissingColumns=True)


def mail_changed(messages: DataFrame, catalog: DataFrame, indexed: DataFrame) -> DataFrame:
    """Messages to index: not those whose fingerprint, folder and status are as listed and which are in the index."""
    same = catalog.where("status = 'indexed'").select("path", "content_hash", "folder_name").join(indexed.select("path").distinct(), "path", "left_semi")
    return messages.join(same, ["path", "content_hash", "folder_name"], "left_anti")


def fingerprint(*columns: str):
    """MD5 of the columns with a separator that none of them holds; nulls count as empty."""
    return F.md5(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
