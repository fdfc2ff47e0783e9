"""Catalog tables: schemas, upserts, listings and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import ancestors, fold_path, has_prefix, top_folder

#: Column definitions of the catalog's tables.
SCHEMAS = {
    "settings": "key string, value string",
    "folders": "id long, path string, public_path string, enabled boolean, created_at timestamp",
    "files": "id long, folder_id long, path string, ext string, size long, mtime long, content_hash string, indexed_at timestamp, status string",
    "exclude_paths": "id long, path string",
    "search_words": "id long, word string, reading string, pos_label string, created_at timestamp",
    "email_folders": "id long, store_id string, entry_id string, name string, path_label string, selected boolean, item_count long",
    "email_messages": "path string, store_id string, entry_id string, conversation_id string, folder_name string, from_addr string, subject string, date_unix long, content_hash string, status string, indexed_at timestamp",
    "email_threads": "conversation_id string, path string, date_unix long",
}
#: Settings with their defaults.
DEFAULTS = {"max_results": "10", "search_mode": "local", "pos_filter_enabled": "1", "mail_enabled": "0", "mail_thread_collapse": "1", "mail_lookback_days": "730", "mail_sync_interval_secs": "3600", "remote_timeout_ms": "3000"}


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """The table with the rows inserted or, where their key exists, put in place; of several new rows with one key the last by `order`, else any one."""
    if order is None:
        rows = rows.dropDuplicates(keys)
    else:
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_nth = 1").drop("_nth")
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def replace_keeping(new: DataFrame, old: DataFrame, keys: list[str], flag: str = "selected") -> DataFrame:
    """The new rows with the old rows' flag where their key existed."""
    before = old.select(*keys, F.col(flag).alias("_was"))
    return new.drop(flag).join(before, keys, "left").withColumn(flag, F.coalesce("_was", F.lit(False))).drop("_was")


def set_selection(table: DataFrame, chosen: DataFrame, keys: list[str], flag: str = "selected") -> DataFrame:
    marked = chosen.select(*keys).distinct().withColumn("_on", F.lit(True))
    return table.drop(flag).join(marked, keys, "left").withColumn(flag, F.coalesce("_on", F.lit(False))).drop("_on")


def remove_folder(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Units, files and folders without what lies in a folder."""
    inside = has_prefix(F.col("path"), F.lit(folder))
    return {name: t.where(~inside) for name, t in tables.items()}


def folder_counts(folders: DataFrame, files: DataFrame, key: str = "folder", by: str = "folder") -> DataFrame:
    counted = files.groupBy(F.col(by).alias("_k")).agg(F.count("*").alias("file_count"))
    return folders.join(counted, folders[key] == F.col("_k"), "left").drop("_k").withColumn("file_count", F.coalesce("file_count", F.lit(0)))


def mail_folder_counts(folders: DataFrame, messages: DataFrame) -> DataFrame:
    """Indexed messages of each folder's store under either of its names. The OR is two keyed counts, not a nested loop."""
    done = messages.where("status = 'indexed'").groupBy("store_id", "folder_name").agg(F.count("*").alias("n"))
    names = folders.select("id", "store_id", F.explode(F.array_distinct(F.array("path_label", "name"))).alias("folder_name"))
    per = names.join(done, ["store_id", "folder_name"]).groupBy("id").agg(F.sum("n").alias("indexed_count"))
    return folders.join(per, "id", "left").withColumn("indexed_count", F.coalesce("indexed_count", F.lit(0)))


def settings_record(settings: DataFrame) -> DataFrame:
    """Key/value rows as one row with defaults; flags accept 1 and true, thread collapse anything but 0 and false."""
    got = settings.agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in DEFAULTS))
    text = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in DEFAULTS.items()}
    number = lambda k, low, high: F.least(F.greatest(F.coalesce(text[k].try_cast("long"), F.lit(int(DEFAULTS[k]))), F.lit(low)), F.lit(high)).alias(k)
    flag = lambda k: F.lower(text[k]).isin("1", "true").alias(k)
    return got.select(
        number("max_results", 1, 1000), text["search_mode"].alias("search_mode"), flag("pos_filter_enabled"), flag("mail_enabled"), (~F.lower(text["mail_thread_collapse"]).isin("0", "false")).alias("mail_thread_collapse"),
        number("mail_lookback_days", 1, 3650), number("mail_sync_interval_secs", 0, 2**31), number("remote_timeout_ms", 500, 60000),
    )


def scope_tree(files: DataFrame, per_root: int = 400) -> DataFrame:
    """Folders above indexed files: root, path, n_files; up to per_root per root in label order, letters compared without case."""
    rows = files.select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy(fold_path(F.col("path")).alias("low")).agg(F.min("path").alias("path"), F.count("*").alias("n_files"))
    rows = rows.withColumn("root", top_folder(F.col("path")))
    nth = F.row_number().over(Window.partitionBy(F.lower("root")).orderBy("low"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= per_root).select("root", "path", "n_files")


def scopes_with_hits(scopes: DataFrame, hits: DataFrame, recent: list[str] | None = None) -> DataFrame:
    """Scopes that contain a hit, without recently used ones: hits are expanded to their ancestors and joined by key."""
    above = hits.select(F.explode(ancestors(F.col("path"))).alias("_p")).select(fold_path(F.col("_p")).alias("_p")).distinct()
    out = scopes.join(above, fold_path(scopes["path"]) == above["_p"], "left_semi")
    return out.where(~fold_path(F.col("path")).isin([r.lower().replace("\\", "/").rstrip("/") for r in recent])) if recent else out


def recent_scopes(uses: DataFrame, n: int = 3) -> DataFrame:
    """The n most recently used scopes; letters compared without case: path, last."""
    return uses.groupBy(F.lower("path").alias("_k")).agg(F.max_by("path", "t").alias("path"), F.max("t").alias("last")).drop("_k").orderBy(F.desc("last"), "path").limit(n)


def dictionary_import(rows: DataFrame, words: DataFrame) -> DataFrame:
    """One row: added, updated, skipped. Blank and repeated words of an import are skipped; the last wins."""
    named = rows.withColumn("word", F.trim("word"))
    blank = named.agg(F.count_if((F.col("word") == "") | F.col("word").isNull()).alias("blank"), F.count("*").alias("all"))
    new = named.where("word <> ''").select("word").distinct()
    old = words.select(F.col("word").alias("_w")).distinct()
    both = new.join(old, new["word"] == old["_w"], "left").agg(F.count_if(F.col("_w").isNull()).alias("added"), F.count_if(F.col("_w").isNotNull()).alias("updated"))
    return both.crossJoin(blank).select("added", "updated", (F.col("all") - F.col("added") - F.col("updated")).alias("skipped"))  # one row each


def remove_rows(table: DataFrame, gone: DataFrame | None, keys: list[str]) -> DataFrame:
    """The table without the rows of the given keys; without keys to name, an empty table (clear)."""
    return table.where("false") if gone is None else table.join(gone.select(*keys), keys, "left_anti")


def find_rows(table: DataFrame, column: str, value: object, n: int = 1) -> DataFrame:
    """Point lookup by path, id, word or conversation; the filter reaches the scan."""
    return table.where(F.col(column) == value).limit(n)


def has_rows(paths: DataFrame, units: DataFrame) -> DataFrame:
    """path, present: whether the index holds a unit of each path."""
    there = units.select("path", F.lit(True).alias("present")).distinct()
    return paths.select("path").distinct().join(there, "path", "left").select("path", F.coalesce("present", F.lit(False)).alias("present"))


def listing(table: DataFrame, *columns: str, order: str) -> DataFrame:
    """Rows of a catalog table in order of a column, letters compared without case: exclusions, words, paths of a folder."""
    return table.select(*columns).orderBy(F.lower(F.col(order).cast("string")), order)


def selected_folders(folders: DataFrame) -> DataFrame:
    return folders.where("selected")


def mail_folder_names(messages: DataFrame) -> DataFrame:
    """Distinct non-empty folder names of indexed mail, letters compared without case."""
    return messages.where("status = 'indexed' and folder_name <> ''").select("folder_name").distinct().orderBy(F.lower("folder_name"), "folder_name")


def indexed_mail_count(messages: DataFrame) -> DataFrame:
    """n: one row."""
    return messages.agg(F.count_if(F.col("status") == "indexed").alias("n"))
