"""Mail as tables: messages from mailbox items, their units, and a sync of items with the catalog and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.html import mail_body
from tessera.functions.paths import mail_path
from tessera.functions.segment import segment_pages
from tessera.operators.catalog import upsert
from tessera.operators.incremental import fingerprint

#: Title of a message without a subject. Fixed value.
NO_SUBJECT = "(件名なし)"
#: Class of mail items; items without a class count as mail. Fixed value.
MAIL_CLASS = 43


def _or_empty(*names: str) -> Column:
    return F.coalesce(*(F.col(n) for n in names), F.lit(""))


def read_messages(items: DataFrame, folders: DataFrame, since: int = 0) -> DataFrame:
    """Messages of the selected folders: path, store_id, entry_id, subject, body, from_addr, conversation_id, folder_name, date_unix, content_hash.

    items: store_id, folder_id, entry_id, class, subject, plain, html, sender, behalf, conversation_id, received, sent. Items of other
    classes, without an entry id, or received before `since` go; the sender falls back to whom it was sent for, the time of receipt to that
    of sending, a blank plain body to the text of the HTML one; other nulls are empty texts, a missing time is 0.
    """
    chosen = folders.where("selected").select("store_id", F.col("entry_id").alias("folder_id"), F.col("path_label").alias("folder_name"))
    mail = items.where((F.coalesce("class", F.lit(0)).isin(0, MAIL_CLASS)) & (_or_empty("entry_id") != "")).join(chosen, ["store_id", "folder_id"])
    m = mail.select(
        mail_path(F.col("store_id"), F.col("entry_id")).alias("path"), "store_id", "entry_id", _or_empty("subject").alias("subject"), mail_body(F.col("plain"), F.col("html")).alias("body"),
        _or_empty("sender", "behalf").alias("from_addr"), _or_empty("conversation_id").alias("conversation_id"), "folder_name", F.coalesce("received", "sent", F.lit(0)).cast("long").alias("date_unix"),
    )
    if since > 0:
        m = m.where((F.col("date_unix") <= 0) | (F.col("date_unix") >= since))
    return m.withColumn("content_hash", fingerprint("subject", "from_addr", "date_unix", "conversation_id", "body"))


def mail_units(messages: DataFrame) -> DataFrame:
    """Units of messages for the index. A blank subject gives the title NO_SUBJECT, a blank body is the title; the extension is `msg`."""
    title = F.when(F.col("subject").rlike(r"\S"), F.col("subject")).otherwise(NO_SUBJECT)
    titled = messages.withColumn("title", title)
    titled = titled.withColumn("pages", F.array(F.when(F.col("body").rlike(r"\S"), F.col("body")).otherwise(F.col("title"))))
    u = segment_pages(titled, keep=("path", "title", "from_addr", "date_unix", "conversation_id", "folder_name"))
    return u.select(
        F.concat_ws("#", "path", "unit_id").alias("unit_key"), "path", "title", F.col("text").alias("body"), F.lit("msg").alias("ext"), F.lit("email").alias("doc_kind"),
        F.col("from_addr").alias("mail_from"), F.col("date_unix").alias("mail_date"), "conversation_id", F.col("folder_name").alias("mail_folder"), "unit_id", "label",
    )


def sync_messages(messages: DataFrame, catalog: DataFrame, units: DataFrame, latest: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, units, states) after a sync of messages with one row for each path.

    Unchanged messages (fingerprint, folder and status as listed, and in the index) are skipped. With `latest`, one message of each
    conversation stays indexed: the newest; of equal dates the one indexed before, then the least path. Others are `superseded` and leave
    the index. states: path, state (indexed, skipped or superseded) of the messages. The winner of a conversation comes from a partial
    aggregation, so a thread of many messages is in no task as a whole; messages without a conversation don't compete.
    """
    rows = messages.select("path", "store_id", "entry_id", "conversation_id", "folder_name", "from_addr", "subject", "date_unix", "content_hash")
    listed = catalog.select(*rows.columns, "status")
    was = listed.select("path", F.col("content_hash").alias("_hash"), F.col("folder_name").alias("_folder"), (F.col("status") == "indexed").alias("_was"))
    there = units.select("path", F.lit(True).alias("_there")).distinct()
    new = rows.join(was, "path", "left").join(there, "path", "left").withColumn("_was", F.coalesce("_was", F.lit(False)))
    same = F.col("_was") & F.coalesce("_there", F.lit(False)) & F.col("content_hash").eqNullSafe(F.col("_hash")) & F.col("folder_name").eqNullSafe(F.col("_folder"))
    new = new.withColumn("_same", same).drop("_hash", "_folder", "_there")
    old = listed.join(rows.select("path"), "path", "left_anti").withColumn("_was", F.col("status") == "indexed").withColumn("_same", F.lit(None).cast("boolean")).drop("status")
    every = new.unionByName(old)
    wins = F.lit(True)
    if latest:
        named = F.coalesce("conversation_id", F.lit("")) != ""
        order = F.struct(-F.col("date_unix"), ~F.col("_was"), F.col("path"))
        winner = every.where(named & (F.col("_was") | F.col("_same").isNotNull())).groupBy("conversation_id").agg(F.min_by("path", order).alias("path"))
        every = every.join(winner.select("path", F.lit(True).alias("_wins")), "path", "left")
        wins = ~named | F.coalesce("_wins", F.lit(False))
    every = every.withColumn("status", F.when(wins & (F.col("_was") | F.col("_same").isNotNull()), "indexed").otherwise("superseded"))
    states = every.where("_same is not null").select("path", F.when(F.col("status") == "superseded", "superseded").when(F.col("_same"), "skipped").otherwise("indexed").alias("state"))
    fresh = mail_units(messages.join(states.where("state = 'indexed'"), "path", "left_semi"))
    kept = units.join(every.where("status = 'superseded' or not _same").select("path"), "path", "left_anti").unionByName(fresh, allowMissingColumns=True)
    return upsert(catalog, every.select(*rows.columns, "status"), ["path"]).select(*rows.columns, "status"), kept, states


def sync_counts(states: DataFrame) -> DataFrame:
    """indexed, skipped, superseded: one row."""
    return states.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("indexed", "skipped", "superseded")))
