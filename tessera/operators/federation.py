"""Combining hits: score merge, hybrid routing, thread collapse, latest only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import MAIL_FOLDER_SCOPE


def merge_by_score(one: DataFrame, two: DataFrame, k: int, key: str = "unit_key") -> DataFrame:
    """Both lists together, best score first, k rows; no scores are rescaled and no copies removed."""
    return one.unionByName(two, allowMissingColumns=True).orderBy(F.desc("score"), "source", key).limit(k)


def route(mode: str, scope: str | None, exts: list[str], mail_enabled: bool) -> tuple[bool, bool, bool]:
    """(local, remote, mail): which corpora a search asks. Unknown modes are local.

    Mail folders are searched in the mail alone; mail also answers searches without scope and types, in every mode.
    """
    scope = (scope or "").strip().lower()
    if scope.startswith(MAIL_FOLDER_SCOPE):
        return False, False, mail_enabled
    mode = mode if mode in ("remote", "hybrid") else "local"
    return mode != "remote", mode != "local", mail_enabled and not scope and not exts


def first_preview(unit: object, mail_id: bool, *corpora: DataFrame, key: str = "unit_key") -> DataFrame:
    """The stored row of a unit from the first corpus that has it: as given, or mail before files for a mail id."""
    order = [*corpora] if not mail_id or len(corpora) < 2 else [corpora[1], corpora[0], *corpora[2:]]
    rows = [c.where(F.col(key) == unit).limit(1).withColumn("_nth", F.lit(i)) for i, c in enumerate(order)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.orderBy("_nth").limit(1).drop("_nth")


def remote_limit(limit: int | None, scoped: bool = False) -> int:
    """What a remote side is asked for: 10 unless given, 1 to 50, four times as many under a scope."""
    return min(50, max(1, (10 if limit is None else limit) * (4 if scoped else 1)))


def without_mail(hits: DataFrame) -> DataFrame:
    return hits.where((F.col("doc_kind") != "email") & ~F.lower("path").startswith("outlook:"))


def collapse_threads(hits: DataFrame, k: int | None, conversation: str = "conversation_id", date: str = "mail_date", rank: str = "rank", count: str = "match_count") -> DataFrame:
    """One row per conversation in the place of its first hit: the newest message (of equal dates the later ranked).

    Its count grows along the ranks: by at least 1 and the member's own count where a member is newest so far, else by 1. Rows without
    a conversation stay by themselves. Without `k` all rows, in no order.
    """
    alone = F.coalesce(F.col(conversation), F.lit("")) == ""
    group = F.when(alone, F.concat(F.lit("\u0000"), F.col(rank).cast("string"))).otherwise(F.col(conversation))
    dated = hits.withColumn("_g", group).withColumn("_d", F.coalesce(F.col(date).try_cast("long"), F.lit(0)))
    in_order = Window.partitionBy("_g").orderBy(rank)
    before = F.max("_d").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    adds = F.when(before.isNull(), F.col(count)).when(F.col("_d") >= before, F.greatest(F.col(count), F.lit(1))).otherwise(F.lit(1))
    row = F.struct(*hits.columns)
    out = dated.withColumn("_n", adds).groupBy("_g").agg(F.max_by(row, F.struct("_d", rank)).alias("_row"), F.min(rank).alias("_first"), F.sum("_n").alias("_count"))
    fields = [F.col("_count").cast("long").alias(c) if c == count else F.col("_first").alias(c) if c == rank else F.col("_row")[c].alias(c) for c in hits.columns]
    out = out.select(*fields)
    return out if k is None else out.orderBy(rank).limit(k)


def latest_only(messages: DataFrame, conversation: str = "conversation_id", date: str = "date", path: str = "path") -> DataFrame:
    """Adds status: `indexed` for the newest message of each conversation (equal dates: the first path), else `superseded`.

    Messages without a conversation are all indexed; each is a group of its own.
    """
    alone = F.when(F.col(conversation).isNull(), F.col(path))
    nth = F.row_number().over(Window.partitionBy(conversation, alone).orderBy(F.desc(date), path))
    return messages.withColumn("status", F.when((nth == 1) | F.col(conversation).isNull(), "indexed").otherwise("superseded"))
