"""One search over local files, a remote corpus and mail: routing, dictionary words, merge by score, one hit a thread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import is_mail_path
from tessera.operators.federation import collapse_threads, merge_by_score, remote_limit, route
from tessera.operators.index import SearchIndex
from tessera.operators.scratch import written
from tessera.plans.query_text import rewrite_with_dictionary
from tessera.plans.search import MOST_COLLECTED, search_files
from tessera.sources.remote import RemoteServers

Side = Callable[[], SearchIndex | RemoteServers | None]


def dictionary_words(words: DataFrame, query: str) -> list[str]:
    """Registered words that occur in a query: found by Spark, at most as many as the query has substrings."""
    return [r[0] for r in words.where((F.col("word") != "") & F.contains(F.lit(query), F.col("word"))).select("word").distinct().collect()]


class SideOutdated(LookupError):
    """A side has no index of the present schema version."""


def _run_side(name: str, side: Side, query: str, k: int, scope: str | None, exts: list[str] | None, pos_filter: bool) -> DataFrame | None:
    """The side's k best hits, run to their end: a bounded list, so that whatever keeps a side from answering comes up here."""
    index = side()
    if index is None:
        raise SideOutdated(f"{name}: the index is to be rebuilt")
    if isinstance(index, RemoteServers):
        found = index.hits(query, k, scope, exts)[0]
        return found.select("path", "match_count", "score", "paragraphs", F.lit(name).alias("source"), F.lit(None).cast("string").alias("conversation_id"), F.lit(None).cast("long").alias("mail_date"))
    n = remote_limit(k, bool(scope)) if name == "remote" else k
    hits = search_files(index, query, n, scope=scope, exts=exts, pos_filter=pos_filter)
    if hits is None:
        return None
    hits = hits.withColumn("source", F.lit(name))
    if name == "remote":
        hits = hits.where(~is_mail_path(F.col("path")))
    if name == "mail":
        found = index.units.join(hits.select("path"), "path", "left_semi")
        stored = found.groupBy("path").agg(F.first("conversation_id").alias("conversation_id"), F.first("mail_date").alias("mail_date"))
        hits = hits.join(stored, "path", "left")
    else:
        hits = hits.withColumns({"conversation_id": F.lit(None).cast("string"), "mail_date": F.lit(None).cast("long")})
    hits = hits.withColumn("paragraphs", F.transform("paragraphs", lambda p: F.struct(p["nth"].alias("nth"), p["id"].cast("string").alias("id"), p["label"].alias("label"), p["snippet"].alias("snippet"), p["score"].alias("score"))))
    return written(hits, name) if n > MOST_COLLECTED else index.units.sparkSession.createDataFrame(hits.collect(), hits.schema)


def search_sides(
    query: str, k: int, *, local: Side | None = None, remote: Side | None = None, mail: Side | None = None, mode: str = "local", mail_enabled: bool = False,
    scope: str | None = None, exts: list[str] | None = None, words: DataFrame | None = None, collapse: bool = True, pos_filter: bool = True,
) -> tuple[DataFrame | None, dict[str, str]]:
    """The k best files and threads, as search_everywhere() gives them, and what became of each side that was asked: `answered`, `empty` (no positive part in the query), `outdated`, or `failed: ...`.

    Sides are functions that open an index (null: it has another schema version) or name the servers of a remote side. In the hybrid mode a local or remote side that cannot be opened, is outdated, or fails while it is read
    is left out, unless both fail; every other failure is the caller's.
    """
    if words is not None:
        query = rewrite_with_dictionary(query, dictionary_words(words, query))
    asked = dict(zip(("local", "remote", "mail"), route(mode, scope, exts or [], mail_enabled), strict=True))
    spare = {"local", "remote"} if asked["local"] and asked["remote"] else set()
    failed: dict[str, Exception] = {}
    status: dict[str, str] = {}
    lists: list[DataFrame] = []
    for name, side in (("local", local), ("remote", remote), ("mail", mail)):
        if not asked[name] or side is None:
            continue
        try:
            hits = _run_side(name, side, query, k, scope, exts, pos_filter)
        except Exception as why:  # noqa: BLE001  whatever keeps one side of a hybrid search from answering
            if name not in spare:
                raise
            failed[name], status[name] = why, "outdated" if isinstance(why, SideOutdated) else f"failed: {type(why).__name__}"
            continue
        status[name] = "empty" if hits is None else "answered"
        if hits is not None:
            lists.append(hits)
    if spare and spare <= set(failed):
        raise failed["local"]
    merged = lists[0] if lists else None
    for hits in lists[1:]:
        merged = merge_by_score(merged, hits, k, "path")
    if merged is None:
        return None, status
    if collapse:
        ranked = merged.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "source", "path")))  # at most k rows
        merged = collapse_threads(ranked, k).drop("rank")
    return merged.select("path", "source", "match_count", "score", "paragraphs", "mail_date").orderBy(F.desc("score"), "source", "path").limit(k), status


def search_everywhere(query: str, k: int, **options) -> DataFrame | None:
    """path, source, match_count, score, paragraphs, mail_date: the k best files and threads; null where no corpus answers. Options as in search_sides().

    Remote hits are never mail. With `collapse` a conversation is one hit, its newest message.
    """
    return search_sides(query, k, **options)[0]
