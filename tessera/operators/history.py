"""Search history and term suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.completion import CompletionIndex
from tessera.plans import query_text as qt

HALF_LIFE = 7 * 86400
EVENTS, STATS, SUGGESTIONS = 30, 100, 8


def usage_stats(events: DataFrame, n: int = STATS) -> DataFrame:
    """term, count, last: the n terms used last (ties: more often, then by name)."""
    stats = events.groupBy("term").agg(F.count("*").alias("count"), F.max("t").alias("last"))
    return stats.orderBy(F.desc("last"), F.desc("count"), "term").limit(n)


def recent_events(events: DataFrame, n: int = EVENTS) -> DataFrame:
    """The n newest events (event_id, terms, t) with their rank from 0."""
    top = events.orderBy(F.desc("t"), F.desc("event_id")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("t"), F.desc("event_id"))) - 1)  # n rows


def base_score(count: Column, last: Column, now: int) -> Column:
    """Frequency and recency: 2 ln(1 + count) + 2^(-age / 7 days); no recency without a time."""
    recency = F.when(last <= 0, 0.0).otherwise(F.pow(F.lit(2.0), -F.greatest(F.lit(now) - last, F.lit(0)) / F.lit(float(HALF_LIFE))))
    return 2 * F.ln(1 + count) + recency


def registered_terms(registered: DataFrame | CompletionIndex, prefix: str = "") -> DataFrame:
    """term: the registered words that start with the prefix, each once; from an index only their range is read."""
    if isinstance(registered, CompletionIndex):
        return registered.starting(prefix)
    return registered.select(F.trim("word").alias("term")).where(F.col("term").startswith(prefix)).distinct()


def prefix_suggestions(stats: DataFrame, registered: DataFrame | CompletionIndex, token: str, committed: list[str], now: int, first: int | None = None) -> DataFrame:
    """Terms of history or dictionary that extend the token: term, kind, score, from_history, from_registered.

    With first, of the words outside the history only those that can be among the first so many suggestions: their scores are equal, so
    these are the first by name, and one more for each committed term and the token, which are left out.
    """
    known = stats.where(F.col("term").startswith(token)).select("term", "count", "last", F.lit(True).alias("h"))
    words = registered_terms(registered, token)
    if first is not None:
        others = words.join(known, "term", "left_anti").orderBy("term").limit(first + len(committed) + 1)
        words = words.join(known, "term", "left_semi").unionByName(others)
    words = words.withColumn("r", F.lit(True))
    both = known.join(words, "term", "full").where((F.col("term") != token) & ~F.col("term").isin(committed or [""]))
    score = F.when(F.col("h"), base_score(F.col("count"), F.col("last"), now)).otherwise(base_score(F.lit(1), F.lit(0), now)) + min(0.05 * len(token), 0.5)
    return both.select("term", F.lit("prefix").alias("kind"), score.alias("score"), F.coalesce("h", F.lit(False)).alias("from_history"), F.coalesce("r", F.lit(False)).alias("from_registered"))


def cooccurrence_suggestions(events: DataFrame, stats: DataFrame, registered: DataFrame | CompletionIndex, token: str, committed: list[str], now: int) -> DataFrame:
    """Other terms of recent events (rank, terms, t) that hold an anchor, scored by use and the event's rank."""
    anchors = [*dict.fromkeys([*committed, *([token] if token else [])])]
    if not anchors:
        return prefix_suggestions(stats, registered, "\u0000", [], now).where("false")
    extends = lambda t: F.startswith(t, F.lit(token)) & (t != token)
    anchored = F.exists("terms", lambda t: F.startswith(t, F.lit(anchors[0])) if len(anchors) == 1 else _any([F.startswith(t, F.lit(a)) for a in anchors]))
    linked = F.exists("terms", lambda t: _any([t == c for c in committed] + ([extends(t)] if token else []) or [F.lit(False)]))
    rows = events.where(anchored & linked if token else anchored).select("rank", "t", F.explode(F.array_distinct("terms")).alias("term"))
    rows = rows.where(~F.col("term").isin(anchors))
    if token:
        rows = rows.where(~extends(F.col("term")))
    rows = rows.join(stats, "term", "left").join(registered_terms(registered).withColumn("r", F.lit(True)), "term", "left")
    score = base_score(F.coalesce("count", F.lit(1)), F.coalesce("last", "t"), now) + 1.0 / (1.0 + F.col("rank"))
    return rows.groupBy("term").agg(F.lit("cooccur").alias("kind"), F.max(score).alias("score"), F.lit(True).alias("from_history"), F.coalesce(F.bool_or("r"), F.lit(False)).alias("from_registered"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def suggest(events: DataFrame, stats: DataFrame, registered: DataFrame | CompletionIndex, query: str, now: int, n: int = SUGGESTIONS) -> DataFrame:
    """Up to n suggestions for a query being typed; of equal terms the best score, flags united, completion before co-occurrence."""
    token = qt.last_token(query)
    committed = qt.committed_terms(query)
    parts = cooccurrence_suggestions(events, stats, registered, token or "", committed, now)
    if token:
        parts = parts.unionByName(prefix_suggestions(stats, registered, token, committed, now, first=n))
    if token is None:
        parts = parts.where("false")
    merged = parts.groupBy("term").agg(
        F.max_by("kind", F.struct("score", F.col("kind") == "prefix")).alias("kind"), F.max("score").alias("score"), F.bool_or("from_history").alias("from_history"), F.bool_or("from_registered").alias("from_registered")
    )
    return merged.orderBy(F.desc("score"), "term").limit(n)
