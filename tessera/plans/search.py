"""Query plans over a SearchIndex: boolean clauses, BM25, filters, reranking, grouping by file, previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import present
from tessera.functions.analysis import words
from tessera.functions.paths import SCOPE_KEY, normalize_extensions, within_scope
from tessera.operators.index import SearchIndex, bm25, idf
from tessera.plans import query_text as qt

NESTED, OVERLAP = 3, 0.45
#: Keys and scores of a top list that the driver takes at most.
MOST_COLLECTED = 10_000


def _weights(index: SearchIndex, terms: list[str]) -> DataFrame:
    """Postings of some terms with their field's statistics and idf. The filter on term reaches the scan."""
    hit = index.postings.where(F.col("term").isin(terms))
    df = hit.groupBy("field", "term").agg(F.count("*").alias("df"))
    return hit.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(index.stats.select("field", "n_units", "avg_len")), "field")  # a row per query term; a row per field


def term_scores(index: SearchIndex, terms: list[str]) -> DataFrame:
    """key, score: the sum of BM25 over terms and fields."""
    w = _weights(index, terms)
    return w.groupBy(index.key).agg(F.sum(idf(F.col("n_units"), F.col("df")) * bm25(F.col("tf"), F.col("len"), F.col("avg_len"))).alias("score"))


def phrase_matches(index: SearchIndex, tokens: list[str]) -> DataFrame:
    """field, key, tf, len: how often the tokens occur in a row within a field.

    Each occurrence of token i at position p starts a candidate at p - i; starts that all tokens share are occurrences.
    """
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(tokens))))
    hit = index.postings.where(F.col("term").isin(tokens)).select("field", index.key, "term", "positions", "len", wanted.alias("w")).where("term = w.t")
    starts = hit.select("field", index.key, "len", F.col("w.i").alias("i"), F.explode("positions").alias("pos")).withColumn("start", F.col("pos") - F.col("i"))
    whole = starts.groupBy("field", index.key, "start").agg(F.count("*").alias("n"), F.first("len").alias("len")).where(F.col("n") == len(tokens))
    return whole.groupBy("field", index.key).agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def phrase_scores(index: SearchIndex, tokens: list[str]) -> DataFrame:
    """key, score: phrase frequency under BM25 with the summed idf of the members; one token is a plain term."""
    if len(tokens) == 1:
        return term_scores(index, tokens)
    hit = phrase_matches(index, tokens)
    df = index.postings.where(F.col("term").isin(tokens)).groupBy("field", "term").agg(F.count("*").alias("df"))
    times = F.element_at(F.create_map(*(F.lit(x) for t in dict.fromkeys(tokens) for x in (t, tokens.count(t)))), F.col("term"))
    weight = df.join(F.broadcast(index.stats), "field").groupBy("field").agg(F.sum(times * idf(F.col("n_units"), F.col("df"))).alias("weight"), F.first("avg_len").alias("avg_len"))
    scored = hit.join(F.broadcast(weight), "field")  # a row per field
    return scored.groupBy(index.key).agg(F.sum(F.col("weight") * bm25(F.col("tf"), F.col("len"), F.col("avg_len"))).alias("score"))


def retrieve(index: SearchIndex, query: str, pos_filter: bool = True) -> DataFrame | None:
    """key, score of all units that a query matches; null where it has no positive part.

    Terms and passages add to the score and are optional once a phrase is required; required phrases must, excluded terms and
    phrases must not match, in either field.
    """
    parsed = qt.parse(query)
    if not parsed.includes and not parsed.phrases:
        return None
    content = [t for raw in parsed.includes for t in qt.content_tokens(raw, index.analyzer, pos_filter)]
    should = [term_scores(index, content)] if content else []
    for raw in parsed.includes:
        tokens = qt.passage_tokens(raw, index.analyzer)
        if len(raw) >= 4 and len(tokens) >= 2:
            should.append(phrase_scores(index, tokens))
    must = [phrase_scores(index, t) for t in (qt.phrase_tokens(p, index.analyzer) for p in parsed.phrases) if t]
    if not should and not must:
        return None
    found = reduce(DataFrame.union, [*should, *must]).groupBy(index.key).agg(F.sum("score").alias("score"))
    for m in must:
        found = found.join(m.select(index.key), index.key, "left_semi")
    gone = [t for raw in parsed.excludes for t in qt.content_tokens(raw, index.analyzer, pos_filter)]
    if gone:
        found = found.join(index.postings.where(F.col("term").isin(gone)).select(index.key), index.key, "left_anti")
    for phrase in parsed.exclude_phrases:
        tokens = qt.phrase_tokens(phrase, index.analyzer)
        if tokens:
            hit = phrase_matches(index, tokens) if len(tokens) > 1 else index.postings.where(F.col("term") == tokens[0])
            found = found.join(hit.select(index.key), index.key, "left_anti")
    return found


def _fetch(n: int, path: str | None, narrowed: bool) -> int:
    """How many raw hits are reranked."""
    low, high, times = (50, 80, 1) if path else (80, 400, 5) if narrowed else (40, 200, 2)
    return min(high, max(low, times * n))


def search_units(index: SearchIndex, query: str, limit: int, *, path: str | None = None, scope: str | None = None, exts: list[str] | None = None, pos_filter: bool = True, fetch: int | None = None, other_case: bool = False) -> DataFrame | None:
    """The best units with proximity: key, path, title, body, score, overlap, snippet, marks.

    A scope, a path and extensions apply first; then raw hits are cut to a bounded top list before bodies are joined, and the rerank runs on that list only. A scope
    without a hit is searched loosely only where the corpus has none either. With `other_case` a path stands for all that differ
    from it by case, and each of them has its own list.
    """
    parsed = qt.parse(query)
    kinds = normalize_extensions(exts or [])
    tokens = qt.proximity_tokens(parsed, index.analyzer, pos_filter)
    loose = False

    def best(filtered: bool, inside: str | None = scope) -> DataFrame | None:
        found = retrieve(index, query, filtered)
        if found is None:
            return None
        units = index.units
        if path:
            units = units.where(F.lower("path") == path.lower() if other_case else F.col("path") == path)
        if kinds:
            units = units.where(F.col("ext").isin(kinds))
        if inside:
            units = within_scope(units, inside)
        if path or kinds or inside:
            found = found.join(units.select(index.key), index.key, "left_semi")
        rows = fetch or _fetch(limit, path, bool(scope or kinds))
        if path and other_case:
            rows *= 2
        return found.orderBy(F.desc("score"), index.key).limit(rows)

    def run(top: DataFrame) -> DataFrame:
        """The top list as it is now: retrieved once, a bounded list of keys and scores. A longer list, which a caller asked for, is only looked into."""
        return top if (fetch or 0) > MOST_COLLECTED else index.units.sparkSession.createDataFrame(top.collect(), top.schema)

    top = best(pos_filter)
    if top is None:
        return None
    if pos_filter and tokens:
        top = run(top)
        if top.isEmpty() and (not scope or best(pos_filter, None).isEmpty()):
            top, loose = best(False), True
            tokens = qt.proximity_tokens(parsed, index.analyzer, False)
    # at most 400 rows by _fetch; a caller's own limit may be larger
    hits = index.units.drop(SCOPE_KEY).join(top if (fetch or 0) > MOST_COLLECTED else F.broadcast(top), index.key)
    whole = F.concat_ws(" ", "title", "body")
    for phrase in parsed.exclude_phrases:
        hits = hits.where(~F.contains(whole, F.lit(phrase)))
    near = hits.withColumn("near", present.proximity_column(F.lower(whole) if index.analyzer == "unicode_word" else whole, [t.lower() for t in tokens]))
    near = near.where(F.col("near.overlap") >= qt.least_overlap(parsed, tokens, pos_filter, loose))
    marks = qt.highlight_terms(parsed, index.analyzer, pos_filter)
    scored = near.withColumn("score", F.col("near.overlap") * 10 * F.col("near.compactness") + F.col("score")).withColumn("overlap", F.col("near.overlap")).drop("near")
    return scored.withColumn("snippet", present.snippet_column(F.col("body"), query, marks)).withColumn("marks", present.marks_in(F.lower(whole), [m.lower() for m in marks]))


def drop_near_copies(hits: DataFrame, key: str = "unit_key") -> DataFrame:
    """Per path, best score first, units that nearly repeat a kept one go: by body overlap, or equal label and snippet.

    For a bounded top list, whose groups hold at most the fetched hits; near_copies.drop_near_copies_at_scale() keeps the same units of any number.
    """
    import pandas as pd

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        rows = rows.sort_values(["score", key], ascending=[False, True]).reset_index(drop=True)
        flat = ["".join(s.split()).lower() for s in rows["snippet"]]
        for i, row in rows.iterrows():
            label = (row.get("label") or "").strip()
            same = (present.overlap(row["body"], rows.at[j, "body"]) >= OVERLAP or (label and flat[i] and label == (rows.at[j, "label"] or "").strip() and flat[i] == flat[j]) for j in kept)
            if not any(same):
                kept.append(i)
        return rows.loc[kept]

    return hits.groupBy("path").applyInPandas(greedy, hits.schema)


def group_by_file(hits: DataFrame, k: int | None, key: str = "unit_key", nested: int = NESTED) -> DataFrame:
    """One row per path in order of its best unit: that unit, match_count, and its `nested` best paragraphs. Without `k` all, in no order."""
    by = Window.partitionBy("path").orderBy(F.desc("score"), key)
    ranked = hits.withColumn("nth", F.row_number().over(by)).withColumn("match_count", F.count("*").over(Window.partitionBy("path")))
    label = F.coalesce(F.nullif("label", F.lit("")), F.substring("snippet", 1, 36)) if "label" in hits.columns else F.substring("snippet", 1, 36)
    paragraph = F.struct("nth", F.col(key).alias("id"), label.alias("label"), "snippet", "score")
    best = ranked.groupBy("path").agg(
        F.sort_array(F.collect_list(F.when(F.col("nth") <= nested, paragraph))).alias("paragraphs"), F.max("match_count").alias("match_count"), F.max("score").alias("score")
    )
    return best if k is None else best.orderBy(F.desc("score"), "path").limit(k)


def search_files(index: SearchIndex, query: str, k: int = 10, **options) -> DataFrame | None:
    """Ranked files for a query, each with up to three paragraphs."""
    hits = search_units(index, query, max(8 * k, 40), **options)
    return None if hits is None else group_by_file(drop_near_copies(hits, index.key), k, index.key)


def path_matches(index: SearchIndex, query: str, path: str, limit: int = 50, order: str | None = None) -> DataFrame | None:
    """Units of one file that match, in document order; those of the exact path, else, where it has none, of paths that differ by case.

    Document order is that of the column `order`, or of a key `...#n` by n, or of the key. Both paths are asked in one plan; exact ones are preferred by a window over its at most 160 rows.
    """
    found = search_units(index, query, limit, path=path, other_case=True)
    if found is None:
        return None
    exact = F.col("path") == path
    found = found.withColumn("_any", F.max(exact.cast("int")).over(Window.partitionBy(F.lower("path")))).where(exact | (F.col("_any") == 0)).drop("_any")
    place = [F.col(order)] if order else [F.regexp_extract(F.col(index.key).cast("string"), r"#(\d+)\z", 1).try_cast("long").asc_nulls_first(), F.col(index.key)]
    return drop_near_copies(found, index.key).orderBy(*place).limit(limit)


def preview(index: SearchIndex, unit: object) -> DataFrame:
    """The stored row of one unit."""
    return index.units.drop(SCOPE_KEY).where(F.col(index.key) == unit).limit(1)


#: Words of a passage by which it is looked up.
ANCHOR = 5


def passages_in_texts(passages: DataFrame, texts: DataFrame, passage_id: str, passage_col: str, text_id: str, text_col: str) -> DataFrame:
    """passage_id, text_id: which passages' terms occur in a row in which texts. Passages without a term are found nowhere, null texts hold none.

    A passage is looked up by the hash of its first min(ANCHOR, n) terms; a text offers a hash for every run of as many terms as some passage's anchor has. Texts are
    analysed once: those with a hit carry the whole text along to be verified. Repeated rows give one pair.
    """
    whole = lambda ws: F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    p = passages.select(F.col(passage_id).alias("p"), words(F.col(passage_col)).alias("ws")).where(F.size("ws") > 0)
    p = p.withColumn("k", F.least(F.size("ws"), F.lit(ANCHOR)))
    p = p.select("p", "k", F.xxhash64("k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ")).alias("h"), whole(F.col("ws")).alias("passage")).distinct()
    lengths = [r[0] for r in p.select("k").distinct().collect()]  # at most ANCHOR numbers
    ws = F.col("ws")

    def runs_of(k: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(ws) - k + 1), lambda i: F.xxhash64(F.lit(k), F.array_join(F.slice(ws, i, F.lit(k)), " ")))
        return F.when(F.size(ws) >= k, each).otherwise(F.array().cast("array<bigint>"))

    runs = F.concat(F.array().cast("array<bigint>"), *map(runs_of, sorted(lengths)))
    t = texts.where(F.col(text_col).isNotNull()).select(F.col(text_id).alias("t"), words(F.col(text_col)).alias("ws"))
    hashes = t.select("t", F.explode(F.array_distinct(runs)).alias("h"))
    found = hashes.join(p.select("p", "h"), "h").select("t", "p").distinct()
    bodies = t.select("t", whole(ws).alias("body"))
    held = found.join(bodies, "t").join(p.select("p", "passage"), "p").where(F.contains("body", F.col("passage")))
    return held.select(F.col("p").alias(passage_id), F.col("t").alias(text_id)).distinct()
