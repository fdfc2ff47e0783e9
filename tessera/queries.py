"""Registered queries over the driver's tables, with their SQL.

Stand-ins: documents are text files (path source/lang/doc_id.txt), pages HTML files, conversations mail threads (turn is the date order),
benchmark passages that a user selects, events uses of search terms, part names registered words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import analysis, html, paths, present, segment
from tessera.operators import catalog, federation, history, incremental
from tessera.operators.completion import CompletionIndex
from tessera.operators.index import SearchIndex, field_lengths, field_stats, term_counts, term_stats
from tessera.operators.near_copies import drop_near_copies_at_scale, near_unit_pairs
from tessera.operators.scratch import listing, shared_folder
from tessera.plans import search
from tessera.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WORD = r"'[\p{L}\p{N}]+'"
#: White space in DuckDB's patterns; the same characters as html.SPACE. Fixed value.
WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LWS = WS.replace(r"\n", "")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: doc_id, path, title, body, ext, folder, lang, doc_kind."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select("doc_id", path.alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("title"), F.coalesce("text", F.lit("")).alias("body"), F.lit("txt").alias("ext"), F.col("source").alias("folder"), "lang", F.lit("file").alias("doc_kind"))


#: Folders of stored indexes by application, input and the listing of its files.
_STORED: dict[tuple[str, str], tuple[tuple, str]] = {}


def doc_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The documents' index: built and stored by the first query of an application, read by the others, and built anew once the input's files are others."""
    at, files = (spark.sparkContext.applicationId, sf_dir), listing(spark, f"{sf_dir}/documents.parquet")
    if at not in _STORED or _STORED[at][0] != files:
        path = shared_folder(spark, "index")
        SearchIndex.build(doc_files(spark, sf_dir), key="doc_id").save(path)
        _STORED[at] = (files, path)
    return SearchIndex.load(spark, _STORED[at][1], "doc_id")


def rounded(df: DataFrame | None, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


#: Tokens and statistics of both fields in SQL.
INDEX_SQL = rf"""
u AS (SELECT doc_id, source || '/' || lang || '/' || doc_id::VARCHAR || '.txt' AS path, doc_id::VARCHAR || '.txt' AS title, coalesce(text, '') AS body, source AS folder FROM documents),
w AS (SELECT 'title' AS field, doc_id, regexp_extract_all(lower(title), {WORD}) AS ws FROM u UNION ALL SELECT 'body', doc_id, regexp_extract_all(lower(body), {WORD}) FROM u),
t AS (SELECT field, doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM w),
ln AS (SELECT field, doc_id, len(ws) AS len FROM w),
st AS (SELECT field, count(*) AS n, avg(len) AS avg_len FROM ln GROUP BY 1),
p AS (SELECT field, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL)"""
BM25_SQL = "ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)))"


def terms_sql(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"SELECT doc_id, {BM25_SQL} AS s FROM p JOIN df USING (field, term) JOIN st USING (field) JOIN ln USING (field, doc_id) WHERE term IN ({listed})"


def phrase_sql(tokens: list[str]) -> str:
    starts = " UNION ALL ".join(f"SELECT field, doc_id, pos - {i} AS start, {i} AS i FROM t WHERE term = '{x}'" for i, x in enumerate(tokens))
    weight = " UNION ALL ".join(f"SELECT field, ln(1 + (n - df + 0.5) / (df + 0.5)) AS x FROM df JOIN st USING (field) WHERE term = '{x}'" for x in tokens)
    hit = f"SELECT field, doc_id, count(*) AS tf FROM (SELECT field, doc_id, start FROM ({starts}) GROUP BY ALL HAVING count(*) = {len(tokens)}) GROUP BY ALL"
    return f"SELECT doc_id, weight * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS s FROM ({hit}) JOIN (SELECT field, sum(x) AS weight FROM ({weight}) GROUP BY 1) USING (field) JOIN st USING (field) JOIN ln USING (field, doc_id)"


def retrieval_sql(should: list[str], must: list[str] = (), gone: list[str] = (), limit: int = 20) -> str:
    parts = " UNION ALL ".join(f"({x})" for x in [*should, *must])
    keep = "".join(f" AND doc_id IN (SELECT doc_id FROM ({x}))" for x in must) + "".join(f" AND doc_id NOT IN (SELECT doc_id FROM ({x}))" for x in gone)
    return f"WITH {INDEX_SQL} SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, sum(s) AS score FROM ({parts}) WHERE true{keep} GROUP BY 1) ORDER BY score DESC, doc_id LIMIT {limit}"


def retrieved(spark: SparkSession, sf_dir: str, text: str, limit: int = 20, pos_filter: bool = True) -> DataFrame:
    found = search.retrieve(doc_index(spark, sf_dir), text, pos_filter)
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(limit)


# --- analysis and index -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), {WORD}) AS ws FROM documents WHERE text IS NOT NULL)")
def tokenize_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(analysis.words(F.col("text"))).alias("pos", "term")).select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


@query(f"WITH {INDEX_SQL} SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY ALL")
def term_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_stats(term_counts(doc_files(spark, sf_dir), "doc_id"))


@query(f"WITH {INDEX_SQL} SELECT field, count(*) AS n_units, sum(len)::BIGINT AS total_len, round(avg(len), 6) AS avg_len FROM ln GROUP BY 1")
def field_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(field_stats(field_lengths(doc_files(spark, sf_dir), "doc_id")), "avg_len")


# --- retrieval ----------------------------------------------------------------------------------------------------------------


@query(retrieval_sql([terms_sql(["thion", "hean"])]))
def term_or_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir, "thion hean")


@query(retrieval_sql([], [phrase_sql(["of", "the"])]))
def must_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir, '"of the"')


@query(retrieval_sql([terms_sql(["thion", "hean"])], gone=[terms_sql(["for"])]))
def must_not_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir, "thion hean -for")


@query(retrieval_sql([terms_sql(["hean", "thion"])], [phrase_sql(["in", "the"])], [terms_sql(["with"]), phrase_sql(["to", "of"])]))
def multi_clause_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir, 'hean,thion "in the" -with -"to of"')


@query(retrieval_sql([terms_sql(["the", "was", "that"]), phrase_sql(["the", "was", "that"])]))
def passage_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir, "the.was.that")


@query(
    f"WITH {INDEX_SQL}, a AS (SELECT DISTINCT doc_id FROM p WHERE term = 'hean'), b AS (SELECT doc_id FROM a WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'the'))"
    " SELECT 'hean' AS query, (SELECT count(*) FROM a) AS n UNION ALL SELECT 'hean -the', (SELECT count(*) FROM b) UNION ALL SELECT '-the', 0"
)
def exclude_only_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents a term finds, how many with an exclusion, and that an exclusion alone finds none."""
    index = doc_index(spark, sf_dir)
    nothing = index.units.where("false").select("doc_id")
    found = {q: search.retrieve(index, q) for q in ("hean", "hean -the", "-the")}
    rows = [(nothing if f is None else f).agg(F.count("doc_id").alias("n")).select(F.lit(q).alias("query"), "n") for q, f in found.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query(
    f"WITH {INDEX_SQL} SELECT doc_id, path FROM u WHERE doc_id IN (SELECT doc_id FROM p WHERE term = 'hean') AND NOT contains(title || ' ' || body, 'of the') AND doc_id NOT IN (SELECT doc_id FROM ({phrase_sql(['of', 'the'])}))"
)
def exclude_phrase_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = doc_index(spark, sf_dir)
    hits = index.units.join(search.retrieve(index, 'hean -"of the"'), "doc_id", "left_semi")
    return hits.where(~F.contains(F.concat_ws(" ", "title", "body"), F.lit("of the"))).select("doc_id", "path")


@query(
    rf"""
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), {WORD}), ' ') || ' ' AS b FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), {WORD}), ' ') || ' ' AS b, len(regexp_extract_all(lower(text), {WORD})) AS n FROM benchmark)
SELECT item_id, doc_id FROM q JOIN d ON contains(d.b, q.b) WHERE n >= 1"""
)
def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage's terms in a row, for all passages that have a term."""
    passages, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return search.passages_in_texts(passages, docs, "item_id", "text", "doc_id", "text")


@query(f"WITH {INDEX_SQL}, hit AS ({terms_sql(['the'])}), x AS (SELECT doc_id, sum(s) AS score FROM hit GROUP BY 1) SELECT doc_id, round(score, 6) AS score, true AS loose FROM x ORDER BY score DESC, doc_id LIMIT 20")
def loose_fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict query finds nothing, so the loose one answers: one plan, the loose branch behind an anti join on the strict one."""
    index = doc_index(spark, sf_dir)
    strict = search.retrieve(index, "qqqzzz").withColumn("loose", F.lit(False))
    loose = search.retrieve(index, "the", False).withColumn("loose", F.lit(True))
    any_strict = strict.limit(1).select(F.lit(1).alias("one"))
    both = strict.unionByName(loose.withColumn("one", F.lit(1)).join(any_strict, "one", "left_anti").drop("one"))
    return both.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(20)


# --- filters and paths --------------------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$')), '^.+\\.([^.]+)$', 1) AS ext FROM pages")
def path_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", paths.extension(F.regexp_replace("url", r"[?#].*$", "")).alias("ext"))


@query("SELECT page_id FROM pages WHERE regexp_extract(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$')), '^.+\\.([^.]+)$', 1) IN ('html', 'htm')")
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = paths.normalize_extensions([".HTML", "htm", " "])
    return path_extension(spark, sf_dir).where(F.col("ext").isin(kinds)).select("page_id")


@query("SELECT doc_id FROM documents WHERE lower(source || '/' || lang || '/') LIKE 'src1/en/%'")
def path_prefix_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_files(spark, sf_dir).where(paths.in_scope(F.col("path"), "SRC1/en")).select("doc_id")


@query("SELECT page_id, rtrim(replace(regexp_replace(url, '^https?:', ''), '/', chr(92)), chr(92)) AS path FROM pages")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.normalize_path(F.regexp_replace("url", "^https?:", "")).alias("path"))


@query(r"SELECT doc_id, '\\share\' || source || '\' || lang || '\' || doc_id::VARCHAR || '.txt' AS public_path FROM documents")
def rewrite_public_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = paths.normalize_path(F.concat(F.lit("C:/data/"), "path"))
    return doc_files(spark, sf_dir).select("doc_id", paths.rewrite_prefix(local, F.lit(r"c:\DATA"), F.lit("\\\\share")).alias("public_path"))


@query("SELECT conv_id, turn, 'store' AS store, conv_id::VARCHAR || '/' || turn::VARCHAR AS entry FROM conversations")
def mail_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    made = paths.mail_path(F.lit("store"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return c.select("conv_id", "turn", paths.parse_mail_path(made).alias("p")).select("conv_id", "turn", "p.*")


@query(
    """
WITH f AS (SELECT source AS root, source || '/' || lang AS sub FROM documents), a AS (SELECT root AS path FROM f UNION ALL SELECT sub FROM f),
g AS (SELECT lower(path) AS low, min(path) AS path, count(*) AS n_files FROM a GROUP BY 1)
SELECT split_part(path, '/', 1) AS root, path, n_files FROM g QUALIFY row_number() OVER (PARTITION BY lower(split_part(path, '/', 1)) ORDER BY low) <= 400"""
)
def parent_dirs_scope_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.scope_tree(doc_files(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE source NOT IN (SELECT 'src' || p_size FROM part WHERE p_type = 'SMALL') AND source || '/' || lang <> 'src0/en'")
def exclude_prefix_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = table(spark, sf_dir, "part").where("p_type = 'SMALL'").select(F.concat(F.lit("SRC"), "p_size").alias("path")).union(spark.range(1).select(F.lit("src0/EN")))
    return incremental.without_excluded(doc_files(spark, sf_dir), excluded).select("doc_id")


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN source || '/de' WHEN source IN ('src1', 'src2') THEN source END AS folder FROM documents")
def first_owner_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = doc_files(spark, sf_dir)
    german = files.where("lang = 'de'").select(F.concat_ws("/", "folder", "lang").alias("path")).distinct().withColumn("order", F.lit(0))
    roots = files.where("folder in ('src1', 'src2')").select(F.col("folder").alias("path")).distinct().withColumn("order", F.lit(1))
    return files.select("doc_id", "path").join(incremental.owners(files, german.union(roots)), "path").select("doc_id", "folder")


# --- HTML and segmentation ----------------------------------------------------------------------------------------------------

NOISE_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script[>/\s].*?(</script\s*>|\z)', '', 'gsi'), '<style[>/\s].*?(</style\s*>|\z)', '', 'gsi'), '<noscript[>/\s].*?(</noscript\s*>|\z)', '', 'gsi')"


def entities_sql(text: str) -> str:
    """References decoded by one pass of its own: pieces between references, each with the reference that follows it."""
    pattern = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);"
    names = ", ".join(f"'&{name};': '{char.replace(chr(39), chr(39) * 2)}'" for name, char in html.ENTITIES.items())
    decoded = f"CASE WHEN z[2] LIKE '&#x%' OR z[2] LIKE '&#X%' THEN chr(('0x' || z[2][4:-2])::INT) WHEN z[2] LIKE '&#%' THEN chr(z[2][3:-2]::INT) ELSE coalesce(MAP {{{names}}}[z[2]], z[2]) END"
    zipped = f"list_zip(string_split_regex(t, '{pattern}'), list_append(regexp_extract_all(t, '{pattern}'), ''))"
    return f"list_transform([{text}], lambda t: array_to_string(list_transform({zipped}, lambda z: z[1] || {decoded}), ''))[1]"


def collapse_sql(text: str) -> str:
    t = f"regexp_replace(replace({text}, chr(13), ''), '[{LWS}]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, ' ?\\n ?', chr(10), 'g'), '\\n\\n+', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^[ \\n]+|[ \\n]+$', '', 'g')"


BLOCK_SQL = "|".join(html.BLOCKS)
TEXT_SQL = collapse_sql(
    entities_sql(rf"regexp_replace(regexp_replace(regexp_replace({NOISE_SQL}, '</?(?:{BLOCK_SQL})(?:[^A-Za-z0-9>][^>]*)?(?:>|\z)', chr(10) || chr(10), 'gi'), '</?(?:br|hr)(?:[^A-Za-z0-9>][^>]*)?(?:>|\z)', chr(10), 'gi'), '<[^>]*(?:>|\z)', '', 'g')")
)


@query(f"SELECT page_id, {NOISE_SQL} AS html FROM pages")
def html_noise_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.remove_noise(F.col("html")).alias("html"))


@query(f"SELECT page_id, nullif({collapse_sql(entities_sql(rf'''regexp_extract({NOISE_SQL}, '<title[^>]*>(.*?)</title', 1, 'si')'''))}, '') AS title FROM pages")
def html_page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.html_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {TEXT_SQL} AS text FROM pages")
def html_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.html_text(F.col("html")).alias("text"))


@query(rf"SELECT page_id, generate_subscripts(ps, 1) - 1 AS nth, unnest(ps) AS paragraph FROM (SELECT page_id, list_filter(list_transform(string_split_regex({TEXT_SQL}, '\n\s*\n'), lambda p: regexp_replace(p, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda p: p <> '') AS ps FROM pages)")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.paragraphs(html.html_text(F.col("html")))).alias("nth", "paragraph"))
    return p.withColumn("nth", F.col("nth").cast("long"))


TRIM_SQL = f"'^[{WS}]+|[{WS}]+$', '', 'g'"
BLOCKS_SQL = rf"list_filter(list_transform(string_split_regex(regexp_replace(text, '[{LWS}]+(\n|\z)', '\1', 'g'), '\n\n+'), lambda b: regexp_replace(b, {TRIM_SQL})), lambda b: b <> '')"


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_page_text(spark, sf_dir).select(F.col("page_id").cast("string").alias("path"), F.array("text").alias("pages"), "page_id", "text")


@query(f"SELECT page_id, generate_subscripts(bs, 1) - 1 AS nth, unnest(bs) AS block FROM (SELECT page_id, {BLOCKS_SQL} AS bs FROM (SELECT page_id, {TEXT_SQL} AS text FROM pages))")
def segment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = page_texts(spark, sf_dir).select("page_id", F.posexplode(segment.blank_line_blocks(F.col("text"))).alias("nth", "block"))
    return b.withColumn("nth", F.col("nth").cast("long"))


MERGE_SQL = f"""SELECT page_id, list_reduce(list_transform(bs, lambda b: [b]), lambda a, b:
  CASE WHEN length(a[-1]) < 40 OR length(b[1]) < 40 THEN list_concat(a[:-2], [a[-1] || chr(10) || chr(10) || b[1]]) ELSE list_concat(a, b) END) AS us
  FROM (SELECT page_id, {BLOCKS_SQL} AS bs FROM (SELECT page_id, {TEXT_SQL} AS text FROM pages)) WHERE len(bs) > 0"""


@query(f"SELECT page_id, generate_subscripts(us, 1) - 1 AS nth, unnest(us) AS block FROM ({MERGE_SQL})")
def merged_short_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.transform(segment.blank_line_blocks(F.col("text")), lambda b: F.struct(b.alias("text"), F.lit(1).alias("page")))
    b = page_texts(spark, sf_dir).select("page_id", F.posexplode(segment.merge_short_blocks(blocks)).alias("nth", "b"))
    return b.select("page_id", F.col("nth").cast("long").alias("nth"), F.col("b.text").alias("block"))


LABEL_SQL = rf"regexp_replace(regexp_replace(regexp_replace(b, '[\n\r]', '', 'g'), '[{WS}]+', ' ', 'g'), {TRIM_SQL})"
UNITS_SQL = f"""
WITH m AS ({MERGE_SQL}), x AS (SELECT page_id, generate_subscripts(us, 1) AS nth, unnest(us) AS b FROM m),
y AS (SELECT page_id, nth, b, CASE WHEN length(b) <= 1000 THEN [b] ELSE list_transform(range(0, greatest(ceil((length(b) - 1000) / 984.0)::BIGINT, 0) + 1), lambda i: b[i * 984 + 1:i * 984 + 1000]) END AS ps FROM x),
z AS (SELECT page_id, b, coalesce(sum(len(ps)) OVER (PARTITION BY page_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, ps FROM y),
q AS (SELECT page_id, b, (base + generate_subscripts(ps, 1) - 1)::BIGINT AS unit_id, unnest(ps) AS text FROM z)
"""


@query(f"{UNITS_SQL} SELECT page_id, unit_id, text, CASE WHEN length(b) > 1000 THEN 'chunk' ELSE 'paragraph' END AS kind FROM q")
def split_long_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = segment.segment_pages(page_texts(spark, sf_dir), keep=("page_id",))
    return u.select("page_id", F.col("unit_id").cast("long").alias("unit_id"), "text", "kind")


@query(f"{UNITS_SQL} SELECT page_id, unit_id, CASE WHEN length({LABEL_SQL}) > 36 THEN {LABEL_SQL}[:36] || '…' ELSE {LABEL_SQL} END AS label FROM q")
def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = segment.segment_pages(page_texts(spark, sf_dir), keep=("page_id",))
    return u.select("page_id", F.col("unit_id").cast("long").alias("unit_id"), "label")


# --- ranking and presentation -------------------------------------------------------------------------------------------------

_NEAR = ["thion", "hean"]
NEAR_SQL = r"""
WITH d AS (SELECT doc_id, lower(text) AS b FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, 0 AS tok, string_split(b, 'thion') AS ps FROM d UNION ALL SELECT doc_id, 1, string_split(b, 'hean') FROM d),
len AS (SELECT doc_id, tok, list_transform(ps, lambda x: length(x)) AS ls, CASE tok WHEN 0 THEN 5 ELSE 4 END AS n FROM cut WHERE len(ps) > 1),
h AS (SELECT doc_id, tok, n, unnest(list_transform(range(1, len(ls)), lambda i: list_sum(ls[:i])::BIGINT + (i - 1) * n)) AS at FROM len),
g AS (SELECT doc_id, count(DISTINCT tok) AS overlap, sum(DISTINCT n) AS ideal, min(n) AS one FROM h GROUP BY 1),
s AS (SELECT a.doc_id, min(greatest(a.at + a.n, b.at + b.n) - least(a.at, b.at)) AS span FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.tok = 0 AND b.tok = 1 GROUP BY 1),
f AS (SELECT doc_id, overlap, coalesce(span, one) AS span, least(1.0, greatest(0.05, ideal::DOUBLE / coalesce(span, one))) AS compactness FROM g LEFT JOIN s USING (doc_id))
"""


@query(f"{NEAR_SQL} SELECT doc_id, overlap, span, round(compactness, 6) AS compactness FROM f")
def proximity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", present.proximity_column(F.lower("text"), _NEAR).alias("n")).where("n.overlap > 0")
    return d.select("doc_id", F.col("n.overlap").cast("long").alias("overlap"), F.col("n.span").cast("long").alias("span"), F.round("n.compactness", 6).alias("compactness"))


@query(
    f"WITH {INDEX_SQL}, top AS (SELECT doc_id, sum(s) AS score FROM ({terms_sql(_NEAR)}) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 40), {NEAR_SQL.strip().removeprefix('WITH ')}"
    " SELECT doc_id, round(overlap * 10 * compactness + score, 6) AS score FROM top JOIN f USING (doc_id)"
)
def combined_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.search_units(doc_index(spark, sf_dir), "thion hean", 20)
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"WITH {INDEX_SQL}, top AS (SELECT doc_id, sum(s) AS score FROM ({terms_sql(_NEAR)}) JOIN u USING (doc_id) WHERE lower(path) LIKE 'src1/en/%' GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 100), {NEAR_SQL.strip().removeprefix('WITH ')}"
    " SELECT doc_id, round(overlap * 10 * compactness + score, 6) AS score FROM top JOIN f USING (doc_id)"
)
def scoped_combined_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of one folder: its range of stored keys is read, and the top list is cut within it."""
    hits = search.search_units(doc_index(spark, sf_dir), "thion hean", 20, scope="SRC1/en/")
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, lower(source || chr(92) || lang || chr(92) || doc_id::VARCHAR || '.txt') AS scope_key FROM documents WHERE lower(source || '/' || lang || '/') LIKE 'src1/%'")
def stored_scope_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored units of a folder and the folders below it."""
    return paths.within_scope(doc_index(spark, sf_dir).units, "src1").select("doc_id", F.col(paths.SCOPE_KEY).alias("scope_key"))


#: No text holds it whole; its longest parts differ from text to text.
_PARTS = "Hean thionx of theer"


@query(
    rf"""
WITH p AS (SELECT n, i, substr('{_PARTS.lower()}', i::INT, n::INT) AS part FROM range(2, {len(_PARTS) + 1}) t(n), range(1, {len(_PARTS)}) v(i) WHERE i + n <= {len(_PARTS) + 1}),
d AS (SELECT doc_id, text AS b, lower(text) AS l FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, arg_max(part, n * 1000 - i) AS part FROM d, p WHERE contains(l, part) GROUP BY 1),
a AS (SELECT doc_id, b, CASE WHEN part IS NULL THEN 0 ELSE strpos(l, part) END AS k, coalesce(length(part), 0) AS n FROM d LEFT JOIN m USING (doc_id)),
c AS (SELECT doc_id, b, CASE WHEN k > 0 THEN greatest(k - 1 - 33, 0) ELSE 0 END AS s, least(CASE WHEN k > 0 THEN k - 1 + n + 66 ELSE 100 END, length(b)) AS e FROM a)
SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || substr(b, s + 1, e - s) || CASE WHEN e < length(b) THEN '…' ELSE '' END AS snippet FROM c"""
)
def snippet_longest_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippets that a search shows, around the longest part of the query that a text holds."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", present.snippet_column(F.col("text"), _PARTS, []).alias("snippet"))


@query(
    r"""
WITH d AS (SELECT doc_id, text AS b, strpos(lower(text), 'thion') AS p1, strpos(lower(text), 'hean') AS p2 FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, b, CASE WHEN p1 > 0 THEN p1 ELSE p2 END AS k, CASE WHEN p1 > 0 THEN 5 WHEN p2 > 0 THEN 4 ELSE 0 END AS n FROM d),
c AS (SELECT doc_id, b, CASE WHEN k > 0 THEN greatest(k - 1 - 33, 0) ELSE 0 END AS s, least(CASE WHEN k > 0 THEN k - 1 + n + 66 ELSE 100 END, length(b)) AS e FROM a)
SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || substr(b, s + 1, e - s) || CASE WHEN e < length(b) THEN '…' ELSE '' END AS snippet FROM c"""
)
def snippet_first_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", present.anchored_snippet(F.col("text"), _NEAR).alias("snippet"))


@query("SELECT doc_id, array_to_string(list_filter(['thion', 'hean', 'the'], lambda m: contains(text, m)), ',') AS marks, regexp_replace(text, '(thion|hean|the)', '<mark>\\1</mark>', 'gi') AS marked FROM documents WHERE text IS NOT NULL")
def hit_highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = ["the", "hean", "thion"]
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.array_join(present.marks_in(F.col("text"), marks), ",").alias("marks"), present.highlight(F.col("text"), marks).alias("marked"))


def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units of pages with a score: how often `th` occurs for their length."""
    u = segment.segment_pages(page_texts(spark, sf_dir), keep=("page_id",))
    score = F.round(F.regexp_count(F.lower("text"), F.lit("th")) / F.length("text"), 9)
    return u.select(F.col("page_id").cast("string").alias("path"), F.col("unit_id").cast("long").alias("unit_key"), F.col("text").alias("body"), F.col("label"), F.substring("text", 1, 60).alias("snippet"), score.alias("score"))


RANKED_SQL = f"{UNITS_SQL}, r AS (SELECT page_id::VARCHAR AS path, unit_id AS unit_key, text AS body, round(len(regexp_extract_all(lower(text), 'th')) / length(text), 9) AS score FROM q), best AS (SELECT * FROM r)"
NORM_SQL = f"lower(regexp_replace(body, '[{WS}]+', '', 'g'))"
DICE_SQL = f"""{RANKED_SQL}, n AS (SELECT path, unit_key, {NORM_SQL} AS s FROM best),
g AS (SELECT path, unit_key, s, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: s[i:i + 2])) AS t FROM n),
o AS (SELECT a.path, a.unit_key AS a, b.unit_key AS b, CASE WHEN length(a.s) = 0 OR length(b.s) = 0 THEN 0.0 WHEN a.s = b.s THEN 1.0
  WHEN contains(a.s, b.s) OR contains(b.s, a.s) THEN least(length(a.s), length(b.s)) / greatest(length(a.s), length(b.s))::DOUBLE
  ELSE 2.0 * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)) END AS overlap FROM g a JOIN g b ON a.path = b.path AND a.unit_key < b.unit_key)
"""


@query(f"{DICE_SQL} SELECT path, a, b, round(overlap, 6) AS overlap FROM o WHERE overlap >= 0.45")
def trigram_dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of units within a page."""
    return near_unit_pairs(ranked_pages(spark, sf_dir)).withColumn("overlap", F.round("overlap", 6))


#: Units of a page in order; each is kept if none of those kept before it is near: a recursion over the list of those kept.
GREEDY_SQL = f"""{DICE_SQL.replace("WITH m AS", "WITH RECURSIVE m AS", 1)}, lab AS (SELECT page_id::VARCHAR AS path, unit_id AS unit_key, CASE WHEN length({LABEL_SQL}) > 36 THEN {LABEL_SQL}[:36] || '…' ELSE {LABEL_SQL} END AS label FROM q),
one AS (SELECT path, unit_key, score, trim(label) AS label, lower(regexp_replace(body[:60], '\\s+', '', 'g')) AS flat, row_number() OVER (PARTITION BY path ORDER BY score DESC, unit_key) AS nth FROM best JOIN lab USING (path, unit_key)),
near AS (SELECT path, a AS x, b AS y FROM o WHERE overlap >= 0.45 UNION SELECT path, b, a FROM o WHERE overlap >= 0.45
  UNION SELECT l.path, l.unit_key, r.unit_key FROM one l JOIN one r ON l.path = r.path AND l.label = r.label AND l.flat = r.flat AND l.label <> '' AND l.flat <> '' AND l.unit_key <> r.unit_key),
told AS (SELECT one.path, one.unit_key, any_value(one.nth) AS nth, list(y) FILTER (y IS NOT NULL) AS ys FROM one LEFT JOIN near ON one.path = near.path AND one.unit_key = near.x GROUP BY 1, 2),
walk AS (SELECT path, nth, [unit_key] AS kept FROM told WHERE nth = 1
  UNION ALL SELECT w.path, w.nth + 1, CASE WHEN list_has_any(w.kept, coalesce(t.ys, [])) THEN w.kept ELSE list_append(w.kept, t.unit_key) END FROM walk w JOIN told t ON t.path = w.path AND t.nth = w.nth + 1),
fin AS (SELECT path, unnest(kept) AS unit_key FROM walk QUALIFY row_number() OVER (PARTITION BY path ORDER BY nth DESC) = 1)
SELECT path, unit_key, score FROM fin JOIN one USING (path, unit_key)"""


@query(GREEDY_SQL)
def greedy_dedup_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units of all pages without near copies. Keys are unique over pages while the units are dropped."""
    units = ranked_pages(spark, sf_dir).withColumn("unit_key", F.struct("path", "unit_key"))
    return drop_near_copies_at_scale(units).select("path", F.col("unit_key.unit_key").alias("unit_key"), "score")


@query(
    f"{RANKED_SQL} SELECT path, unit_key, row_number() OVER (PARTITION BY path ORDER BY score DESC, unit_key) AS nth, count(*) OVER (PARTITION BY path) AS match_count FROM best QUALIFY nth <= 3"
)
def nested_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files with their three best paragraphs."""
    files = search.group_by_file(ranked_pages(spark, sf_dir), None)
    return files.select("path", "match_count", F.explode("paragraphs").alias("p")).select("path", F.col("p.id").alias("unit_key"), F.col("p.nth").cast("long").alias("nth"), "match_count")


@query(f"{RANKED_SQL} SELECT path, unit_key, CASE WHEN m <= 0 THEN 1 ELSE least(greatest(ceil(score / m * 5), 1), 5)::INT END AS bucket FROM (SELECT *, max(score) OVER (PARTITION BY path) AS m FROM best)")
def score_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_pages(spark, sf_dir).select("path", "unit_key", present.score_bucket(F.col("score"), Window.partitionBy("path")).alias("bucket"))


# --- mail and federation ------------------------------------------------------------------------------------------------------


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("date"), "role", "text", paths.mail_path(F.lit("s"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("path"))


@query("SELECT conv_id::VARCHAR AS conversation_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, 'outlook:s/' || conv_id || '-' || turn) = 1 THEN 'indexed' ELSE 'superseded' END AS status FROM conversations")
def latest_only_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federation.latest_only(messages(spark, sf_dir)).select("conversation_id", F.col("date").alias("turn"), "status")


@query(
    """
WITH h AS (SELECT conv_id::VARCHAR AS conversation_id, turn AS mail_date, (100000 - least(length(text), 99999)) * 1000000000000 + conv_id * 1000 + turn AS rank, turn % 3 AS match_count FROM conversations),
a AS (SELECT *, max(mail_date) OVER (PARTITION BY conversation_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)
SELECT conversation_id, max(mail_date) AS mail_date, min(rank) AS rank,
  sum(CASE WHEN before IS NULL THEN match_count WHEN mail_date >= before THEN greatest(match_count, 1) ELSE 1 END)::BIGINT AS match_count FROM a GROUP BY 1"""
)
def thread_collapse_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result list in which longer messages rank first."""
    m = messages(spark, sf_dir)
    rank = (F.lit(100000) - F.least(F.length("text"), F.lit(99999))).cast("long") * 10**12 + F.col("conversation_id").cast("long") * 1000 + F.col("date")
    h = m.select("conversation_id", F.col("date").alias("mail_date"), rank.alias("rank"), (F.col("date") % 3).alias("match_count"))
    return federation.collapse_threads(h, None)


@query("SELECT conv_id, turn, md5(coalesce(role, '') || chr(31) || coalesce(text, '') || chr(31) || conv_id::VARCHAR) AS fingerprint FROM conversations")
def unit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", incremental.fingerprint("role", "text", "conv_id").alias("fingerprint"))


@query(
    """
WITH a AS (SELECT doc_id AS unit_key, 'local' AS source, length(text) / 7.0 AS score FROM documents), b AS (SELECT page_id AS unit_key, 'remote' AS source, length(html) / 9.0 AS score FROM pages)
SELECT unit_key, source, round(score, 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY score DESC, source, unit_key LIMIT 50"""
)
def hybrid_merge_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_key"), F.lit("local").alias("source"), (F.length("text") / 7.0).alias("score"))
    b = table(spark, sf_dir, "pages").select(F.col("page_id").alias("unit_key"), F.lit("remote").alias("source"), (F.length("html") / 9.0).alias("score"))
    return rounded(federation.merge_by_score(a, b, federation.remote_limit(50)), "score")


# --- incremental and catalog --------------------------------------------------------------------------------------------------


def _scan(spark: SparkSession, sf_dir: str, shifted: bool) -> DataFrame:
    """documents as a scan; shifted: as a catalog of an earlier state, with rows missing, changed, touched or gone since."""
    f = doc_files(spark, sf_dir)
    size, stamp, digest = F.length("body").cast("long"), F.col("doc_id"), F.md5("body")
    if shifted:
        f = f.where("doc_id % 10 <> 0")
        digest = F.when(F.col("doc_id") % 10 == 1, F.md5(F.lit("old"))).otherwise(digest)
        stamp = F.when(F.col("doc_id") % 10 == 2, F.lit(-1)).otherwise(stamp)
    else:
        f = f.where("doc_id % 10 <> 3")
    return f.select("path", size.alias("size"), stamp.alias("mtime"), digest.alias("content_hash"))


@query("SELECT source || '/' || lang || '/' || doc_id::VARCHAR || '.txt' AS path, CASE doc_id % 10 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' WHEN 2 THEN 'changed' WHEN 3 THEN 'orphan' ELSE 'unchanged' END AS state FROM documents")
def change_detection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.change_states(_scan(spark, sf_dir, False), _scan(spark, sf_dir, True))


@query("SELECT source || '/' || lang || '/' || doc_id::VARCHAR || '.txt' AS path FROM documents WHERE doc_id % 10 = 3")
def orphan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.orphans(_scan(spark, sf_dir, True), _scan(spark, sf_dir, False)).select("path")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    old = catalog.upsert(e.where("false"), e.where("event_id % 2 = 0"), ["user_id"], F.col("event_id"))
    newer = e.join(old.select("user_id", F.col("event_id").alias("_seen")), "user_id", "left").where("_seen is null or event_id >= _seen").drop("_seen")
    return catalog.upsert(old, newer, ["user_id"], F.col("event_id"))


@query("SELECT s_suppkey, s_name, coalesce(selected, false) AS selected FROM supplier LEFT JOIN (SELECT DISTINCT s_suppkey AS k, true AS selected FROM supplier WHERE s_nationkey % 2 = 0) ON s_suppkey = k")
def replace_keeping_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    old = catalog.set_selection(s, s.where("s_nationkey % 2 = 0"), ["s_suppkey"])
    return catalog.replace_keeping(s.select("s_suppkey", "s_name"), old, ["s_suppkey"]).select("s_suppkey", "s_name", "selected")


@query("SELECT source AS folder, count(*) AS file_count FROM documents GROUP BY 1 UNION ALL SELECT 'empty' || r_regionkey, 0 FROM region")
def folder_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = doc_files(spark, sf_dir)
    folders = files.select("folder").distinct().union(table(spark, sf_dir, "region").select(F.concat(F.lit("empty"), "r_regionkey")))
    return catalog.folder_counts(folders, files)


@query(
    """
WITH f AS (SELECT DISTINCT source AS store_id, lang AS name, source || '-' || lang AS path_label FROM documents),
m AS (SELECT source AS store_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source || '-' || lang END AS folder_name, CASE WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'indexed' END AS status FROM documents)
SELECT path_label, (SELECT count(*) FROM m WHERE m.status = 'indexed' AND m.store_id = f.store_id AND (m.folder_name = f.path_label OR m.folder_name = f.name)) AS indexed_count FROM f"""
)
def folder_or_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    label = F.concat_ws("-", "source", "lang")
    folders = d.select(F.col("source").alias("store_id"), F.col("lang").alias("name"), label.alias("path_label"), label.alias("id")).distinct()
    m = d.select(F.col("source").alias("store_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(label).alias("folder_name"), F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("indexed").alias("status"))
    return catalog.mail_folder_counts(folders, m).select("path_label", "indexed_count")


@query("SELECT DISTINCT source || '/' || lang AS folder FROM documents WHERE lang <> ''")
def distinct_folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_files(spark, sf_dir).where("lang <> ''").select(F.concat_ws("/", "folder", "lang").alias("folder")).distinct().orderBy(F.lower("folder"))


@query(
    """
WITH n AS (SELECT 'small ' || split_part(p_name, ' ', 2) AS word FROM part UNION ALL SELECT '' FROM region), k AS (SELECT DISTINCT p_name AS word FROM part WHERE p_size < 25)
SELECT (SELECT count(*) FROM (SELECT DISTINCT word FROM n WHERE word <> '') x WHERE word NOT IN (SELECT word FROM k)) AS added,
       (SELECT count(*) FROM (SELECT DISTINCT word FROM n WHERE word <> '') x WHERE word IN (SELECT word FROM k)) AS updated,
       (SELECT count(*) FROM n) - (SELECT count(DISTINCT word) FROM n WHERE word <> '') AS skipped"""
)
def dictionary_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.concat(F.lit("small "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("word")).union(table(spark, sf_dir, "region").select(F.lit("")))
    return catalog.dictionary_import(rows, p.where("p_size < 25").select(F.col("p_name").alias("word")).distinct())


@query("SELECT DISTINCT source || '/' || lang AS path FROM documents WHERE source || '/' || lang IN (SELECT source || '/' || lang FROM documents WHERE contains(text, 'ated')) AND source <> 'src3'")
def scopes_containing_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = doc_files(spark, sf_dir)
    tree = catalog.scope_tree(files).where("path like '%/%' and root <> 'src3'").select("path")
    return catalog.scopes_with_hits(tree, files.where(F.contains("body", F.lit("ated"))))


def windows_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' files in normal form below a drive's folder."""
    files = doc_files(spark, sf_dir)
    return files.withColumn("path", paths.normalize_path(F.concat(F.lit("C:/Data//"), F.col("path"))))


@query(
    r"""
WITH f AS (SELECT 'C:\Data\' || source AS sub, lang FROM documents),
a AS (SELECT 'C:\' AS path FROM f UNION ALL SELECT 'C:\Data' FROM f UNION ALL SELECT sub FROM f UNION ALL SELECT sub || '\' || lang FROM f)
SELECT 'C:' AS root, path, count(*) AS n_files FROM a GROUP BY path QUALIFY row_number() OVER (ORDER BY rtrim(replace(lower(path), '\', '/'), '/')) <= 400"""
)
def scope_tree_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.scope_tree(windows_files(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE source <> 'src2' AND source || '/' || lang <> 'src0/en'")
def exclude_prefix_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = spark.createDataFrame([("c:\\data\\SRC2",), ("C:/Data/src0/EN/",), ("C:\\Data\\src",)], "path string")
    return incremental.without_excluded(windows_files(spark, sf_dir), excluded).select("doc_id")


@query(r"SELECT doc_id, CASE WHEN source = 'src1' THEN 'c:\DATA\src1' WHEN lang = 'de' THEN 'C:\Data\' || source || '\DE' WHEN source = 'src2' THEN 'C:\Data\src2' END AS folder FROM documents")
def owner_folder_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = windows_files(spark, sf_dir)
    german = files.where("lang = 'de'").select(F.concat(F.lit("C:\\Data\\"), "folder", F.lit("\\DE")).alias("path")).distinct().withColumn("order", F.lit(1))
    fixed = spark.createDataFrame([("c:\\DATA\\src1", 0), ("C:\\Data\\src2", 2)], "path string, order int")
    return files.select("doc_id", "path").join(incremental.owners(files, german.union(fixed)), "path").select("doc_id", "folder")


@query(r"SELECT DISTINCT 'C:\Data\' || source || '\' || lang AS path FROM documents WHERE source || '/' || lang IN (SELECT source || '/' || lang FROM documents WHERE contains(text, 'ated')) AND source || '/' || lang <> 'src3/en'")
def scopes_with_hits_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = windows_files(spark, sf_dir)
    tree = files.select(F.regexp_extract("path", r"^(.*)\\", 1).alias("path")).distinct()
    return catalog.scopes_with_hits(tree, files.where(F.contains("body", F.lit("ated"))), recent=["c:/data/SRC3/en/"])


# --- history ------------------------------------------------------------------------------------------------------------------

NOW = 1_710_000_000
USES_SQL = "uses AS (SELECT event_type || '-' || (user_id % 40) AS term, epoch(date_trunc('second', ts))::BIGINT AS t, event_id, user_id FROM events)"
STATS_SQL = f"{USES_SQL}, stats AS (SELECT term, count(*) AS count, max(t) AS last FROM uses GROUP BY 1 ORDER BY last DESC, count DESC, term LIMIT 100)"
SCORE_SQL = f"2 * ln(1 + count) + CASE WHEN last <= 0 THEN 0.0 ELSE pow(2.0, -greatest({NOW} - last, 0) / 604800.0) END"


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    term = F.concat_ws("-", "event_type", (F.col("user_id") % 40).cast("string"))
    return e.select(term.alias("term"), F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("t"), "event_id", "user_id")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events as searches of several terms: the terms of ten neighbouring uses."""
    u = uses(spark, sf_dir).withColumn("event_id", F.floor(F.col("event_id") / 10))
    return u.groupBy("event_id").agg(F.sort_array(F.collect_set("term")).alias("terms"), F.max("t").alias("t"))


def registered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_name").distinct().select(F.col("p_name").alias("word")).union(p.select(F.concat(F.lit("click-"), "p_size").alias("word")).distinct())


@query(f"WITH {STATS_SQL} SELECT term, count, last FROM stats")
def history_stats_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.usage_stats(uses(spark, sf_dir))


@query(f"WITH {USES_SQL} SELECT arg_max(term, event_id) AS path, max(event_id) AS last FROM uses GROUP BY lower(term) ORDER BY last DESC, path LIMIT 3")
def recent_scopes_mru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.recent_scopes(uses(spark, sf_dir).select(F.col("term").alias("path"), F.col("event_id").alias("t")))


WORDS_SQL = "words AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT 'click-' || p_size FROM part)"
PREFIX_SQL = f"""prefixed AS (SELECT coalesce(s.term, w.term) AS term, 'prefix' AS kind, CASE WHEN s.term IS NOT NULL THEN {SCORE_SQL} ELSE 2 * ln(2) END + 0.25 AS score, s.term IS NOT NULL AS from_history, w.term IS NOT NULL AS from_registered
  FROM (SELECT * FROM stats WHERE starts_with(term, 'click')) s FULL JOIN (SELECT * FROM words WHERE starts_with(term, 'click')) w ON s.term = w.term)"""
SESSIONS_SQL = "sess AS (SELECT event_id // 10 AS event_id, list_sort(list_distinct(list(term))) AS terms, max(t) AS t FROM uses GROUP BY 1), recent AS (SELECT *, row_number() OVER (ORDER BY t DESC, event_id DESC) - 1 AS rank FROM sess ORDER BY t DESC, event_id DESC LIMIT 30)"
COOCCUR_SQL = f"""cooc AS (SELECT r.term, 'cooccur' AS kind, max(2 * ln(1 + coalesce(count, 1)) + pow(2.0, -greatest({NOW} - coalesce(last, t), 0) / 604800.0) + 1.0 / (1.0 + rank)) AS score, true AS from_history, bool_or(w.term IS NOT NULL) AS from_registered
  FROM (SELECT rank, t, unnest(terms) AS term FROM recent WHERE len(list_filter(terms, lambda x: starts_with(x, 'click'))) > 0) r LEFT JOIN stats s ON s.term = r.term LEFT JOIN words w ON w.term = r.term WHERE NOT starts_with(r.term, 'click') GROUP BY 1)"""


@query(f"WITH {STATS_SQL}, {WORDS_SQL}, {PREFIX_SQL} SELECT term, kind, round(score, 6) AS score, from_history, from_registered FROM prefixed")
def suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.prefix_suggestions(history.usage_stats(uses(spark, sf_dir)), registered_words(spark, sf_dir), "click", [], NOW), "score")


CHANGED_WORDS_SQL = "words AS (SELECT DISTINCT p_name AS term FROM part WHERE p_size % 4 <> 1 UNION SELECT 'click-' || p_size FROM part WHERE p_size % 7 <> 0)"


@query(f"WITH {STATS_SQL}, {CHANGED_WORDS_SQL}, {PREFIX_SQL} SELECT term, kind, round(score, 6) AS score, from_history, from_registered FROM prefixed")
def suggest_from_changed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion from an index of words that began with some sizes of parts, then took in the others, lost some and got some of those back."""
    p = table(spark, sf_dir, "part")
    plain, sized = F.col("p_name"), F.concat(F.lit("click-"), "p_size")
    words = p.select("p_size", F.explode(F.array(F.struct(plain.alias("w"), F.lit(True).alias("name")), F.struct(sized.alias("w"), F.lit(False).alias("name")))).alias("x")).select("p_size", "x.name", F.col("x.w").alias("word"))
    index = CompletionIndex.build(words.where("p_size % 2 = 0").select("word"), shared_folder(spark, "completion"), most=2)
    index.apply(words.where("p_size % 2 = 1").select("word", F.lit(False).alias("removed")))
    index.apply(words.where("name or p_size % 7 = 0").select("word", F.lit(True).alias("removed")))
    index.apply(words.where("name and p_size % 4 <> 1").select("word", F.lit(False).alias("removed")))
    return rounded(history.prefix_suggestions(history.usage_stats(uses(spark, sf_dir)), index, "click", [], NOW), "score")


@query(f"WITH {STATS_SQL}, {WORDS_SQL}, {SESSIONS_SQL}, {COOCCUR_SQL} SELECT term, kind, round(score, 6) AS score, from_history, from_registered FROM cooc")
def suggest_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = history.recent_events(sessions(spark, sf_dir))
    return rounded(history.cooccurrence_suggestions(recent, history.usage_stats(uses(spark, sf_dir)), registered_words(spark, sf_dir), "click", [], NOW), "score")


@query(f"WITH {STATS_SQL}, {WORDS_SQL}, {PREFIX_SQL}, {SESSIONS_SQL}, {COOCCUR_SQL} SELECT term, kind, round(score, 6) AS score, from_history, from_registered FROM (SELECT * FROM prefixed UNION ALL SELECT * FROM cooc) ORDER BY score DESC, term LIMIT 8")
def suggest_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = history.recent_events(sessions(spark, sf_dir))
    found = history.suggest(recent, history.usage_stats(uses(spark, sf_dir)), registered_words(spark, sf_dir), "click", NOW)
    return rounded(found, "score")


# --- streams ------------------------------------------------------------------------------------------------------------------


@query("SELECT user_id::VARCHAR AS path, arg_max(event_type, event_id) AS state, max(event_id) AS seq FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def stream_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of paths; an `error` stands for a removal. All that is there goes through the stream, then the last snapshot is read."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    changes = stream.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("state"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("removed"))
    out = shared_folder(spark, "snapshots")
    done = watch.index_stream(changes, watch.snapshot_upsert(out), shared_folder(spark, "checkpoint"), once=True)
    done.awaitTermination()
    return spark.read.parquet(f"{out}/v={done.lastProgress['batchId'] if done.lastProgress else 0}")


@query("SELECT event_type AS term, count(*) AS count, max(epoch(ts)::BIGINT) AS last FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events) GROUP BY 1")
def stream_history_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state over the stream of uses; the last update of each term."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    out = shared_folder(spark, "usage")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")

    watch.term_usage(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", shared_folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/b=*")
    return rows.groupBy("term").agg(F.max_by("count", "batch").alias("count"), F.max_by("last", "batch").alias("last"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, retrieve, rerank, drop near copies, group by file: the ten best files for a query."""
    found = search.search_files(doc_index(spark, sf_dir), 'the "of the" -trash', 10)
    return found.select("path", "match_count", "score", F.col("paragraphs")[0]["snippet"].alias("snippet"))


@query()
def ranked_file_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
