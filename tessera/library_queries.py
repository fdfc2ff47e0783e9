"""Registered queries of the library around a search: files, mail, catalog listings, scopes and query texts, with their SQL."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import analysis, lattice, paths, present, segment
from tessera.operators import catalog, federation, incremental, mail
from tessera.operators.index import SearchIndex
from tessera.operators.scratch import shared_folder
from tessera.operators.segments import SegmentStore, segment_upsert
from tessera.plans import everywhere, search
from tessera.plans import query_text as qt
from tessera.queries import INDEX_SQL, TEXT_SQL, UNITS_SQL, WS, doc_files, doc_index, phrase_sql, query, retrieval_sql, table, terms_sql, windows_files
from tessera.sources import readers, samples
from tessera.streaming import folder, watch

# --- files --------------------------------------------------------------------------------------------------------------------

FILES_SQL = "SELECT doc_id // 50 AS part, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY 1"


def text_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents as text files of 50 each, below folders part=n of a new shared folder."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 50).alias("part"), F.coalesce("text", F.lit("")).alias("value"))
    root = shared_folder(spark, "files")
    d.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.mode("overwrite").partitionBy("part").text(root)
    return root


def _part(path: str = "path"):
    return F.regexp_extract(path, r"part=(\d+)", 1).cast("long")


@query(f"SELECT part, 'txt' AS ext, octet_length(encode(t)) AS size, md5(t) AS text_md5, 'indexed' AS status FROM ({FILES_SQL})")
def scanned_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written, found by a recursive scan and read: one page each."""
    files, _ = readers.scan_folders(spark, [text_files(spark, sf_dir)])
    return readers.extract(files).select(_part().alias("part"), "ext", "size", F.md5(F.col("pages")[0]).alias("text_md5"), "status")


@query(f"SELECT count(*) AS indexed, 0 AS skipped, 0 AS errors FROM ({FILES_SQL})")
def extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.run_stats(readers.extract(readers.scan_folders(spark, [text_files(spark, sf_dir)])[0]))


#: What the readers find in files of all kinds made from documents (samples.mixed_files): lines of words, then a text by kind.
MIXED_SQL = rf"""l AS (SELECT doc_id, coalesce(source, '') AS name, coalesce(text, '') AS t, (doc_id % 8)::INT AS kind, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\r]', ' ', 'g'), chr(10)),
    lambda x: array_to_string(list_filter(string_split_regex(x, '[{WS}]+'), lambda w: w <> ''), ' ')), lambda x: x <> '') AS ls FROM documents),
f AS (SELECT doc_id, kind, ['docx', 'xlsx', 'html', 'docx', 'md', 'txt', 'pdf', 'json'][kind + 1] AS ext, CASE kind
    WHEN 0 THEN replace(replace(replace(array_to_string(ls, chr(10) || chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
    WHEN 1 THEN CASE WHEN len(ls) > 0 THEN name || chr(10) || replace(array_to_string(ls, chr(10)), ' ', chr(9)) END
    WHEN 2 THEN array_to_string(list_concat(['Document ' || doc_id || ' & ' || name, 'Document ' || doc_id || ' & ' || name], ls), chr(10) || chr(10))
    WHEN 4 THEN t WHEN 7 THEN repeat(' ' || chr(10), (1 + doc_id % 5)::BIGINT) END AS page FROM l),
x AS (SELECT doc_id, ext, page, CASE WHEN kind = 6 THEN 'unsupported' WHEN page IS NULL THEN 'error' WHEN regexp_matches(page, '[^\t\n\x0B\f\r ]') THEN 'indexed' ELSE 'skipped' END AS status FROM f)"""


def mixed_format_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.mixed_files(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("name"), "text"), WS)


@query(f"WITH {MIXED_SQL} SELECT doc_id, ext, status, length(page) AS chars, md5(page) AS page_md5 FROM x")
def mixed_formats_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of some format (office files, HTML in four encodings, Markdown; cut off, not UTF-8, without a reader, blank), read."""
    page = F.col("pages")[0]
    got = readers.extract(mixed_format_files(spark, sf_dir))
    return got.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("doc_id"), "ext", "status", F.length(page).cast("long").alias("chars"), F.md5(page).alias("page_md5"))


@query(f"WITH {MIXED_SQL} SELECT count_if(status = 'indexed') AS indexed, count_if(status = 'skipped') AS skipped, count_if(status IN ('error', 'unsupported')) AS errors FROM x")
def mixed_format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.run_stats(readers.extract(mixed_format_files(spark, sf_dir)))


@query("SELECT DISTINCT source || '/' || lang AS folder_name FROM documents WHERE length(text) > 2000 AND lang <> ''")
def indexed_mail_folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that hold a message which is indexed (here: a text of more than 2000 characters)."""
    status = F.when(F.length("text") > 2000, "indexed").otherwise("superseded")
    messages = table(spark, sf_dir, "documents").select(F.when(F.col("lang") != "", F.concat_ws("/", "source", "lang")).otherwise("").alias("folder_name"), status.alias("status"))
    return catalog.mail_folder_names(messages)


@query(f"SELECT part, octet_length(encode(t)) AS size FROM ({FILES_SQL})")
def watched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a watcher reports."""
    out = shared_folder(spark, "watched")
    seen = watch.watch_files(spark, text_files(spark, sf_dir), "*.txt").select(_part().alias("part"), F.col("length").alias("size"))
    seen.writeStream.option("checkpointLocation", shared_folder(spark, "checkpoint")).option("path", out).format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT DISTINCT p_name || ' ' || p_brand AS word, CASE WHEN p_size % 2 = 0 THEN '名詞' ELSE p_type END AS pos_label, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand || ', \"' || p_name || '\"' END AS reading FROM part")
def dictionary_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with and without a reading, written as CSV and read back."""
    even = F.col("p_size") % 2 == 0
    reading = F.concat("p_brand", F.lit(', "'), "p_name", F.lit('"'))
    words = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("word"), F.when(even, "名詞").otherwise(F.col("p_type")).alias("pos_label"), F.when(even, "").otherwise(reading).alias("reading")).distinct()
    path = f"{shared_folder(spark, 'words')}/words"
    readers.write_dictionary(words, path)
    return readers.read_dictionary(spark, path)


@query("SELECT doc_id, CASE WHEN length(source) + length(lang) <= 20 THEN '第' || doc_id || '条の二（' || source || lang || '）' END AS label FROM documents")
def article_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("## 第"), F.col("doc_id").cast("string"), F.lit("条の二（"), "source", "lang", F.lit("）　\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", segment.article_label(text).alias("label"))


@query("SELECT doc_id, lang || chr(10) || '# ' || source || chr(10) || '- ' || doc_id || chr(10) || '1. x' AS text FROM documents")
def markdown_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("lang", F.lit(" # "), "source", F.lit(" - "), F.col("doc_id").cast("string"), F.lit(" 1. x"))
    return table(spark, sf_dir, "documents").select("doc_id", present.markdown_breaks(text).alias("text"))


#: Letters written as kanji (the first of a word) and hiragana (the others), so that a text needs no spaces. Fixed values.
LETTERS, KANJI, KANA = "abcdefghijklmnopqrstuvwxyz", "山川田水火木金土石花空海星月日年人口手足目耳心力車門", "あいうえおかきくけこさしすせそたちつてとなにぬねのは"
WRITTEN_SQL = f"translate(w[1], '{LETTERS}', '{KANJI}') || translate(w[2:], '{LETTERS}', '{KANA}')"
PASSAGE_WORDS_SQL = "SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark WHERE text IS NOT NULL"


@query(
    f"""SELECT item_id, pos, {WRITTEN_SQL} AS term, CASE WHEN length(w) <= 2 THEN '助詞' ELSE '名詞' END AS part_of_speech, length(w) > 2 AS content
  FROM (SELECT item_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM ({PASSAGE_WORDS_SQL}))"""
)
def lattice_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages written without spaces, and segmented by a lexicon of their words: short ones are particles, and others nouns.

    Every word begins with its only kanji, so the words are the one path without unknown ones. Words that go on as longer ones do are many, and
    kanji alone, hiragana alone and compounds are in the lattice as unknown words.
    """
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    written = lambda w: F.concat(F.translate(F.substring(w, 1, 1), LETTERS, KANJI), F.translate(F.substring(w, 2, 1 << 20), LETTERS, KANA))
    passages = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", ws.alias("ws"))
    short = F.length("w") <= 2
    words = passages.select(F.explode("ws").alias("w")).distinct().select(
        written(F.col("w")).alias("surface"), F.when(short, 1).otherwise(2).alias("left_id"), F.when(short, 1).otherwise(2).alias("right_id"), (F.lit(500) - 10 * F.length("w")).alias("cost"),
        F.when(short, "助詞").otherwise("名詞").alias("pos"), F.lit(None).cast("string").alias("detail"),
    )
    connections = spark.createDataFrame([(1, 1, 300), (1, 2, 10), (2, 1, 20), (2, 2, 50), (0, 1, 200), (0, 2, 5)], "right_id int, left_id int, cost int")
    span = lambda a, b: {"first": a, "last": b}
    kinds = [("KANJI", [span("一", "龯")], True, False, 2, 0, 0, 90_000, 0, "名詞", None), ("HIRAGANA", [span("ぁ", "ゖ")], True, True, 3, 0, 0, 90_000, 0, "名詞", None)]
    classes = spark.createDataFrame(kinds, "name string, ranges array<struct<first: string, last: string>>, always boolean, grouped boolean, longest int, left_id int, right_id int, cost int, per_char int, pos string, detail string")
    tokens = analysis.use_lexicon(spark, lattice.lexicon_from_tables(words, connections, classes), "ja_passages")
    text = F.array_join(F.transform("ws", written), "")
    found = passages.select("item_id", F.posexplode(tokens(text)).alias("pos", "t"))
    return found.select("item_id", F.col("pos").cast("long").alias("pos"), F.col("t.surface").alias("term"), F.col("t.pos").alias("part_of_speech"), (~F.col("t.pos").isin("助詞", "助動詞", "連体詞", "接続詞", "感動詞")).alias("content"))


# --- scopes and paths ---------------------------------------------------------------------------------------------------------

MAIL_SQL = "mails AS (SELECT 'outlook:s/' || conv_id || '-' || turn AS path, role AS mail_folder FROM conversations), files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents)"


def files_and_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    mails = c.select(paths.mail_path(F.lit("s"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("path"), F.col("role").alias("mail_folder"), F.lit("email").alias("doc_kind"))
    return doc_files(spark, sf_dir).select("path", F.lit(None).cast("string").alias("mail_folder"), "doc_kind").union(mails)


@query(f"WITH {MAIL_SQL} SELECT path FROM mails WHERE lower(mail_folder) = 'user'")
def mail_folder_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_and_mail(spark, sf_dir).where(paths.in_scope(F.col("path"), "MailFolder: USER", F.col("mail_folder"))).select("path")


@query(f"WITH {MAIL_SQL} SELECT path FROM files WHERE path LIKE 'src1/%'")
def file_scope_without_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = files_and_mail(spark, sf_dir)
    return both.where(paths.in_scope(F.col("path"), "src1", F.col("mail_folder"))).union(both.where(paths.in_scope(F.col("path"), "outlook:s", F.col("mail_folder")))).select("path")


@query(f"WITH {MAIL_SQL} SELECT path FROM files")
def remote_without_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federation.without_mail(files_and_mail(spark, sf_dir)).select("path")


@query("SELECT DISTINCT source || '/' || lang AS path FROM documents WHERE contains(lower(source || '/' || lang), '1/e')")
def scope_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = doc_files(spark, sf_dir).select(F.concat_ws("/", "folder", "lang").alias("path"), "folder").distinct()
    return scopes.where(paths.matches_text(F.col("folder"), F.col("path"), " 1/E ")).select("path")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 < 2")
def type_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the chosen groups by their extension: md stands for two."""
    kinds = paths.extensions_of(["md", "TXT"])
    ext = F.element_at(F.array(F.lit("MARKDOWN"), F.lit("txt"), F.lit("html")), (F.col("doc_id") % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a.b/c."), ext).alias("path"))
    return files.where(paths.extension(F.col("path")).isin(kinds)).select("doc_id")


@query(r"SELECT doc_id, 'C:\Data\' || source || '\' || lang AS parent, doc_id || '.txt' AS name, 'Data/' || source || '/' || lang || '/' || doc_id || '.txt' AS label FROM documents")
def parent_name_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return windows_files(spark, sf_dir).select("doc_id", paths.parent_path(p).alias("parent"), paths.display_name(p).alias("name"), paths.relative_label(p, F.lit(r"C:\Data")).alias("label"))


@query("SELECT doc_id, source || ' / ' || lang || ' / ' || doc_id AS label FROM documents")
def mail_folder_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" /"), "source", F.lit("\\"), "source", F.lit("/ "), "lang", F.lit("//"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", paths.mail_label(F.col("source"), raw).alias("label"))


@query(f"WITH {INDEX_SQL}, hit AS (SELECT min(path) AS path FROM u WHERE doc_id IN (SELECT doc_id FROM p WHERE term = 'hean')) SELECT doc_id, path FROM u JOIN hit USING (path)")
def path_matches_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches in one file: the first by name that holds the term; asked for in other case, so the exact path finds nothing."""
    index = doc_index(spark, sf_dir)
    first = index.units.join(search.retrieve(index, "hean"), "doc_id", "left_semi").agg(F.min("path")).first()[0]
    return search.path_matches(index, "hean", first.upper()).select("doc_id", "path")


@query(f"WITH {INDEX_SQL}, hit AS (SELECT max(path) AS path FROM u WHERE doc_id IN (SELECT doc_id FROM p WHERE term = 'hean')) SELECT doc_id, path FROM u JOIN hit USING (path)")
def exact_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = doc_index(spark, sf_dir)
    last = index.units.join(search.retrieve(index, "hean"), "doc_id", "left_semi").agg(F.max("path")).first()[0]
    return search.search_units(index, "hean", 10, path=last).select("doc_id", "path")


# --- mail ---------------------------------------------------------------------------------------------------------------------


def mail_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """pages as items of mailboxes, and their folders: of five kinds of items two are no mail, of three folders one is not selected."""
    at = F.col("page_id")
    items = table(spark, sf_dir, "pages").select(
        F.lit("s").alias("store_id"), (at % 3).cast("string").alias("folder_id"), F.when(at % 11 != 0, at.cast("string")).alias("entry_id"), F.element_at(F.array(F.lit(43), F.lit(None), F.lit(26), F.lit(0), F.lit(53)), (at % 5 + 1).cast("int")).alias("class"),
        F.when(at % 4 != 0, F.col("url")).alias("subject"), F.when(at % 2 == 0, F.concat(F.lit(" \n"), "url", F.lit(" "))).otherwise(F.lit("  ")).alias("plain"), "html", F.when(at % 7 != 0, F.concat(F.lit("from "), at.cast("string"))).alias("sender"),
        F.lit("office").alias("behalf"), (at % 9).cast("string").alias("conversation_id"), F.when(at % 8 != 0, at).alias("received"), (at + 1).alias("sent"),
    )
    folders = spark.range(3).select(F.lit("s").alias("store_id"), F.col("id").cast("string").alias("entry_id"), F.concat(F.lit("s / "), "id").alias("path_label"), (F.col("id") != 2).alias("selected"))
    return items, folders


@query(
    f"""SELECT 'outlook:s/' || page_id AS path, CASE WHEN page_id % 4 = 0 THEN '' ELSE url END AS subject, CASE WHEN page_id % 2 = 0 THEN trim(url) ELSE {TEXT_SQL} END AS body,
  CASE WHEN page_id % 7 = 0 THEN 'office' ELSE 'from ' || page_id END AS from_addr, 's / ' || (page_id % 3) AS folder_name, CASE WHEN page_id % 8 = 0 THEN page_id + 1 ELSE page_id END AS date_unix
FROM pages WHERE page_id % 11 <> 0 AND page_id % 5 NOT IN (2, 4) AND page_id % 3 <> 2 AND CASE WHEN page_id % 8 = 0 THEN page_id + 1 ELSE page_id END >= 17"""
)
def mail_messages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.read_messages(*mail_items(spark, sf_dir), since=17).select("path", "subject", "body", "from_addr", "folder_name", "date_unix")


def thread_messages(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    """conversations as mail; every third message has a blank subject, every fourth a blank body. edited: later texts of every seventh."""
    c = table(spark, sf_dir, "conversations")
    entry = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    at = F.col("conv_id") * 1000 + F.col("turn")
    body = F.when(at % 4 == 0, " \n").otherwise(F.coalesce("text", F.lit("")))
    m = c.select(
        paths.mail_path(F.lit("s"), entry).alias("path"), F.lit("s").alias("store_id"), entry.alias("entry_id"), F.when(at % 3 == 0, " ").otherwise(F.coalesce("role", F.lit(""))).alias("subject"),
        F.when(at % 7 == 0, F.concat(body, F.lit(" edited"))).otherwise(body).alias("body") if edited else body.alias("body"), F.lit("x").alias("from_addr"), F.col("conv_id").cast("string").alias("conversation_id"), F.lit("s / in").alias("folder_name"), F.col("turn").alias("date_unix"),
    )
    return m.withColumn("content_hash", incremental.fingerprint("subject", "from_addr", "date_unix", "conversation_id", "body"))


_PAGE_TEXTS = f"(SELECT page_id, {TEXT_SQL} AS text FROM pages)"
_MAIL_TEXTS = "(SELECT conv_id * 1000 + turn AS page_id, CASE WHEN (conv_id * 1000 + turn) % 4 <> 0 AND coalesce(text, '') <> '' THEN text WHEN (conv_id * 1000 + turn) % 3 = 0 THEN '(件名なし)' ELSE role END AS text FROM conversations)"


@query(f"{UNITS_SQL.replace(_PAGE_TEXTS, _MAIL_TEXTS)} SELECT 'outlook:s/' || (page_id // 1000) || '-' || (page_id % 1000) || '#' || unit_id AS unit_key, CASE WHEN page_id % 3 = 0 THEN '(件名なし)' ELSE role END AS title, q.text AS body, 'msg' AS ext FROM q JOIN conversations ON conv_id * 1000 + turn = page_id")
def mail_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.mail_units(thread_messages(spark, sf_dir)).select("unit_key", "title", "body", "ext")


def synced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two syncs: first the messages of even turns, then all, some edited meanwhile."""
    at = shared_folder(spark, "mail")

    def stored(number: int, *tables: DataFrame) -> list[DataFrame]:
        """The tables after a sync, as the next one finds them."""
        for name, t in zip(("catalog", "units", "states"), tables, strict=True):
            t.write.parquet(f"{at}/{number}/{name}")
        return [spark.read.parquet(f"{at}/{number}/{name}") for name in ("catalog", "units", "states")]

    first = thread_messages(spark, sf_dir).where("date_unix % 2 = 0")
    columns = ["path", "store_id", "entry_id", "conversation_id", "folder_name", "from_addr", "subject", "date_unix", "content_hash"]
    nothing = first.where("false")
    listed, units, _ = stored(1, *mail.sync_messages(first, nothing.select(*columns, F.lit("").alias("status")), mail.mail_units(nothing)))
    return tuple(stored(2, *mail.sync_messages(thread_messages(spark, sf_dir, edited=True), listed, units)))


SYNC_SQL = """s AS (SELECT 'outlook:s/' || conv_id || '-' || turn AS path, turn = max(turn) OVER (PARTITION BY conv_id) AS wins, turn = max(CASE WHEN turn % 2 = 0 THEN turn END) OVER (PARTITION BY conv_id) AS was, (conv_id * 1000 + turn) % 7 = 0 AS edited FROM conversations)"""


@query(f"WITH {SYNC_SQL} SELECT path, CASE WHEN NOT wins THEN 'superseded' WHEN was AND NOT edited THEN 'skipped' ELSE 'indexed' END AS state FROM s")
def mail_sync_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synced(spark, sf_dir)[2]


@query(f"WITH {SYNC_SQL} SELECT path FROM s WHERE wins")
def mail_sync_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in the index after the syncs, listed as indexed in the catalog."""
    listed, units, _ = synced(spark, sf_dir)
    return listed.where("status = 'indexed'").join(units.select("path").distinct(), "path").select("path")


# --- routing ------------------------------------------------------------------------------------------------------------------


@query(retrieval_sql([], [terms_sql(["tion"]), terms_sql(["hean"])]))
def dictionary_rewritten_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of two registered words becomes two required ones. Words that are not in the query don't matter."""
    words = doc_index(spark, sf_dir).postings.where("term in ('tion', 'hean', 'the')").select(F.col("term").alias("word")).distinct()
    text = qt.rewrite_with_dictionary("tionhean", everywhere.dictionary_words(words, "tionhean"))
    found = search.retrieve(doc_index(spark, sf_dir), text)
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(20)


@query()
def search_all_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hybrid search of documents and mail, the ten best files and threads; the remote side cannot be opened and is left out."""
    mails = lambda: SearchIndex.build(mail.mail_units(thread_messages(spark, sf_dir)))
    gone = lambda: SearchIndex.load(spark, f"{shared_folder(spark, 'gone')}/none")
    found = everywhere.search_everywhere("thion hean", 10, local=lambda: doc_index(spark, sf_dir), remote=gone, mail=mails, mode="hybrid", mail_enabled=True)
    return found.select("path", "source", "match_count", F.round("score", 6).alias("score"), "mail_date")


@query("SELECT 'outlook:s/' || conv_id || '-' || turn AS unit_key, role AS text FROM conversations ORDER BY conv_id, turn LIMIT 1")
def preview_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored row of a mail id: both corpora hold it, mail answers."""
    m = thread_messages(spark, sf_dir)
    first = table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").select(paths.mail_path(F.lit("s"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))).first()[0]
    mails = table(spark, sf_dir, "conversations").select(paths.mail_path(F.lit("s"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("unit_key"), F.col("role").alias("text"))
    files = m.select(F.col("path").alias("unit_key"), F.lit("a file").alias("text"))
    return federation.first_preview(first, True, files, mails)


# --- catalog ------------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT source || '/' || lang AS path_label FROM documents WHERE lang IN ('de', 'fr')")
def selected_mail_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("path_label"), "lang").distinct()
    chosen = folders.where("lang in ('de', 'fr')").select("path_label")
    return catalog.selected_folders(catalog.set_selection(folders, chosen, ["path_label"])).select("path_label")


@query(f"WITH {SYNC_SQL} SELECT count_if(wins) AS n FROM s")
def indexed_mail_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.indexed_mail_count(synced(spark, sf_dir)[0])


@query(f"WITH {SYNC_SQL} SELECT path, CASE WHEN wins THEN 'indexed' ELSE 'superseded' END AS status FROM s WHERE path = (SELECT min('outlook:s/' || conv_id || '-' || turn) FROM conversations)")
def catalog_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = thread_messages(spark, sf_dir).agg(F.min("path")).first()[0]
    return catalog.find_rows(synced(spark, sf_dir)[0], "path", first).select("path", "status")


@query("SELECT path, present FROM (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id % 4 <> 0 AS present FROM documents)")
def index_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = doc_files(spark, sf_dir)
    return catalog.has_rows(files, files.where("doc_id % 4 <> 0"))


@query("SELECT DISTINCT p_name AS word, p_brand AS pos_label FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1)")
def words_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.col("p_name").alias("word"), F.col("p_brand").alias("pos_label"), "p_size")
    kept = catalog.remove_rows(words, words.where("p_size = 1").select("word"), ["word"])
    return catalog.listing(kept.drop("p_size").distinct(), "word", "pos_label", order="word")


@query("SELECT 'files' AS name, count(*) AS n FROM documents WHERE source <> 'src1' UNION ALL SELECT 'folders', count(DISTINCT source) FROM documents WHERE source <> 'src1'")
def cascade_folder_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = doc_files(spark, sf_dir).select(paths.normalize_path(F.col("path")).alias("path"), F.col("folder"))
    left = catalog.remove_folder({"files": files, "folders": files.select(F.col("folder").alias("path")).distinct()}, "SRC1")
    return left["files"].agg(F.count("*").alias("n")).select(F.lit("files").alias("name"), "n").union(left["folders"].agg(F.count("*").alias("n")).select(F.lit("folders").alias("name"), "n"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 NOT IN (0, 1)")
def units_after_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units without those of removed and of changed paths; the changed ones come without text."""
    files = doc_files(spark, sf_dir)
    out = incremental.replace_units(files, files.where("doc_id % 5 = 1").limit(0), files.where("doc_id % 5 in (0, 1)"))
    return out.select("doc_id")


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents WHERE doc_id % 10 <> 3")
def reconciled_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = doc_files(spark, sf_dir)
    return watch.reconcile(files, files.where("doc_id % 10 <> 3")).select("path")


@query(
    """
SELECT least(greatest(max(CASE WHEN event_id = 7 THEN event_id END), 1), 1000) AS max_results, max(event_type) || '' AS search_mode, true AS pos_filter_enabled, false AS mail_enabled, true AS mail_thread_collapse,
  730 AS mail_lookback_days, 3600 AS mail_sync_interval_secs, 60000 AS remote_timeout_ms FROM events"""
)
def settings_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of settings from the events: one in range, one out of range, one unreadable, the others missing."""
    e = table(spark, sf_dir, "events")
    rows = e.where("event_id = 7").select(F.lit("max_results").alias("key"), F.col("event_id").cast("string").alias("value"))
    rows = rows.union(e.agg(F.max("event_type")).select(F.lit("search_mode"), "*")).union(e.agg((F.lit(10**6) + F.max("event_id")).cast("string")).select(F.lit("remote_timeout_ms"), "*"))
    rows = rows.union(e.agg(F.max("event_type")).select(F.lit("mail_lookback_days"), "*"))
    return catalog.settings_record(rows)


# --- query texts --------------------------------------------------------------------------------------------------------------


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("last", "committed", "applied", "terms", "preview")]))
def _assist(texts: pd.Series) -> pd.DataFrame:
    rows = [(qt.last_token(t), "|".join(qt.committed_terms(t)), qt.apply_suggestion(t, "two words", "prefix"), "|".join(qt.search_terms(t)), "|".join(qt.preview_terms([f"**{w}**" for w in t.split()] + [t]))) for t in texts]
    return pd.DataFrame(rows, columns=["last", "committed", "applied", "terms", "preview"])


@query(
    """
SELECT DISTINCT p_name AS query, split_part(p_name, ' ', 2) AS last, replace(p_name, ' ', '|') AS committed, split_part(p_name, ' ', 1) || ' "two words" ' AS applied, replace(p_name, ' ', '|') AS terms, p_name AS preview FROM part"""
)
def query_text_assistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed texts (names of two words): the word being typed, the terms so far, a completed text, terms for the history, terms to mark."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("query")).distinct().select("query", _assist("query").alias("a")).select("query", "a.*")


# --- an index that follows a stream -------------------------------------------------------------------------------------------

#: Files at most that a part of the events lands in.
LANDED_SHARES = 4
USER_FILES_SQL = """
last AS (SELECT user_id, arg_max(event_type, event_id) AS kind, max(event_id) AS event_id FROM events GROUP BY 1),
u AS (SELECT 'users/' || user_id % 10 || '/' || user_id AS doc_id, user_id::VARCHAR AS title, coalesce(text, '') AS body
  FROM last LEFT JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents) WHERE kind <> 'error' AND user_id % 10 <> 3),"""


@query(retrieval_sql([terms_sql(["thion", "hean"])], [phrase_sql(["of", "the"])]).replace(INDEX_SQL.split("\nw AS")[0], USER_FILES_SQL).replace("SELECT doc_id, round(score", "SELECT doc_id AS unit_key, round(score"))
def stream_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of users' files, in micro-batches whose events are not in order: each event puts a document's text into the user's file, an `error` removes it.

    A folder is excluded. The index takes every micro-batch as a segment; then it is searched. The events land in as many files at any size, LANDED_SHARES for each part, so that
    micro-batches grow with them rather than their number: each reads the documents. Of these only the texts that a batch's changes name are dealt.
    """
    events, documents = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    n = documents.count()
    landed = shared_folder(spark, "landed")
    rows = events.select(
        F.concat_ws("/", F.lit("users"), (F.col("user_id") % 10).cast("string"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("removed"),
        (F.col("event_id") % n).cast("string").alias("fingerprint"),
    )
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(5))).repartition(5 * LANDED_SHARES, "part", F.pmod(F.xxhash64("seq", "path"), F.lit(LANDED_SHARES)))
    dealt.write.mode("overwrite").partitionBy("part").parquet(landed)
    files = spark.read.parquet(f"{landed}/part=*").schema
    stream = spark.readStream.schema(files).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(landed)

    def read(changed: DataFrame) -> DataFrame:
        asked = changed.select(F.col("fingerprint").alias("_doc")).distinct()
        texts = documents.select(F.col("doc_id").cast("string").alias("_doc"), F.coalesce("text", F.lit("")).alias("body")).join(asked, "_doc", "left_semi")
        found = changed.join(texts, changed["fingerprint"] == texts["_doc"], "left")
        return found.select(F.col("path").alias("unit_key"), "path", F.element_at(F.split("path", "/"), -1).alias("title"), F.coalesce("body", F.lit("")).alias("body"))

    store = SegmentStore(spark, shared_folder(spark, "segments"))
    excluded = spark.createDataFrame([("USERS/3",)], "path string")
    watch.index_stream(stream, segment_upsert(store, read, excluded), shared_folder(spark, "checkpoint"), once=True).awaitTermination()
    found = search.retrieve(store.index(), 'thion hean "of the"')
    return found.select("unit_key", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "unit_key").limit(20)


@query(
    """
WITH n AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT 'source=' || source AS folder, 'create' AS event, 0 AS listing FROM n UNION ALL SELECT 'source=' || (SELECT source FROM n ORDER BY n DESC, source LIMIT 1), 'remove', 1
UNION ALL SELECT DISTINCT 'role=' || role, 'create', 1 FROM conversations WHERE role IS NOT NULL"""
)
def watched_folder_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each source is written and seen; then, while the stream is down, the largest source's file goes and files of messages come; the restarted stream sees both."""
    docs, mails = table(spark, sf_dir, "documents").where("source is not null"), table(spark, sf_dir, "conversations").where("role is not null")
    root, out, checkpoint, state = (shared_folder(spark, n) for n in ("watched", "events", "checkpoint", "listings"))
    store = lambda df, by: df.select(by, F.coalesce("text", F.lit("")).alias("value")).repartition(by).write.mode("append").partitionBy(by).text(root)

    def events() -> None:
        seen = folder.watch_folder(spark, root, state, "*.txt")
        seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    store(docs, "source")
    events()
    largest = docs.groupBy("source").count().orderBy(F.desc("count"), "source").first()
    if largest:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/source={largest['source']}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    store(mails, "role")
    events()
    found = spark.read.schema(folder.EVENTS).parquet(out)
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1).alias("folder"), "event", "listing").distinct()


@query("SELECT user_id::VARCHAR AS path, arg_max(event_type, event_id) AS state, max(event_id) AS seq FROM events GROUP BY user_id")
def quiet_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events of users' paths, in files that are not in order: each path leaves when it has been quiet. The last row of each, once all have left."""
    own = folder.with_rocksdb(spark)
    events = own.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("state"), F.col("event_id").alias("seq"))
    landed, out = shared_folder(own, "landed"), shared_folder(own, "quiet")
    events.repartition(3, F.xxhash64("seq")).write.mode("overwrite").parquet(landed)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/b={number:06d}")

    stream = own.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    running = watch.index_stream(stream, keep, shared_folder(own, "checkpoint"))
    last = lambda rows: rows.groupBy("path").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))
    want = last(events)
    try:
        while running.isActive:
            time.sleep(1)
            left = own.read.schema(events.schema).option("recursiveFileLookup", "true").parquet(out)
            if want.join(left.select("path", "seq"), ["path", "seq"], "left_anti").isEmpty():
                break
    finally:
        running.stop()
    if running.exception():
        raise running.exception()
    return last(own.read.schema(events.schema).option("recursiveFileLookup", "true").parquet(out))


@query(f"SELECT path, 'local' AS source, round(10 + score, 6) AS score, 'failed' AS remote FROM ({retrieval_sql([terms_sql(['thion'])], limit=10)}) JOIN (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents) USING (doc_id)")
def hybrid_with_a_failing_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hybrid search whose remote side, the pages, loses its postings after it was opened: the local side answers alone, and the status says so."""
    at = shared_folder(spark, "remote")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("unit_key"), F.col("url").alias("path"), F.lit("").alias("title"), F.coalesce("html", F.lit("")).alias("body"), F.lit("html").alias("ext"), F.lit("file").alias("doc_kind"))
    SearchIndex.build(pages).save(at)

    def remote() -> SearchIndex | None:
        opened = SearchIndex.load(spark, at)
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/postings")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
        return opened

    found, status = everywhere.search_sides("thion", 10, local=lambda: doc_index(spark, sf_dir), remote=remote, mode="hybrid")
    return found.select("path", "source", F.round("score", 6).alias("score"), F.lit(status["remote"].split(":")[0]).alias("remote"))


#: A mark for the gaps that rewriting makes, so that those at the ends of free atoms can go.
_DELIMS = r" \t\n\r,、，　"
REWRITTEN_SQL = rf"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{3,}}')) AS word FROM benchmark WHERE text IS NOT NULL), p AS (SELECT '(' || string_agg(word, '|' ORDER BY length(word) DESC, word) || ')' AS pat FROM w),
m AS (SELECT item_id, regexp_replace(regexp_replace(text, pat, chr(1) || '"\1"' || chr(1), 'g'), '\x01+', chr(1), 'g') AS t FROM benchmark, p)
SELECT item_id, replace(regexp_replace(regexp_replace(t, '(^|[{_DELIMS}])\x01', '\1', 'g'), '\x01($|[{_DELIMS}])', '\1', 'g'), chr(1), ' ') AS text FROM m"""


@query(REWRITTEN_SQL)
def dictionary_rewritten_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts as queries, rewritten by the words of three letters or more that they hold: words within words, and at the ends of others."""
    b = table(spark, sf_dir, "benchmark")
    words = b.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    return b.select("item_id", qt.rewriter(words)(F.col("text")).alias("text"))
