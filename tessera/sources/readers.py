"""Readers: folders of files to documents (title, pages), with a status for what has no text or no reader.

Files come from Spark's binaryFile source; each format is a column expression or a plain UDF over the content, whose Python process holds
a hundred files at once. A user may register more.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.html import collapse_whitespace, decode_html_column, html_text, html_title
from tessera.functions.paths import base_name, extension

#: Extensions that a scan takes. Fixed value.
SUPPORTED = "txt md markdown json html htm pdf docx doc jtd xls xlsx".split()
#: Those for which no reader is built in.
WITHOUT_READER = ("pdf", "doc", "jtd", "xls")


def scan_folders(spark: SparkSession, roots: list[str]) -> tuple[DataFrame | None, list[str]]:
    """path, modificationTime, length, content, ext of the supported files below the roots, and the roots that are missing."""
    frames, missing = [], []
    for root in roots:
        try:
            frames.append(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root))
        except AnalysisException:
            missing.append(root)
    if not frames:
        return None, missing
    files = frames[0]
    for f in frames[1:]:
        files = files.union(f)
    files = files.withColumn("ext", extension(F.col("path")))
    return files.where(F.col("ext").isin(SUPPORTED)), missing


@F.udf(T.StringType(), useArrow=False)
def content_hash(content: bytes | None) -> str | None:
    """xxHash64 with seed 0, sixteen hex digits."""
    return None if content is None else xxhash.xxh64_hexdigest(bytes(content))


def _runs(xml: str) -> str:
    """Text of a stretch of word-processing XML: runs join, breaks and tabs count, the rest is one space; entities stay."""
    t = re.sub(r"<w:(?:br|cr)\b[^>]*>", "\n", xml)
    t = re.sub(r"<w:tab\b[^>]*>", "\t", t)
    t = re.sub(r"<[^>]*>", "", t)
    return t.strip()


def docx_paragraphs(xml: str) -> list[str]:
    """Paragraphs of a document.xml that have text; runs within one are joined."""
    found = re.findall(r"<w:p(?=[ >/])[^>]*?(?<!/)>(.*?)</w:p>", xml, re.S)
    return [p for p in (re.sub(r"[ \t]+", " ", _runs(x)) for x in found) if p]


def read_docx(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    found = docx_paragraphs(xml)
    return ["\n\n".join(found) if found else " ".join(_runs(xml).split())]


def read_xlsx(content: bytes) -> list[str]:
    """A page per sheet: its name, then rows of non-empty cells joined by tabs; sheets without cells are left out."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in tree("xl/sharedStrings.xml").findall("m:si", ns)] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in tree("xl/_rels/workbook.xml.rels")}
        pages = []
        for sheet in tree("xl/workbook.xml").find("m:sheets", ns):
            rows = []
            for row in tree(f"xl/{targets[sheet.get(rel)]}").iter(f"{{{ns['m']}}}row"):
                cells = []
                for c in row.findall("m:c", ns):
                    if c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                    else:
                        value = c.findtext("m:v", "", ns)
                        value = shared[int(value)] if c.get("t") == "s" and value else value
                    cells += [value.strip()] if value.strip() else []
                rows += ["\t".join(cells)] if cells else []
            if rows:
                pages.append("\n".join([sheet.get("name"), *rows]))
    if not pages:
        raise ValueError("no sheets with cells")
    return pages


#: ext -> function(bytes) -> pages; more may be registered.
BINARY_READERS: dict[str, Callable[[bytes], list[str]]] = {"docx": read_docx, "xlsx": read_xlsx}


def split_form_feeds(text: Column) -> Column:
    """Pages of extracted PDF text: trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, "\f"), lambda p: F.trim(p)), lambda p: p != "")


def _binary_pages(readers: dict[str, Callable[[bytes], list[str]]]):
    @F.udf("pages array<string>, error string", useArrow=False)
    def run(ext: str, content: bytes) -> tuple[list[str] | None, str | None]:
        try:
            return readers[ext](bytes(content)), None
        except Exception as why:  # noqa: BLE001  a broken file is a row of the error sink, whatever broke
            return None, f"{type(why).__name__}: {why}"

    return run


def extract(files: DataFrame, readers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """path, ext, size, mtime, content_hash, title, pages, status (indexed, skipped, error, unsupported), error.

    Text formats must be valid UTF-8; HTML is decoded by its declarations; a page's title is put before its text where it differs
    from the file's name. Files without text are skipped. Each format is its own branch of a union: no file is decoded by another's reader.
    """
    readers = BINARY_READERS if readers is None else readers
    base = files.select(
        "path", "ext", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), content_hash("content").alias("content_hash"), base_name(F.col("path")).alias("title"), "content"
    )
    plain = ("txt", "md", "markdown", "json")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = base.where(F.col("ext").isin(*plain)).withColumn("pages", F.when(valid, F.array(F.col("content").cast("string")))).withColumn("error", F.when(~valid, F.lit("not UTF-8")))
    html = base.where(F.col("ext").isin("html", "htm")).withColumn("_h", decode_html_column("content"))
    head = html_title(F.col("_h"))
    body = html_text(F.col("_h"))
    body = F.when(head.isNotNull() & (head != F.col("title")) & (body != ""), F.concat(head, F.lit("\n\n"), body)).otherwise(body)
    html = html.withColumn("pages", F.array(body)).withColumn("error", F.lit(None).cast("string")).drop("_h")
    binary = base.where(F.col("ext").isin(*readers)).withColumn("_r", _binary_pages(readers)("ext", "content")).withColumn("pages", F.col("_r.pages")).withColumn("error", F.col("_r.error")).drop("_r")
    other = base.where(~F.col("ext").isin(*plain, "html", "htm", *readers)).withColumn("pages", F.lit(None).cast("array<string>")).withColumn("error", F.concat(F.lit("no reader for "), "ext"))
    every = text.union(html).union(binary).union(other).drop("content")
    has_text = F.exists(F.coalesce("pages", F.array().cast("array<string>")), lambda p: p.rlike(r"\S"))
    status = F.when(F.col("error").startswith("no reader"), "unsupported").when(F.col("error").isNotNull(), "error").when(has_text, "indexed").otherwise("skipped")
    return every.withColumn("status", status)


def run_stats(extracted: DataFrame) -> DataFrame:
    """indexed, skipped, errors: one row."""
    return extracted.agg(F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status").isin("error", "unsupported")).alias("errors"))


def read_dictionary(spark: SparkSession, path: str, default_pos: str = "名詞") -> DataFrame:
    """word, pos_label, reading of a CSV file: comments and blanks are skipped, and so is a header."""
    rows = spark.read.option("comment", "#").option("escape", '"').schema("word string, pos_label string, reading string").csv(path)
    word = F.trim(F.replace(F.col("word"), F.lit("﻿"), F.lit("")))
    rows = rows.select(word.alias("word"), F.coalesce(F.nullif(F.trim("pos_label"), F.lit("")), F.lit(default_pos)).alias("pos_label"), F.coalesce(F.trim("reading"), F.lit("")).alias("reading"))
    return rows.where((F.col("word") != "") & ~F.lower("word").isin("surface", "表層形"))


def write_dictionary(words: DataFrame, path: str, default_pos: str = "名詞") -> None:
    """One column for plain words, else word,pos,reading."""
    quoted = lambda c: F.when(F.col(c).rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    plain = (F.coalesce("reading", F.lit("")) == "") & (F.coalesce("pos_label", F.lit(default_pos)) == default_pos)
    words.select(F.when(plain, quoted("word")).otherwise(F.concat_ws(",", quoted("word"), quoted("pos_label"), quoted("reading"))).alias("value")).write.text(path)


def preview_file(spark: SparkSession, path: str) -> DataFrame:
    """The whole text of one JSON file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def ole_to_unix(days: Column) -> Column:
    return F.round((days - 25569) * 86400).cast("long")


__all__ = ["collapse_whitespace", "docx_paragraphs", "extract", "ole_to_unix", "preview_file", "read_dictionary", "run_stats", "scan_folders", "split_form_feeds", "write_dictionary"]
