"""Segmentation of extracted pages into search units, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.html import LINE_SPACE, SPACE

UNIT_MIN, UNIT_MAX, OVERLAP, LABEL_MAX = 40, 1000, 16, 36
#: Numerals that may follow an article's number. Fixed value.
NUMERALS = "0-9０-９〇零一二三四五六七八九十百千万"
#: White space that does not end a line.
BLANKS = rf"{SPACE}&&[^\n\r]"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def blank_line_blocks(page: Column) -> Column:
    """Blocks between blank lines: lines right-trimmed, the block trimmed, none empty."""
    lines = F.regexp_replace(page, rf"[{LINE_SPACE}]+(?=\n|\z)", "")
    blocks = F.transform(F.split(lines, r"\n\n+"), trim_space)
    return F.filter(blocks, lambda b: b != "")


def merge_short_blocks(blocks: Column, least: int = UNIT_MIN) -> Column:
    """An ordered fold over array<struct<text,page>>: a block joins its predecessor where either is shorter than `least`."""

    def step(acc: Column, block: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & ((F.length(F.try_element_at(acc, F.lit(-1))["text"]) < least) | (F.length(block["text"]) < least))
        merged = F.struct(F.concat(last["text"], F.lit("\n\n"), block["text"]).alias("text"), last["page"].alias("page"))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(merged))).otherwise(F.concat(acc, F.array(block)))

    return F.aggregate(blocks, F.array().cast("array<struct<text:string,page:int>>"), step)


def article_label(text: Column) -> Column:
    """The leading article mark of a text (with branch number and heading), if it has 2 to 40 characters; else null."""
    line = F.regexp_replace(trim_space(F.substring_index(text, "\n", 1)), r"\A(?:#\s*)+", "")
    mark = F.regexp_extract(line, rf"\A(第[^条]*条(?:の[{NUMERALS}]+)?(?:[{SPACE}]*(?:（[^）]*）|\([^)]*\)))?)", 1)
    mark = trim_space(mark)
    # the rest is for texts that can have a mark; a condition of its own, as both sides of an `and` are evaluated
    return F.when(text.rlike(rf"\A[{SPACE}]*(?:#\s*)*第"), F.when(F.length(mark).between(2, 40), mark))


def unit_label(text: Column, number: Column) -> Column:
    """The article mark, else the text on one line cut to LABEL_MAX characters, else the unit's number.

    Only the start of a text is flattened: what gives LABEL_MAX + 2 characters on one line, of which the last can be a space.
    """
    start = F.regexp_extract(text, rf"\A[{SPACE}]*+(?:[\n\r]*+(?:[^{SPACE}]|[{BLANKS}][{SPACE}]*+)){{0,{LABEL_MAX + 2}}}", 0)
    flat = trim_space(F.regexp_replace(F.regexp_replace(start, r"[\n\r]", ""), rf"[{SPACE}]+", " "))
    short = F.when(F.length(flat) > LABEL_MAX, F.concat(F.substring(flat, 1, LABEL_MAX), F.lit("…"))).otherwise(flat)
    return F.coalesce(article_label(text), F.when(flat == "", F.concat(F.lit("¶"), (number + 1).cast("string"))).otherwise(short))


def windows(text: Column, size: int = UNIT_MAX, overlap: int = OVERLAP) -> Column:
    """The text itself, or windows of `size` characters that overlap, without those of white space only."""
    n = F.length(text)
    last = F.greatest(F.ceil((n - size) / (size - overlap)).cast("int"), F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * (size - overlap) + 1, F.lit(size)))
    return F.when(n <= size, F.array(text)).otherwise(F.filter(cut, lambda p: trim_space(p) != ""))


def segment_pages(files: DataFrame, pages_col: str = "pages", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per search unit: keep..., unit_id, page, text, label, kind. Files without text have none.

    Numbers run over a file's units in order; the label of a split block is computed once, before the split.
    """
    cols = [files[c] for c in keep]
    paged = F.transform(
        F.col(pages_col), lambda p, i: F.transform(blank_line_blocks(p), lambda b: F.struct(b.alias("text"), (i + 1).cast("int").alias("page")))
    )
    merged = files.select(*cols, merge_short_blocks(F.flatten(paged)).alias("_blocks"))
    split = F.transform(
        "_blocks",
        lambda b: F.struct(b["text"].alias("text"), b["page"].alias("page"), windows(b["text"]).alias("pieces")),
    )

    # the first number of each block is the number of pieces before it
    def count(acc: Column, block: Column) -> Column:
        first = F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1))["next"]).otherwise(F.lit(0))
        return F.concat(
            acc,
            F.array(F.struct(block["text"].alias("text"), block["page"].alias("page"), block["pieces"].alias("pieces"), first.alias("first"), (first + F.size(block["pieces"])).alias("next"))),
        )

    start = F.array().cast("array<struct<text:string,page:int,pieces:array<string>,first:int,next:int>>")
    numbered = merged.select(*keep, F.explode(F.aggregate(split, start, count)).alias("b"))
    labelled = numbered.select(
        *keep, F.col("b.page").alias("page"), F.col("b.first").alias("first"), F.when(F.length("b.text") > UNIT_MAX, "chunk").otherwise("paragraph").alias("kind"),
        unit_label(F.col("b.text"), F.col("b.first")).alias("label"), F.col("b.pieces").alias("pieces"),
    )
    units = labelled.select(*keep, "page", "first", "kind", "label", F.posexplode("pieces").alias("at", "text"))
    return units.select(*keep, (F.col("first") + F.col("at")).cast("int").alias("unit_id"), "page", "text", "label", "kind")
