"""Files of several formats made from rows of text, as Spark would find them in a folder: for queries and tests of the readers."""

from __future__ import annotations

import html
import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared charset and codec of HTML files in turn; the last has a byte order mark in place of a declaration.
CHARSETS = (("utf-8", "utf-8"), ("iso-8859-1", "cp1252"), ("shift_jis", "cp932"), ("", "utf-16"))
_OFFICE = "http://schemas.openxmlformats.org"


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx_bytes(lines: list[str]) -> bytes:
    """A paragraph per line and a run per word; every other gap is a tab."""
    runs = lambda words: "".join(f'<w:r><w:t xml:space="preserve">{escape(w)}</w:t>{"" if k + 1 == len(words) else "<w:tab/>" if k % 2 else "<w:t> </w:t>"}</w:r>' for k, w in enumerate(words))
    body = "".join(f"<w:p><w:pPr/>{runs(line.split(' '))}</w:p>" for line in lines)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{_OFFICE}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def xlsx_bytes(name: str, lines: list[str]) -> bytes:
    """One sheet; a row per line and a cell per word, of which the first is a shared string and the others are inline."""
    main, package = f"{_OFFICE}/spreadsheetml/2006/main", f"{_OFFICE}/package/2006/relationships"
    links = f"{_OFFICE}/officeDocument/2006/relationships"
    shared = {w: k for k, w in enumerate(dict.fromkeys(line.split(" ")[0] for line in lines))}
    rows = "".join(
        f'<row><c t="s"><v>{shared[first]}</v></c>{"".join(f"<c t={quoteattr('inlineStr')}><is><t>{escape(w)}</t></is></c>" for w in rest)}</row>' for first, *rest in (line.split(" ") for line in lines)
    )
    return _zipped({
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets><sheet name={quoteattr(name)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">{"".join(f"<si><t>{escape(w)}</t></si>" for w in shared)}</sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>',
    })


def html_bytes(title: str, lines: list[str], turn: int) -> bytes:
    """A paragraph per line among markup that is no text, in the turn's charset; in UTF-8 where that cannot hold the text."""
    declared, codec = CHARSETS[turn % len(CHARSETS)]
    body = "".join(f"<p>{html.escape(x, quote=False)}</p>" for x in lines)
    page = lambda c: f'<html><head>{f"<meta charset={quoteattr(c)}>" if c else ""}<title>{html.escape(title, quote=False)}</title><style>p {{}}</style></head><body>{body}<!-- end --><script>end()</script></body></html>'
    text = page(declared)
    if text.encode(codec, "replace").decode(codec) != text:
        return page("utf-8").encode()
    return text.encode(codec)


@F.udf(T.BinaryType(), useArrow=False)
def _contents(kind: str, key: int, name: str, text: str, lines: list[str]) -> bytes:
    """A plain function, so that a Python process holds a hundred texts at once."""
    match kind:
        case "docx":
            return docx_bytes(lines)
        case "xlsx":
            return xlsx_bytes(name, lines)
        case "html":
            return html_bytes(f"Document {key} & {name}", lines, key // 8)
        case "cut.docx":
            whole = docx_bytes(lines)
            return whole[: len(whole) // 2]
        case "md":
            return text.encode()
        case "txt":  # no UTF-8
            return text.encode() + b"\xff"
        case "pdf":
            return b"%PDF-1.7\n" + text.encode()
        case _:  # blank
            return b" \n" * (1 + key % 5)


#: The eight kinds of files, by key modulo 8.
KINDS = ("docx", "xlsx", "html", "cut.docx", "md", "txt", "pdf", "json")


def plain_lines(text: Column, space: str) -> Column:
    """The lines of a text that have words, words joined by one space; control characters are spaces, as XML cannot hold them."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\r]", " ")
    words = lambda line: F.filter(F.split(line, f"[{space}]+"), lambda w: w != "")
    return F.filter(F.transform(F.split(clean, "\n"), lambda x: F.array_join(words(x), " ")), lambda x: x != "")


def mixed_files(rows: DataFrame, space: str) -> DataFrame:
    """A file of rows' (key, name, text) each, with the columns of a scan: path, ext, length, modificationTime, content.

    Kinds take turns by the key: whole office and HTML files, one that is cut off, Markdown, invalid UTF-8, one without a reader, and one that
    is blank. Null names and texts are empty.
    """
    name, text = F.coalesce("name", F.lit("")), F.coalesce("text", F.lit(""))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("key", F.lit(len(KINDS))) + 1).cast("int"))
    files = rows.select(F.concat(F.lit("folder/"), "key", F.lit("."), kind).alias("path"), F.substring_index(kind, ".", -1).alias("ext"), _contents(kind, F.col("key"), name, text, plain_lines(text, space)).alias("content"))
    return files.withColumn("length", F.length("content").cast("long")).withColumn("modificationTime", F.timestamp_seconds(F.lit(0)))
