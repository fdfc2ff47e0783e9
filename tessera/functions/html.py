"""HTML columns: decoding, noise removal, titles, text."""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space in Java's patterns, inside brackets: the characters of queries.WS. As a property it is one look-up for a character, where a list of them is one for each. Fixed value.
SPACE = r"\p{IsWhite_Space}"
LINE_SPACE = rf"{SPACE}&&[^\n]"
#: Elements that begin and end a block. Fixed values.
BLOCKS = (
    "address article aside blockquote body dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html li main nav ol p pre section summary table title tr ul"
).split()
#: Named character references that are decoded. Fixed values.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "mdash": "—", "ndash": "–",
    "hellip": "…", "laquo": "«", "raquo": "»", "times": "×", "divide": "÷", "yen": "¥", "euro": "€",
}


def remove_noise(html: Column) -> Column:
    """Without comments (an unclosed one stays) and script, style and noscript elements (an unclosed one takes the rest)."""
    closed = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(closed, r"(?is)<(script|style|noscript)(?=[>/\s]).*?(?:</\1\s*>|\z)", "")


def strip_tags(html: Column) -> Column:
    """Blank lines for block tags, line breaks for br and hr, nothing for others and declarations."""
    end = r"[^>]*(?:>|\z)"
    t = F.regexp_replace(html, rf"<(?i:/?(?:{'|'.join(BLOCKS)}))(?![A-Za-z0-9]){end}", "\n\n")
    t = F.regexp_replace(t, rf"<(?i:/?(?:br|hr))(?![A-Za-z0-9]){end}", "\n")
    return F.regexp_replace(t, rf"<{end}", "")


_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);"


def decode_entities(text: Column) -> Column:
    """The text with its references decoded: those of ENTITIES, and numeric ones that name a character; others stay.

    The text is split once into references and what is between them, so nothing that a reference yields is read again.
    """
    between, references = F.split(text, _REFERENCE), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    named = F.create_map(*(F.lit(x) for name, char in ENTITIES.items() for x in (f"&{name};", char)))

    def decoded(ref: Column) -> Column:
        code = F.regexp_extract(ref, r"^&#(.*);$", 1)
        number = F.when(code.rlike("^[xX]"), F.conv(F.substr(code, F.lit(2)), 16, 10)).otherwise(code).try_cast("long")
        fits = (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        # a code point's four big-endian bytes are its UTF-32 form
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.coalesce(F.when(code == "", F.try_element_at(named, ref)).when(fits, char), ref)

    pairs = F.zip_with(between, F.transform(references, decoded), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(pairs, "")


def collapse_whitespace(text: Column) -> Column:
    """Single spaces within lines, at most one blank line, no space at line or text ends."""
    t = F.replace(text, F.lit("\r"), F.lit(""))
    t = F.regexp_replace(t, rf"[{LINE_SPACE}]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n(?:\n)+", "\n\n")
    return F.regexp_replace(t, r"\A[ \n]+|[ \n]+\z", "")


def html_title(html: Column) -> Column:
    """The first title element's text; null where there is none or it is empty."""
    inner = F.regexp_extract(remove_noise(html), r"(?is)<title[^>]*>(.*?)</title", 1)
    text = collapse_whitespace(decode_entities(F.regexp_replace(inner, r"<[^>]*(?:>|\z)", "")))
    return F.when(text != "", F.regexp_replace(text, r"\s+", " "))


def html_text(html: Column) -> Column:
    return collapse_whitespace(decode_entities(strip_tags(remove_noise(html))))


def paragraphs(text: Column) -> Column:
    """Trimmed, non-empty paragraphs between blank lines."""
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, rf"\A[{SPACE}]+|[{SPACE}]+\z", ""))
    return F.filter(parts, lambda p: p != "")


def mail_body(plain: Column, html: Column) -> Column:
    """The trimmed plain body, or where that is empty the text of the HTML one."""
    return F.coalesce(F.nullif(F.regexp_replace(plain, rf"\A[{SPACE}]+|[{SPACE}]+\z", ""), F.lit("")), html_text(html), F.lit(""))


_DECLARED = (
    re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I),
    re.compile(rb"<meta[^>]+content\s*=\s*[\"'][^\"'>]*charset\s*=\s*([\w.:-]+)", re.I),
    re.compile(rb"<\?xml[^>]+encoding\s*=\s*[\"']([\w.:-]+)", re.I),
)
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decode_html(content: bytes) -> str:
    """Text of an HTML file: by byte order mark, declared charset, valid UTF-8, clean Shift_JIS, else windows-1252."""
    for mark, name in _MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    for pattern in _DECLARED:
        if found := pattern.search(content[:4096]):
            name = found[1].decode("ascii").lower()
            name = {"shift_jis": "cp932", "x-sjis": "cp932", "iso-8859-1": "cp1252", "latin1": "cp1252"}.get(name, name)
            try:
                return content.decode(name, "replace")
            except LookupError:
                break
    for name in ("utf-8", "cp932"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            pass
    return content.decode("cp1252", "replace")


@F.udf(T.StringType(), useArrow=False)
def decode_html_column(content: bytes | None) -> str | None:
    """decode_html() over a binary column. A plain function: whole files come a hundred at once, not 10,000 as in an Arrow batch."""
    return None if content is None else decode_html(bytes(content))
