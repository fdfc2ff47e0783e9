"""WARC archives: writing captures, reading archives back, and assembling transactions (operator 9)."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, pick, scratch_path

VERSION, END = b"WARC/1.1", b"\r\n\r\n"
#: One date for all records: reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: More than the headers of a capture's three records have, without their urls.
HEADERS = 2048
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, page_id long, warc_date string, header_digest string, payload_digest string, payload_bytes long, block_bytes long, fields string"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(kind: str, page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{digest}')}>"


def _record(kind: str, record_id: str, fields: dict[str, object], block: bytes) -> bytes:
    """A record without its closing blank lines."""
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, **{k: v for k, v in fields.items() if v is not None}, "Content-Length": len(block)}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items())]
    return b"\r\n".join(lines) + END + block


def _uri(url: str | None) -> str | None:
    """A url as a header value: line breaks and other control characters are escaped."""
    return None if url is None else "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)


def capture_records(page_id: int | None, url: str | None, payload: bytes, first: int | None, digest: str) -> list[bytes]:
    """Request, response (or revisit of the capture `first`) and metadata of one capture, the outer two concurrent to the inner."""
    target = _uri(url)
    main = _urn("response", page_id, digest)
    common = {"WARC-Target-URI": target, "X-Page-ID": page_id}
    path = "/" + (target or "").partition("://")[2].partition("/")[2].partition("#")[0].replace(" ", "%20")
    host = (target or "").partition("://")[2].partition("/")[0]
    request = f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    fields = common | {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if first is None or first == page_id:
        body = _record("response", main, fields, HTTP_HEAD % len(payload) + payload)
    else:
        body = _record("revisit", main, fields | {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _urn("response", first, digest)}, HTTP_HEAD % len(payload))
    return [
        _record("request", _urn("request", page_id, digest), common | {"WARC-Concurrent-To": main, "Content-Type": "application/http; msgtype=request"}, request),
        body,
        _record("metadata", _urn("metadata", page_id, digest), common | {"WARC-Concurrent-To": main, "Content-Type": "application/warc-fields"}, f"payload-length: {len(payload)}\r\n".encode()),
    ]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, file_bytes: int = 1 << 29) -> None:
    """Writes three records per row as gzip-compressed WARC files, one or more for each task.

    Of rows whose payloads (null: empty) are equal and at least least_bytes long, that with the smallest id becomes a response, the others revisits.
    Spark finds it by a grouped minimum per payload digest with partial aggregation and joins it back; a payload that
    many rows share can be split by Spark's handling of skewed joins. The records go to the text sink, whose line separator is the
    blank lines that end a record; a failed task's file is never committed. Captures are written by classes of their size, so that no file
    has more than file_bytes before compression (or one capture): a reader can hold any file.
    """
    base = pick(pages, page_id=id_col, url=url_col, html=payload_col)
    base = base.select(F.col("page_id").cast("long"), F.col("url").cast("binary"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    first = base.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, payload, digest, first_id in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                own = base64.b32encode(bytes.fromhex(digest)).decode()
                out += capture_records(page_id, None if url is None else url.decode("utf-8", "replace"), payload, None if page_id is None else first_id, own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    size = F.octet_length("payload") + F.coalesce(F.octet_length("url"), F.lit(0)) * 4 + HEADERS
    scale = F.ceil(F.log2(size.cast("double")) / 4).cast("int")
    used = [r[0] for r in base.select(scale.alias("scale")).groupBy("scale").count().orderBy("scale").collect()]
    for k in used or [0]:
        rows = base.where(scale == k).join(first, "digest", "left").mapInArrow(render, "value binary")
        captures = max(1, file_bytes >> 4 * k)
        # a cast to string keeps the bytes as they are
        rows.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * captures).mode("append").text(path)


def _unpacked(content: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """Uncompressed stretches of a file of gzip members (or of plain bytes)."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for at in range(0, len(content), step):
            yield bytes(content[at : at + step])
        return
    at, z = 0, zlib.decompressobj(wbits=31)
    while at < len(content) or not z.eof:
        piece = bytes(content[at : at + step])
        if not piece:
            break
        yield z.decompress(piece)
        at += len(piece)
        while z.eof and z.unused_data:
            rest, z = z.unused_data, zlib.decompressobj(wbits=31)
            yield z.decompress(rest)


def parse_records(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each record; blocks are delimited by Content-Length alone."""
    source, held = _unpacked(content), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    at = 0
    while True:
        while (end := held.find(END, at)) < 0:
            more = next(source, None)
            if more is None:
                return
            held.extend(more)
        head = bytes(held[at:end]).lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            at = end + 4
            continue
        fields: dict[str, str] = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields.get("content-length", 0))
        if not fill(end + 4 + size):
            return  # a cut-off record at the end of a damaged file
        yield fields, bytes(held[end + 4 : end + 4 + size])
        at = end + 4 + size
        if at > 1 << 22:
            del held[:at]
            at = 0


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives below path; digests and lengths are computed from the bytes read."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = RECORD_SCHEMA + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if x.endswith(" long") else pa.binary() if x.endswith(" binary") else pa.string() for x in schema.split(", ")]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for f, block in parse_records(memoryview(content.as_buffer())):
                    kind = f.get("warc-type")
                    payload = block.partition(END)[2] if f.get("content-type", "").startswith("application/http") else block
                    page = f.get("x-page-id")
                    row = (f.get("warc-record-id"), kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), int(page) if page else None, f.get("warc-date"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None)
                    row += (base32_sha1(payload), len(payload), len(block), block.decode("utf-8", "replace") if kind == "metadata" else None)
                    rows.append((*row, payload) if with_payload else row)
                    if len(rows) >= 4096:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    return files.mapInArrow(parse, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, and the nested request, response (or revisit) and metadata records.

    Requests and metadata name their capture by WARC-Concurrent-To; responses and revisits are their own. A capture's records meet by
    grouping on this id with bounded state: of several records of one kind (repeated input rows) one is kept and
    `copies` counts the main records. Captures without a main record have a null response and no copies.
    """
    main = F.col("type").isin("response", "revisit")
    fields = F.struct(*(F.col(c) for c in records.columns))
    of = lambda cond, name: F.max(F.when(cond, fields)).alias(name)
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        of(F.col("type") == "request", "request"), of(main, "response"), of(F.col("type") == "metadata", "metadata"), F.count_if(main).alias("copies")
    )


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the archives, reads them back and returns page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, digest_ok.

    A response's digest and length are computed from the bytes read back, a revisit's are its header's digest and its
    metadata's payload length; refers_to is the page of the response that its WARC-Refers-To names, found by a join. Repeated rows give repeated
    results; null ids become responses of their own; null payloads are empty; empty tables give empty results.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    records = materialize(read_records(spark, path), "records")  # parsed once
    captures = assemble(records).where("copies > 0")
    r = F.col("response")
    revisit = r["type"] == "revisit"
    length = F.regexp_extract("metadata.fields", r"payload-length: (\d+)", 1).try_cast("long")
    slim = captures.select(
        r["page_id"].alias("page_id"), F.when(revisit, length).otherwise(r["payload_bytes"]).alias("payload_bytes"), F.when(revisit, r["header_digest"]).otherwise(r["payload_digest"]).alias("payload_digest"),
        r["type"].alias("record_type"), r["refers_to"].alias("_refers"), r["target_uri"].alias("target_uri"), (revisit | (r["header_digest"] == r["payload_digest"])).alias("digest_ok"), "capture_id", "copies",
    )
    responses = records.where("type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to")).distinct()
    joined = slim.join(responses, slim["_refers"] == responses["_id"], "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "digest_ok", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


#: The same digests in SQL, for a table `pages`; base 32 of the SHA-1 comes five bits at a time.
ORACLE = r"""
WITH base AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload FROM pages),
hashed AS (SELECT page_id, target_uri, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS hex FROM base),
bits AS (SELECT hex, list_aggregate(list_transform(range(1, 41), lambda i: (('0x' || hex[i])::INT::BIT::VARCHAR)[-4:]), 'string_agg', '') AS b FROM (SELECT DISTINCT hex FROM hashed)),
coded AS (SELECT hex, list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 +
  16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT]), 'string_agg', '') AS payload_digest FROM bits),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, target_uri, true AS digest_ok
FROM firsts JOIN coded USING (hex)
"""
