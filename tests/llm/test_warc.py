import base64
import gzip
import hashlib

from tessera.llm import warc

ROWS = [
    (3, "http://a/x", "<p>same</p>", "u"), (1, "http://a/y?q#f", "<p>same</p>", None), (2, None, None, ""), (7, "http://b\r\nX: 1", "", "v"), (4, "http://c", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n", "w"), (5, "http://d", "é" * 90000, "w"), (5, "http://d", "é" * 90000, "w"), (None, "http://e", "no id", "w"), (9, "http://f", "<p>same</p>", "u"),
]
SCHEMA = "page_id long, url string, html string, digest string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = sorted(map(tuple, warc.archive_pages(pages, str(tmp_path / "w"), file_bytes=1 << 13).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok").collect()), key=str)
    first = {}
    for page_id, _, html, _ in ROWS:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    want = []
    for page_id, _, html, _ in ROWS:
        f = page_id if page_id is None else first[html or ""]
        want.append((page_id, len((html or "").encode()), digest(html), "response" if f == page_id else "revisit", None if f == page_id else f, True))
    assert got == sorted(want, key=str)
    files = list((tmp_path / "w").glob("part-*"))
    assert len(files) >= 3
    records = [r for f in files for r in warc.parse_records(memoryview(f.read_bytes()))]
    assert len(records) == 3 * len(ROWS)
    assert {r[0]["warc-type"] for r in records} == {"request", "response", "revisit", "metadata"}
    plain = gzip.decompress(files[0].read_bytes())
    assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")


def test_large_pages_have_their_own_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://a", chr(97 + i) * (3_000_000 if i == 3 else 100)) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), file_bytes=1 << 14)
    sizes = sorted(len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").glob("part-*"))
    assert sizes[-1] > 3_000_000 and all(n <= 1 << 14 for n in sizes[:-1]) and len(sizes) > 2


def test_small_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    got = warc.archive_pages(pages, str(tmp_path / "w"), least_bytes=12).where("record_type = 'revisit'")
    assert got.count() == 0


def test_assembly_nests_the_records(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(ROWS[:4], SCHEMA), str(tmp_path / "w"))
    rows = warc.assemble(warc.read_records(spark, str(tmp_path / "w"), with_payload=True)).collect()
    assert len(rows) == 4
    for r in rows:
        assert r["request"]["concurrent_to"] == r["metadata"]["concurrent_to"] == r["response"]["record_id"] == r["capture_id"]
        assert r["metadata"]["fields"].startswith("payload-length: ") and r["copies"] == 1
    assert any(bytes(r["response"]["payload"]) == b"<p>same</p>" for r in rows)


def test_members_and_damage():
    one = b"\r\n\r\n".join(warc.capture_records(1, "http://a", b"x" * 50, None, digest("x"))) + b"\r\n\r\n"
    members = gzip.compress(one) + gzip.compress(one)
    assert len(list(warc.parse_records(memoryview(members)))) == 6
    assert len(list(warc.parse_records(memoryview(one[:-70])))) == 2
    assert list(warc.parse_records(memoryview(b""))) == []


def test_empty_table(spark, tmp_path):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA), str(tmp_path / "w")).count() == 0
