import json

from tessera.functions.html import decode_html
from tessera.queries import WS
from tessera.sources import readers, samples


def test_files_read_back(spark):
    rows = spark.createDataFrame([(8 * turn + kind, "a<b", text) for kind in range(8) for turn, text in enumerate(["x & y\n\n <z>\tü", "日本 語", None, "　 \n"])], "key long, name string, text string")
    got = {r["path"]: r for r in readers.extract(samples.mixed_files(rows, WS)).collect()}
    assert len(got) == 32
    assert got["folder/0.docx"]["pages"] == ["x &amp; y\n\n&lt;z&gt; ü"] and got["folder/8.docx"]["pages"] == ["日本 語"]
    assert got["folder/16.docx"]["status"] == got["folder/24.docx"]["status"] == "skipped"
    assert got["folder/1.xlsx"]["pages"] == ["a<b\nx\t&\ty\n<z>\tü"]
    assert got["folder/17.xlsx"]["status"] == "error" and "no sheets" in got["folder/17.xlsx"]["error"]
    title = "Document {} & a<b"
    for key, rest in ((2, "\n\nx & y\n\n<z> ü"), (10, "\n\n日本 語"), (18, ""), (26, "")):
        assert got[f"folder/{key}.html"]["pages"] == [f"{title.format(key)}\n\n{title.format(key)}{rest}"]
    assert {got[f"folder/{k}"]["status"] for k in ("3.cut.docx", "11.cut.docx", "19.cut.docx", "5.txt", "21.txt")} == {"error"}
    assert {got[f"folder/{k}.pdf"]["status"] for k in (6, 14)} == {"unsupported"} and {got[f"folder/{k}.json"]["status"] for k in (7, 31)} == {"skipped"}
    assert [got[f"folder/{k}.md"]["status"] for k in (4, 12, 20)] == ["indexed", "indexed", "skipped"]
    assert readers.extract(samples.mixed_files(rows.where("false"), WS)).count() == 0


def test_html_charsets_in_turn():
    raw = [samples.html_bytes("t", ["ü"], turn) for turn in range(4)]
    assert b"\xfc" in raw[1] and b'"utf-8"' in raw[2] and raw[3][:2] in (b"\xff\xfe", b"\xfe\xff")  # Shift_JIS has no ü
    assert b'"shift_jis"' in samples.html_bytes("t", ["日"], 2)
    assert all("<p>ü</p>" in decode_html(r) for r in raw)


def test_preview_of_one_json_file(spark, tmp_path):
    text = json.dumps({"a": [1, "ü\n"]}, ensure_ascii=False, indent=1)
    (tmp_path / "one.json").write_text(text, encoding="utf-8")
    (tmp_path / "other.json").write_text("{}")
    assert [r["text"] for r in readers.preview_file(spark, str(tmp_path / "one.json")).collect()] == [text]
