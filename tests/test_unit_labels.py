import random
import re

from pyspark.sql import functions as F

from tessera.functions import html, segment

WHITE = "\t\n\x0b\f\r \x85\xa0       　"


def plain_label(text, number):
    """The rule over the whole text."""
    line = re.sub(r"\A(?:#[ \t\n\x0b\f\r]*)+", "", re.split(r"\r?\n", text)[0].strip(WHITE))
    if found := re.match(rf"第[^条]*条(?:の[{segment.NUMERALS}]+)?(?:[{WHITE}]*(?:（[^）]*）|\([^)]*\)))?", line):
        if 2 <= len(found[0].strip(WHITE)) <= 40:
            return found[0].strip(WHITE)
    flat = re.sub(rf"[{WHITE}]+", " ", re.sub(r"[\n\r]", "", text)).strip(WHITE)
    return f"¶{number + 1}" if flat == "" else flat[:36] + "…" if len(flat) > 36 else flat


def test_labels_from_the_start_of_a_text_equal_those_of_the_whole(spark):
    rng = random.Random(4)
    pieces = [*WHITE, " ", "\n", "\r\n", "a", "b", "漢", "😀", "é", "word", "x" * 17]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(0, 70))) for _ in range(1500)]
    texts += ["a" * n + end for n in (35, 36, 37, 38) for end in ("", " ", "\n", " \n ", " b", "\nb", " \n", "　\n\r \n" * 50 + "c")]
    texts += ["", " " * 5000 + "a", "a" + " \n" * 5000 + "b", "😀" * 40, "## 第1条の二 （題）\nx", "#\t# 第1条\r\r\ny", " 第" + "a" * 50 + "条", "第条\r", "第一条", "第1条 (a)b", "x 第1条", "##\n第1条"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, v string")
    got = {r[0]: r[1] for r in rows.select("n", segment.unit_label(F.col("v"), F.col("n"))).collect()}
    assert [(t, got[n]) for n, t in enumerate(texts) if got[n] != plain_label(t, n)] == []


def test_a_label_is_made_once_for_a_split_block(spark):
    """Above the step that gives a block's pieces no pattern is applied, and the block's text is not carried to them."""
    files = spark.createDataFrame([("p", ["z " * 3000])], "path string, pages array<string>")
    units = segment.segment_pages(files)
    plan = units._jdf.queryExecution().optimizedPlan().toString()
    pieces = next(i for i, line in enumerate(plan.split("\n")) if "Generate posexplode" in line)
    assert "regexp" not in "\n".join(plan.split("\n")[: pieces + 1])
    assert [(r["unit_id"], len(r["text"]), r["label"], r["kind"]) for r in units.orderBy("unit_id").collect()][:2] == [(0, 1000, "z " * 18 + "…", "chunk"), (1, 1000, "z " * 18 + "…", "chunk")]


def test_white_space_is_that_of_the_sql(spark):
    """A property of characters in place of a list: the same ones."""
    code = spark.range(1, 0x11000).where("id < 55296 or id > 57343").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    of = lambda inside: {r[0] for r in code.where(F.col("c").rlike(f"[{inside}]")).select("id").collect()}
    want = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    assert of(html.SPACE) == want and of(html.LINE_SPACE) == want - {10} and of(segment.BLANKS) == want - {10, 13}
