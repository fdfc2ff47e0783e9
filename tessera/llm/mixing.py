"""Mixing sources to target weights by Pareto order sampling (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, pick

#: White space of a word count. Fixed value.
WORD = r"[^\x20\x09-\x0D]+"
#: Most copies of a document; what the weight of a length class (the logarithm of base 2 of the size, whole part) has above its number.
MAX_COPIES, CLASS_WEIGHT = 2, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: tuple[int, int] = (3, 2), max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target: shares of budget x all sizes by weight, each at most max_copies x its source's size.

    Sources in code point order, null last, weigh as in `weights`, again and again. A source whose share is above its limit
    gets the limit; the excess goes to the others by weight until none is above. The level of that water filling is
    found at once: sources fill up in the order of limit / weight, so running sums in this order give for every prefix of
    full sources the level that is left for the rest. One row a source: the only unsplit window is over sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    by_fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    per = (
        per.withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("rest", F.col("all_size") * budget[0] - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_copies * budget[1])
        # this source and those after it share rest / budget[1] by weight if the sources before it are full
        .withColumn("fits", F.col("rest").cast("double") * F.col("w") <= F.col("source_size").cast("double") * (max_copies * budget[1]) * F.col("rest_w"))
    )
    first = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source", "rest", "rest_w"))).over(every)
    per = per.withColumn("level", first)
    share = F.col("level.rest").cast("double") * F.col("w") / (F.col("level.rest_w") * budget[1])
    limit = (F.col("source_size") * max_copies).cast("double")
    return per.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(share, limit)).alias("target"))


def random_unit(key: Column, seed: int = 0) -> Column:
    """A uniform number in (0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def copies_by_class(per: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Expected copies of the documents of each source and length class, from source, class, words and the source's target.

    A class weighs CLASS_WEIGHT more than its number, so longer documents have higher inclusion odds. The copies are level * weight, at most max_copies, with the
    level at which they fill the target: classes are capped from the longest on, so running sums give for every set of capped ones
    the level of the others. A source has at most 64 rows here.
    """
    longer_first = Window.partitionBy("source").orderBy(F.desc("class"))
    every = Window.partitionBy("source")
    per = per.withColumn("weight", (F.col("class") + CLASS_WEIGHT).cast("double"))
    per = per.withColumn("above", F.coalesce(F.sum("words").over(longer_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("below", F.sum(F.col("weight") * F.col("words")).over(longer_first.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.col("target") - F.col("above") * max_copies) / F.col("below"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= max_copies, F.struct("class", "level"))).over(every)
    per = per.withColumn("copies", F.coalesce(F.least(level["level"] * F.col("weight"), F.lit(float(max_copies))), F.lit(float(max_copies))))
    per = per.withColumn("certain", F.floor("copies")).withColumn("p", F.col("copies") - F.col("certain"))
    return per.select("source", "class", "certain", "p", (F.col("target") - F.sum(F.col("certain") * F.col("words")).over(every)).alias("room"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    budget: tuple[int, int] = (3, 2),
    max_copies: int = MAX_COPIES,
    seed: int = 0,
    buckets: int = 1 << 12,
    keep: bool = False,
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies and taken = copies x size (with keep also the row as a struct `row`).

    A source's target is shared out as expected copies, more for longer documents (see copies_by_class). Their whole part is allocated to all of
    them (certain copies); the fraction p is the inclusion probability of one more. These come by Pareto order sampling: the rank of
    a document is its random odds u / (1 - u) over its inclusion odds p / (1 - p), and the lowest ranks are taken until their sizes
    fill the rest of the target. Of the documents beyond that point the one whose size lies closest to the room that is left is
    taken as well, if that comes nearer to the target than leaving it out: a source's taken words end within half of its largest
    document's size of the target, as long as it has documents left.

    The order is exact but no source meets in one task: ranks fall into buckets, sums by source and bucket find
    the bucket in which a source's room ends, then the rank within it, then, if several rows have this rank, the bucket of row numbers and
    the row. So ties are cut inside, however many they are. The rows are written once with their numbers.
    Null text has size 0 and is never taken; null sources form one source. Null or repeated ids draw one number each, so such rows share a rank;
    reruns then agree up to which of them are taken. Empty tables give empty results; other columns cannot clash.
    """
    row = [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if keep else []
    base = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{source_col}`"].alias("source"), word_count(docs[f"`{text_col}`"]).alias("size"), random_unit(docs[f"`{id_col}`"], seed).alias("u"), *row)
    rows = materialize(base.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    targets = materialize(source_targets(rows, weights, budget, max_copies), "targets")
    size_class = F.length(F.bin("size")) - 1
    per = rows.where("size > 0").groupBy("source", size_class.alias("class")).agg(F.sum("size").alias("words"))
    t = targets.select(F.col("source").alias("_t"), "target")
    per = per.join(t, F.col("source").eqNullSafe(F.col("_t"))).select("source", "class", "words", "target")
    shares = materialize(copies_by_class(per, max_copies), "shares")  # at most 64 rows a source
    few = _few(shares)
    small = F.broadcast if few else (lambda x: x)
    shares_named = small(shares.select(F.col("source").alias("_c"), F.col("class").alias("_class"), "certain", "p", "room"))
    targets_named = small(targets.select(F.col("source").alias("_t"), "source_size", "target"))

    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = rows.withColumn("class", F.when(F.col("size") > 0, size_class))
    ranked = ranked.join(shares_named, F.col("source").eqNullSafe(F.col("_c")) & (F.col("class") == F.col("_class")), "left").drop("_c", "_class")
    ranked = ranked.withColumn("q", F.when(F.col("p") > 0, odds)).withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * buckets).cast("int"))
    ranked = ranked.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int"))

    # narrow each source down to the first row that does not fit, level by level of the order
    order = ["bucket", "q", "salt", "rid"]
    open_rows = ranked.where("q is not null").select("source", "size", "room", *order)
    edge: DataFrame | None = None
    for k, level in enumerate(order):
        tally = open_rows.groupBy("source", level).agg(F.sum("size").alias("words"), F.max("room").alias("room"))
        tally = tally.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy(level)))
        here = tally.where("upto > room and upto - words <= room").groupBy("source").agg(F.min_by(F.struct(level, (F.col("room") - F.col("upto") + F.col("words")).alias("left")), level).alias("at"))
        here = materialize(here.select(F.col("source").alias("_e"), F.col(f"at.{level}").alias(f"_{level}"), F.col("at.left").alias("_left")), "edges")  # one row a source at most
        if k:
            edge = materialize(edge.drop("_left").join(small(here.withColumnRenamed("_e", "_e2")), F.col("_e").eqNullSafe(F.col("_e2"))).drop("_e2"), "edges")
        else:
            edge = here
        found = small(here)
        open_rows = open_rows.join(found, F.col("source").eqNullSafe(F.col("_e")) & (F.col(level) == F.col(f"_{level}"))).withColumn("room", F.col("_left")).drop("_e", "_left", f"_{level}")
    full = ranked.join(small(edge), F.col("source").eqNullSafe(F.col("_e")), "left")
    inside = F.col("_e").isNull() & F.col("_left").isNull() | (F.struct(*order) < F.struct(*(f"_{level}" for level in order)))
    full = full.withColumn("in", F.coalesce(F.col("q").isNotNull() & inside, F.lit(False)))
    # the document outside whose size comes nearest to the room left, if taking it comes nearer than leaving it
    outside = full.where("not `in` and q is not null and abs(size - _left) < _left")
    nearest = outside.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_left")), "q", "doc_id", "rid")).alias("one"))
    nearest = materialize(nearest.select(F.col("source").alias("_m"), F.col("one.rid").alias("one_rid")), "nearest")
    full = full.join(small(nearest), F.col("source").eqNullSafe(F.col("_m")), "left").join(targets_named, F.col("source").eqNullSafe(F.col("_t")), "left")
    one = F.coalesce(F.col("rid") == F.col("one_rid"), F.lit(False))
    copies = F.coalesce(F.col("certain"), F.lit(0)) + (F.col("in") | one).cast("long")
    return full.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *(["row"] if keep else []))


def _few(table: DataFrame, limit: int = 20_000) -> bool:
    """Whether a table of one row a source is small enough to broadcast."""
    return table.count() <= limit


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with the columns of docs."""
    options.setdefault("keep", True)
    out = mix(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return out.select("row.*")


#: The query's rows in SQL, for a table `documents`: the same draws, sums and order.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('0:' || doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM d GROUP BY source
), fill AS (
  SELECT *, sum(source_size) OVER () * 3 - coalesce(sum(source_size) OVER b, 0) * 4 AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest_w,
         row_number() OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS nth FROM per
  WINDOW b AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest AS level_rest, rest_w AS level_w FROM fill WHERE rest::DOUBLE * w <= source_size::DOUBLE * 4 * rest_w ORDER BY nth LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(level_rest::DOUBLE * w / (level_w * 2), (source_size * 2)::DOUBLE) END AS target
  FROM fill LEFT JOIN level ON true
), class AS (
  SELECT d.source, len(bin(size)) - 1 AS class, sum(size)::BIGINT AS words, any_value(target) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY 1, 2
), lev AS (
  SELECT *, (class + 4)::DOUBLE AS weight,
         (target - coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2)
         / sum((class + 4)::DOUBLE * words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM class
), best AS (SELECT source, arg_max(level, class) AS level FROM lev WHERE level * weight <= 2 GROUP BY 1
), share AS (
  SELECT lev.source, class, words, target, coalesce(least(best.level * weight, 2.0), 2.0) AS copies FROM lev LEFT JOIN best ON lev.source IS NOT DISTINCT FROM best.source
), part AS (SELECT source, class, floor(copies) AS certain, copies - floor(copies) AS p, target - sum(floor(copies) * words) OVER (PARTITION BY source) AS room FROM share
), q AS (
  SELECT d.*, t.source_size, t.target, coalesce(certain, 0) AS certain, room, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN part ON d.source IS NOT DISTINCT FROM part.source AND d.size > 0 AND part.class = len(bin(d.size)) - 1
), c AS (
  SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q
), i AS (SELECT *, q IS NOT NULL AND upto <= room AS inside FROM c),
f AS (SELECT source, max(room) - coalesce(max(CASE WHEN inside THEN upto END), 0) AS free FROM i GROUP BY source),
n AS (
  SELECT i.doc_id FROM i JOIN f ON i.source IS NOT DISTINCT FROM f.source WHERE NOT inside AND q IS NOT NULL AND abs(size - free) < free
  QUALIFY row_number() OVER (PARTITION BY i.source ORDER BY abs(size - free), q, i.doc_id) = 1
)
SELECT doc_id, size, source_size, target, ((certain + (inside OR doc_id IN (SELECT doc_id FROM n))::INT)::BIGINT * size)::BIGINT AS taken FROM i
"""
