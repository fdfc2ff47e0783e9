"""Near copies among the units of a file, at any number of units: a set-similarity join, with prefix filters for large files, then greedy selection by rounds.

Bodies compare as present.overlap() does: equal 1, contained the ratio of lengths, else Dice of trigram sets. Equal bodies of a file are one class. The classes
of a file of few units meet by its path; trigrams are made where they meet, so that texts are all that is shuffled. Those of larger files meet by
trigrams, which have one order, rare ones first. Two sets of Dice t share a trigram among the first n - ceil(n t / (2 - t)) + 1 of either; a body within another
has its first trigram there. So they meet by single trigrams of a file, never as a file, and what meets is cut by sizes and places before it is compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import present
from tessera.operators.scratch import written

OVERLAP = 0.45
#: Classes and characters of a file whose classes are compared with each other directly, at most.
FEW_CLASSES, FEW_CHARACTERS = 512, 1 << 20
#: Characters that a task of that comparison gets, about; their trigrams take eight bytes each.
DEALT_CHARACTERS = 2 << 20


def body_classes(units: DataFrame) -> DataFrame:
    """units with cls, the class of their normalized body (null counts as empty) within their path, and that body as s."""
    s = F.coalesce(present.normalized(F.col("body")), F.lit(""))
    return units.withColumn("s", s).withColumn("cls", F.unhex(F.md5(F.concat_ws("\u0000", "path", "s"))))


def near_class_pairs(classed: DataFrame, threshold: float = OVERLAP, few: int = FEW_CLASSES) -> DataFrame:
    """path, x, y, overlap: the pairs of different classes of a path whose bodies overlap by the threshold at least, x < y. Empty bodies are near to none."""
    texts = written(classed.where("s <> ''").select("path", "cls", "s").repartition("path").dropDuplicates(["path", "cls"]), "bodies")
    sizes = written(texts.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars")).withColumn("large", (F.col("n") > few) | (F.col("chars") > FEW_CHARACTERS)), "sizes")
    total, some_large = sizes.agg(F.coalesce(F.sum(F.when(~F.col("large"), F.col("chars"))), F.lit(0)), F.coalesce(F.max("large"), F.lit(False))).first()
    if not some_large:
        return _pairs_by_path(texts, threshold, 1 + total // DEALT_CHARACTERS)
    large = sizes.where("large").select("path")
    by_path = _pairs_by_path(texts.join(large, "path", "left_anti"), threshold, 1 + total // DEALT_CHARACTERS)
    return by_path.union(_pairs_by_trigrams(texts.join(large, "path", "left_semi"), threshold))


def _pairs_by_path(texts: DataFrame, t: float, tasks: int) -> DataFrame:
    """near_class_pairs() of files of few classes. Texts are dealt to so many tasks; trigrams are made there, for both sides of the join."""
    dealt = texts.repartition(tasks, "path").withColumn("g", present.trigram_codes(F.col("s")))
    one, two = (dealt.select("path", F.col("cls").alias(k), F.col("s").alias(f"s{k}"), F.col("g").alias(f"g{k}")) for k in ("x", "y"))
    n, m, a, b = F.size("gx"), F.size("gy"), F.length("sx"), F.length("sy")
    fits = (F.least(n, m) >= t / 2 * (n + m) - 1e-9) | (F.least(a, b) >= t * F.greatest(a, b) - 1e-9)
    met = one.hint("merge").join(two, "path").where((F.col("x") < F.col("y")) & fits)
    return met.select("path", "x", "y", present.overlap_ratio(F.col("sx"), F.col("sy"), F.col("gx"), F.col("gy")).alias("overlap")).where(F.col("overlap") >= t)


def _pairs_by_trigrams(bodies: DataFrame, t: float) -> DataFrame:
    """near_class_pairs() of files of any number of classes."""
    texts = written(bodies.withColumn("grams", present.trigrams(F.col("s"))), "trigrams")
    tokens = texts.select("path", "cls", F.size("grams").alias("n"), F.length("s").alias("len"), F.explode(F.transform("grams", lambda g: F.xxhash64(g))).alias("gram"))
    often = written(tokens.groupBy("gram").agg(F.count("*").alias("df")), "grams")
    ordered = tokens.join(often, "gram").groupBy("cls").agg(F.first("path").alias("path"), F.first("n").alias("n"), F.first("len").alias("len"), F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    ordered = written(ordered, "ordered")
    at_path = lambda gram: F.xxhash64("path", gram)  # noqa: E731  what meets by chance is compared in vain
    # Dice: both prefixes hold the first common trigram; from its places on, no more can follow than the shorter rest
    least = F.ceil(F.col("n") * (t / (2 - t)) - 1e-9).cast("int")
    prefix = ordered.select("path", "cls", "n", F.posexplode(F.slice("g", F.lit(1), F.col("n") - least + 1)).alias("at", "e")).select("path", "cls", "n", "at", at_path(F.col("e.gram")).alias("gram"))
    other = prefix.select(F.col("gram").alias("_gram"), F.col("cls").alias("y"), F.col("n").alias("m"), F.col("at").alias("to"))
    wanted = t / 2 * (F.col("n") + F.col("m")) - 1e-9
    met = prefix.join(other, (F.col("gram") == F.col("_gram")) & (F.col("cls") < F.col("y")))
    met = met.where((F.least("n", "m") >= wanted) & (1 + F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) - 1 >= wanted)).select("path", F.col("cls").alias("x"), "y")
    # containment: the first trigram of the shorter (of one below three characters: itself) is anywhere in the longer
    short = ordered.select("path", F.col("cls").alias("a"), "len", at_path(F.col("g")[0]["gram"]).alias("gram"))
    pieces = F.transform(F.sequence(F.lit(1), F.col("len")), lambda i: F.substring("s", i, F.lit(1)))
    doubles = F.transform(F.sequence(F.lit(1), F.greatest(F.col("len") - 1, F.lit(1))), lambda i: F.substring("s", i, F.lit(2)))
    small = texts.where(F.length("s") <= 2 / t).withColumn("len", F.length("s")).select("path", "cls", "len", F.explode(F.transform(F.array_distinct(F.concat(pieces, doubles)), lambda g: F.xxhash64(g))).alias("gram"))
    everywhere = tokens.select("path", "cls", "len", "gram").union(small).select(F.col("cls").alias("b"), F.col("len").alias("of"), at_path(F.col("gram")).alias("_gram"))
    inside = short.join(everywhere, (F.col("gram") == F.col("_gram")) & (F.col("a") != F.col("b")) & (F.col("len") <= F.col("of")) & (F.col("len") >= t * F.col("of") - 1e-9))
    candidates = met.union(inside.select("path", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))).distinct()
    one, two = (texts.select(F.col("cls").alias(k), F.col("s").alias(f"s{k}"), F.col("grams").alias(f"g{k}")) for k in ("x", "y"))
    judged = candidates.join(one, "x").join(two, "y").select("path", "x", "y", present.overlap_ratio(F.col("sx"), F.col("sy"), F.col("gx"), F.col("gy")).alias("overlap"))
    return judged.where(F.col("overlap") >= t)


def near_unit_pairs(units: DataFrame, key: str = "unit_key", threshold: float = OVERLAP) -> DataFrame:
    """path, a, b, overlap: all pairs of units of a path that overlap by the threshold, copies expanded; a < b. Empty bodies are near to none."""
    classed = written(body_classes(units).select("path", F.col(key).alias("_key"), "s", "cls"), "classed")
    pairs = near_class_pairs(classed, threshold)
    member = lambda k: classed.select(F.col("cls").alias(k), F.col("_key").alias(f"_{k}"))
    different = pairs.join(member("x"), "x").join(member("y"), "y").select("path", "_x", "_y", "overlap")
    same = classed.where("s <> ''").select("path", "cls", F.col("_key").alias("_x")).join(classed.select("cls", F.col("_key").alias("_y")), "cls").where("_x < _y").select("path", "_x", "_y", F.lit(1.0).alias("overlap"))
    return different.union(same).select("path", F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "overlap")


def drop_near_copies_at_scale(units: DataFrame, key: str = "unit_key", threshold: float = OVERLAP) -> DataFrame:
    """The units that search.drop_near_copies() keeps, for any number of units a path.

    Units are taken by falling score (ties by key); one goes if it nearly repeats a kept one of its path: by body, or by an equal label (not blank) and an equal snippet (not
    blank, white space and case aside). In each round a unit is kept if it comes before all undecided units of its class, of the classes near to its own, and of its label and snippet; then
    the others of these go. At most one unit of a class or of a label and snippet can be kept, so such groups are compared by their first, never in pairs.
    Null bodies count as empty and are near to none; keys are unique. Empty tables give empty results.
    """
    flat = F.lower(F.regexp_replace(F.coalesce("snippet", F.lit("")), r"\s+", ""))
    label = F.trim(F.coalesce("label", F.lit(""))) if "label" in units.columns else F.lit("")
    named = (label != "") & (flat != "")
    classed = body_classes(units).withColumn("_ord", F.struct((-F.col("score")).alias("score"), F.col(key).alias("key")))
    # an empty body is a class of its own
    classed = classed.withColumn("cls", F.when(F.col("s") == "", F.concat(F.col("cls"), F.col(key).cast("string").cast("binary"))).otherwise(F.col("cls")))
    classed = written(classed.withColumn("_group", F.when(named, F.sha2(F.concat_ws("\u0000", "path", label, flat), 256))).select("path", key, "s", "cls", "_group", "_ord"), "classed")
    pairs = near_class_pairs(classed, threshold)
    edges = written(pairs.select("x", "y").union(pairs.select("y", "x")), "edges")
    left, kept = classed.drop("s"), []
    while True:
        tops = left.groupBy("cls").agg(F.min("_ord").alias("_top"))
        near = edges.join(tops.select(F.col("cls").alias("y"), F.col("_top").alias("_near")), "y").groupBy("x").agg(F.min("_near").alias("_near")).withColumnRenamed("x", "_x")
        groups = left.where("_group is not null").groupBy("_group").agg(F.min("_ord").alias("_first")).withColumnRenamed("_group", "_g")
        first = left.join(tops.withColumnRenamed("cls", "_c"), (F.col("cls") == F.col("_c")) & (F.col("_ord") == F.col("_top")))
        first = first.join(near, first["cls"] == near["_x"], "left").where("_near is null or _ord < _near")
        first = first.join(groups, first["_group"] == groups["_g"], "left").where("_first is null or _ord = _first")
        taken = written(first.select(key, "cls", "_group"), "taken")
        if taken.isEmpty():
            break
        kept.append(taken)
        gone = taken.select("cls").union(edges.join(taken.select(F.col("cls").alias("x")), "x", "left_semi").select("y")).distinct()
        rest = left.join(gone, "cls", "left_anti").join(taken.where("_group is not null").select("_group").distinct(), "_group", "left_anti")
        left = written(rest, "left")
    if not kept:
        return units.limit(0)
    keys = kept[0].select(key)
    for more in kept[1:]:
        keys = keys.union(more.select(key))
    return units.join(keys, key, "left_semi")
