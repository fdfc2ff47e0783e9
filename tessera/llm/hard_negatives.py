"""Hard negatives by the threshold algorithm over sorted lists (operator 13).

Vectors become integers. Equal vectors of one label are one class, which carries its least ids: as many as an answer can use. Anchor classes meet
candidate classes in groups of a block of anchors and a shard of candidates, both of bounded size. In a group every dimension has a list of
the candidates sorted by that component. For an anchor the lists are read from the end that its component's sign favours; what comes into sight is
scored by random access; and reading stops once the threshold, which is the score that a row at the current depth of all lists would have, lies strictly below the
k-th score of every window. The shards' answers are then merged: each row of a whole answer is in its own shard's answer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, pick

#: Candidate classes of a shard and anchor classes of a block, about.
SHARD, BLOCK = 8192, 1024
#: Parts into which the anchors of one class are dealt when their answers are joined.
SALTS = 16
_LONG = 1 << 63


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, q: the rows that take part, with floor(256 x) of every component and changed labels.

    A null id, label or vector and a null or non-finite component keep a row out. Ids divisible by 7 get the label (label + 1) % 10. Rows alike in all
    three are one.
    """
    base = pick(vectors, vec_id=id_col, v=vector_col, label=label_col)
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    q = F.transform("v", lambda x: F.floor(x.cast("double") * 256.0).cast("long"))
    return base.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), q.alias("q"))


class Lists:
    """Candidates with one list a dimension, sorted by that component."""

    def __init__(self, rows: np.ndarray, first_id: np.ndarray):
        self.rows, self.first_id = rows, first_id
        self.exact = rows.astype(np.float64)
        self.largest = int(np.abs(self.exact).max()) if rows.size else 0
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.exact, self.order, 0)

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products; in double precision where every partial sum is exact, else in whole numbers, held to the range of a long."""
        if float(np.abs(anchor.astype(np.float64)).sum()) * self.largest < 2.0**53:
            return (self.exact[at] @ anchor.astype(np.float64)).astype(np.int64)
        return np.array([min(max(int(s), -_LONG), _LONG - 1) for s in self.rows[at].astype(object) @ anchor.astype(object)], np.int64) if len(at) else np.zeros(0, np.int64)

    def top(self, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, allowed: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """For each window (low, high) the k best candidates with low <= score <= high (ties: least id), their scores, and how many rows were scored."""
        n, d = self.rows.shape
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        weight = np.concatenate([anchor[up], anchor[down]]).astype(np.float64)
        seen = np.zeros(n, bool)
        at, got, depth, step = np.zeros(0, int), np.zeros(0, np.int64), 0, max(32, n // 64)
        while depth < n:
            to = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.order[n - to : n - depth, up]] = True  # descending from the end
            fresh[self.order[depth:to, down]] = True
            if not len(weight):
                fresh[:], to = True, n
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh if allowed is None else fresh & allowed)
            at, got = np.concatenate([at, new]), np.concatenate([got, self.scores(new, anchor)])
            depth = to
            if depth < n:
                # rounding must not stop too early: the sum is exact, or the margin covers its error
                bound = float(np.concatenate([self.sorted[n - depth, up], self.sorted[depth - 1, down]]) @ weight)
                bound += 0.0 if float(np.abs(weight).sum()) * self.largest < 2.0**53 else d * 2.0**-50 * float(np.abs(weight).sum()) * self.largest
                if all(bound < self._kth(got, low, high, k) for low, high in windows):
                    break
            step *= 2
        found = []
        for low, high in windows:
            inside = np.flatnonzero((got >= low) & (got <= high))
            best = inside[np.lexsort((self.first_id[at[inside]], ~got[inside]))][:k] if len(inside) else inside
            found.append(best)
        return [at[b] for b in found], [got[b] for b in found], len(at)

    @staticmethod
    def _kth(got: np.ndarray, low: int, high: int, k: int) -> float:
        """The k-th score of a window so far; its lower end while it has fewer, as nothing below that counts."""
        inside = got[(got >= low) & (got <= high)]
        return float(low) if len(inside) < k else float(np.partition(inside, len(inside) - k)[len(inside) - k])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _answers(k: int, windows_of: Callable[[pa.Table, int], list[tuple[int, int]]], same_label: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The work of a group: answers of its shard for each anchor and window."""

    def work(anchors: pa.Table, shard: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("a_cls", "window", "score", "ids")}
        if anchors.num_rows and shard.num_rows:
            a_label, label = anchors.column("a_label").to_numpy(), shard.column("label").to_numpy()
            aq, q, ids = _matrix(anchors.column("a_q")), _matrix(shard.column("q")), shard.column("ids").combine_chunks()
            first = np.array([x[0].as_py() for x in ids], np.int64)
            every, lists = np.arange(len(label)), {}
            for i, name in enumerate(anchors.column("a_cls")):
                own = int(a_label[i])
                # positives: lists of the label's rows alone; negatives: lists of all rows, of which the label's own are not scored
                key = own if same_label else None
                if key not in lists:
                    rows = np.flatnonzero(label == own) if same_label else every
                    lists[key] = (Lists(q[rows], first[rows]), rows)
                held, rows = lists[key]
                wanted = windows_of(anchors, i)
                if not wanted or not len(rows):
                    continue
                found, scores, _ = held.top(aq[i], wanted, k, None if same_label else label != own)
                for w, (places, values) in enumerate(zip(found, scores, strict=True)):
                    for p, s in zip(rows[places], values, strict=True):
                        out["a_cls"].append(name.as_py()), out["window"].append(w), out["score"].append(int(s)), out["ids"].append(ids[int(p)].as_py())
        kinds = {"a_cls": pa.string(), "window": pa.int32(), "score": pa.int64(), "ids": pa.list_(pa.int64())}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return work


def negative_window(positive: int, least: int, most: int) -> tuple[int, int]:
    """The whole scores s with least * positive <= 100 s <= most * positive; low > high where there are none."""
    return -(-least * positive // 100), most * positive // 100


def mine(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
    shard_rows: int = SHARD, block_rows: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see integer_rows for the rows that take part.

    Anchors are the rows whose id is divisible by anchor_every. A row's score is its inner product with the anchor; higher ones come first, ties by
    the smaller id. Rows of the anchor's own id are no positives. Only vectors of the anchor's length are compared; vectors without components score 0. Scores beyond a long are held to its
    range. An anchor without positives, or a positive without negatives in its window, gives no row; so do empty tables.

    A class keeps positives + 1 ids (an anchor may be one of them). A third of all rows in one class is one candidate and, as anchors, one search. Groups
    are of about block_rows anchor classes and shard_rows candidate classes; n candidates are shipped once for each block of anchors.
    """
    spark = vectors.sparkSession
    rows = integer_rows(vectors, id_col, vector_col, label_col)
    rows = rows.withColumn("cls", F.sha2(F.to_json(F.struct("label", "q")), 256))
    keyed = materialize(rows.select("vec_id", "cls").distinct(), "members")
    # the least ids of a class: the limit by rank also works before the shuffle, so a hot class sends few rows
    nth = Window.partitionBy("cls").orderBy("vec_id")
    least_ids = keyed.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= positives + 1).groupBy("cls").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    shapes = rows.groupBy("cls").agg(F.first("label").alias("label"), F.first("q").alias("q"))
    classes = materialize(shapes.join(least_ids, "cls").withColumn("d", F.size("q")), "classes")
    anchor_rows = keyed.where(F.col("vec_id") % anchor_every == 0)
    anchors = classes.join(anchor_rows.select("cls").distinct(), "cls", "left_semi").select(F.col("cls").alias("a_cls"), F.col("label").alias("a_label"), F.col("q").alias("a_q"), "d")
    anchors = materialize(anchors, "anchors")
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((classes, shard_rows), (anchors, block_rows)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = classes.withColumn("shard", part("cls", shards)).withColumn("block", every(blocks))

    def answers(asked: DataFrame, k: int, windows: Callable[[pa.Table, int], list[tuple[int, int]]], same_label: bool) -> DataFrame:
        sent = asked.withColumn("block", part("a_cls", blocks)).withColumn("shard", every(shards))
        keys = ("d", "block", "shard")
        local = sent.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_answers(k, windows, same_label), "a_cls string, window int, score long, ids array<bigint>")
        each = local.select("a_cls", "window", "score", F.explode("ids").alias("id"))
        by = Window.partitionBy("a_cls", "window").orderBy(F.desc("score"), "id")
        best = each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        return best.groupBy("a_cls", "window").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))

    everything = lambda table, i: [(-_LONG, _LONG - 1)]
    near = materialize(answers(anchors, positives + 1, everything, True).select("a_cls", "best"), "positives")
    scores = near.select("a_cls", F.sort_array(F.array_distinct(F.transform("best", lambda x: x["score"]))).alias("asked"))
    with_scores = anchors.join(scores, "a_cls")

    def by_score(table: pa.Table, i: int) -> list[tuple[int, int]]:
        return [negative_window(p, least, most) for p in table.column("asked")[i].as_py()]

    far = answers(with_scores, negatives, by_score, False)
    far = far.join(scores, "a_cls").select("a_cls", F.struct(F.element_at("asked", F.col("window") + 1).alias("positive_score"), "best").alias("w"))
    far = far.groupBy("a_cls").agg(F.collect_list("w").alias("windows"))
    told = materialize(near.join(far, "a_cls"), "answers")
    salted = told.withColumn("salt", every(SALTS))
    named = anchor_rows.select(F.col("vec_id").alias("anchor_id"), "cls", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    joined = named.join(salted, (F.col("cls") == F.col("a_cls")) & (F.col("_salt") == F.col("salt")))
    own = F.slice(F.filter("best", lambda x: x["id"] != F.col("anchor_id")), 1, positives)
    pairs = joined.select("anchor_id", "windows", F.explode(own).alias("p"))
    found = pairs.select("anchor_id", "p", F.explode(F.filter("windows", lambda w: w["positive_score"] == F.col("p.score"))).alias("w")).select("anchor_id", "p", F.explode("w.best").alias("n"))
    out = materialize(
        found.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score")),
        "negatives",
    )
    discard(keyed, classes, anchors, near, told)
    return out


#: Every anchor against all rows, in SQL.
ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
