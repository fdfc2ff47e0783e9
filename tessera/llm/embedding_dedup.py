"""Near-duplicate vectors by cross-polytope hashing (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, materialize, pick

#: Vectors of a bucket compared at once; larger buckets are dealt out in blocks.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision. They are scaled by their largest component first, so that no square over- or underflows."""
    x = vectors.astype(np.float64)
    if x.shape[1]:
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def cross_polytope_keys(vectors: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 0) -> np.ndarray:
    """int64 keys (rows, tables, 1 + probes): the bucket of each table and its most likely neighbours.

    A hash rotates by three rounds of random signs and Hadamard transforms and takes the nearest signed axis; a table joins
    `hashes` of them. Probes exchange one axis for the one that comes next nearest, smallest loss first.
    """
    n, d = vectors.shape
    vectors = unit_rows(vectors)
    size = 1 << max(0, d - 1).bit_length()
    x = np.zeros((n, size))
    x[:, :d] = vectors
    rng, every = np.random.default_rng(seed), np.arange(n)
    out = np.empty((n, tables, 1 + probes), np.int64)
    place = (2 * size) ** np.arange(hashes, dtype=np.int64)
    for t in range(tables):
        scores = []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size)) / np.sqrt(size)
            scores.append(np.concatenate([y, -y], 1))
        axes = np.stack([s.argmax(1) for s in scores], 1)
        out[:, t, 0] = axes @ place
        loss = np.concatenate([s.max(1, keepdims=True) - s for s in scores], 1)
        loss[every[:, None], axes + np.arange(hashes) * 2 * size] = np.inf
        m = min(probes, loss.shape[1] - hashes)
        near = np.argpartition(loss, m - 1, axis=1)[:, :m] if m else np.empty((n, 0), int)
        for p in range(probes):
            if p < m:
                which, axis = np.divmod(near[:, p], 2 * size)
                out[:, t, 1 + p] = out[:, t, 0] + (axis - axes[every, which]) * place[which]
            else:
                out[:, t, 1 + p] = -1  # no such probe
        for p in range(1, 1 + probes):  # a key is named once a row
            out[(out[:, t, :p] == out[:, t, p : p + 1]).any(1), t, p] = -1
    return out


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tables: int = 5, hashes: int = 3, probes: int = 4, seed: int = 0
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector.

    Vectors of one label with cosine >= threshold (in double precision) are linked if they share a bucket, which pairs at
    0.98 in 64 dimensions miss with a probability of about 0.05^5. Equal vectors collapse to one class with a weight first. Every class
    goes to its own and its probed buckets in each table. A bucket of more than BLOCK classes is dealt into blocks, each pair of blocks
    being compared by one matrix product in its own row group: no task gets a whole hot bucket. Pairs are not written:
    every row group yields each class's number of links that no earlier bucket has counted (by the keys that the rows carry), and its
    component within the group, so that the output grows with classes and blocks only.

    Vectors that are null, zero, or hold null or non-finite components, and those with a null label or id, link with nothing (a null id's component is null); so
    do vectors of different lengths. Repeated rows count as other vectors and have equal results. Empty tables give empty results.
    """
    base = pick(vectors, vec_id=id_col, v=vector_col, label=label_col)
    fine = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    base = base.withColumn("ok", fine)
    # the digest stands for the vector in the joins
    base = base.withColumn("same", F.when(F.col("ok"), F.sha2(F.to_json(F.struct("label", "v")), 256)))
    grouped = base.where("ok").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            keys = np.empty((batch.num_rows, tables * (1 + probes)), np.int64)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                found = cross_polytope_keys(flat[starts[rows][:, None] + np.arange(d)], tables, hashes, probes, seed)
                keys[rows] = found.reshape(len(rows), -1)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("same", "rep", "weight", "label", "v")), cells], names=["same", "rep", "weight", "label", "v", "keys"])

    types = {f.name: f.dataType.simpleString() for f in grouped.schema.fields}
    classes = materialize(grouped.mapInArrow(hashed, ", ".join(f"{c} {types[c]}" for c in ("same", "rep", "weight", "label", "v")) + ", keys array<bigint>"), "vectors")
    per = 1 + probes
    # buckets first: only the rows of those that hold two classes or more get their vectors
    spread = classes.select("rep", "label", F.size("v").alias("d"), F.posexplode("keys").alias("at", "key")).where("key >= 0")
    spread = spread.select("rep", "at", F.xxhash64("label", "d", F.floor(F.col("at") / per), "key").alias("cell"))
    sizes = spread.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cell").alias("_cell"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    shared = spread.join(sizes, spread["cell"] == sizes["_cell"]).drop("_cell").join(classes.select("rep", "weight", "v", "keys"), "rep")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")
    spread = shared.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "weight", "at", "v", "keys")
    pairs = spread.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def compare(rows: pa.Table) -> pa.RecordBatch:
        """Links within the row groups of whole (cell, i, j): class, links counted here, and least class of its component here."""
        rep, weight, block, at = (rows.column(c).to_numpy() for c in ("rep", "weight", "block", "at"))
        group = np.stack([rows.column(c).to_numpy() for c in ("cell", "i", "j")], 1)
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rep), tables, per)
        t, key = at // per, keys.reshape(len(rep), -1)[np.arange(len(rep)), at]
        lists = rows.column("v").combine_chunks()
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        change = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
        bounds = [0, *change.tolist(), len(rep)]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            x = unit_rows(flat[starts[a] : starts[b]].reshape(b - a, -1))
            near = np.triu(x @ x.T >= threshold, 1)
            if group[a, 1] != group[a, 2]:
                near &= block[a:b, None] != block[None, a:b]
            p, q = np.nonzero(near)
            if not len(p):
                continue
            counted = np.zeros(b - a, np.int64)
            for low in range(0, len(p), 20_000):  # a pair counts in the least bucket that both have
                pp, qq = p[low : low + 20_000], q[low : low + 20_000]
                kp, kq = keys[a + pp], keys[a + qq]
                common = (kp[:, :, :, None] == kq[:, :, None, :]).any(3) & (kp >= 0)
                table = common.any(2).argmax(1)
                every = np.arange(len(pp))
                least = np.where(common[every, table], kp[every, table], np.iinfo(np.int64).max).min(1)
                here = (table == t[a]) & (least == key[a])
                np.add.at(counted, pp[here], weight[a + qq[here]])
                np.add.at(counted, qq[here], weight[a + pp[here]])
            label = rep[a:b].copy()
            while True:
                low = np.minimum(label[p], label[q])
                before = label.copy()
                np.minimum.at(label, p, low)
                np.minimum.at(label, q, low)
                if (before == label).all():
                    break
            linked = np.unique(np.concatenate([p, q]))
            out.append((rep[a + linked], counted[linked], label[linked]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rep", "links", "low"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            last = [rows.column(c)[-1].as_py() for c in ("cell", "i", "j")]
            same = np.logical_and.reduce([rows.column(c).to_numpy() == x for c, x in zip(("cell", "i", "j"), last, strict=True)])
            cut = rows.num_rows - int(same.sum())
            if cut:
                yield compare(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield compare(held.combine_chunks())

    found = materialize(pairs.mapInArrow(stream, "rep long, links long, low long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")).where("a <> b"))
    known = classes.select(F.col("same").alias("_same"), "rep", "weight").join(links, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    known = known.select("_same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    slim = base.select("vec_id", "same")
    joined = slim.join(known, slim["same"] == known["_same"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


#: All pairs in SQL, for a table `embeddings` of a few thousand rows.
ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) n ON n.a = e.vec_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) c ON c.a = e.vec_id
"""
