"""Packing tokenized documents into fixed-length sequences.

best_fit_sequences (operator 2) places every piece of the corpus by bulk-synchronous best fit; packed_matrices (operator 1) packs
shards of documents by best-fit decreasing and returns the id matrices.

Both split documents longer than a sequence losslessly into pieces, of which only the last may be shorter. Null text counts as
empty, and an empty document is its end id alone; repeated rows are packed once for each row; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import tokens
from tessera.llm.common import materialize, pick

PIECE_FIELDS = "piece int, start long, length long, ids_crc32 long"


def _schema(id_type: T.DataType, fields: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string(fields).fields])


def _cut(bounds: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, piece number and length of every piece of documents with these bounds."""
    sizes = np.diff(bounds)
    pieces = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return row, number, np.minimum(capacity, sizes[row] - number * capacity)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and the CRC-32 of the little-endian 32-bit ids of every piece."""
    path = path or tokens.default_path()
    source = pick(docs, doc_id=id_col, text=text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, bounds in tokens.documents(batch, "text", path, end_id):
                row, number, length = _cut(bounds, capacity)
                start = number * capacity
                raw = memoryview(ids.tobytes())
                at = (bounds[row] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        tokens.give_back()

    return source.mapInArrow(cut, _schema(source.schema["doc_id"].dataType, PIECE_FIELDS))


class Placement:
    """Runs of equal pieces matched to runs of sequences: the plan that the rounds below build.

    Row i: pieces of length[i] with ranks from first[i] on go to sequences from base[i] on, per[i] to each, at offset[i] onwards.
    """

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = self.rounds = 0

    def arrays(self) -> dict[str, np.ndarray]:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return dict(zip(("length", "first", "base", "per", "offset"), rows.T.copy(), strict=True))


def match_rounds(counts: dict[int, int], capacity: int) -> Placement:
    """Bulk-synchronous best fit over the run-length coded, size-sorted pieces and gaps.

    Pieces of one length are interchangeable, and so are sequences with one gap; the sorted order of all pieces is thus kept as at most
    `capacity` counts, and that of the gaps as runs of sequences, some thousand in all, however large the corpus is. Each round sweeps both sorted lists once: every run
    of pieces finds its successor, the smallest gap that holds it; where several runs want one gap, the longest rank first and
    take its sequences; the gaps shrink, and what lost goes to the next round. Pieces without a successor open new sequences:
    one for each piece above half a sequence, else as many as their tokens fill.
    """
    plan = Placement()
    left = {length: n for length, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)

    def open_new(n: int) -> None:
        gaps.setdefault(capacity, []).append((plan.sequences, n))
        plan.sequences += n

    while left:
        plan.rounds += 1
        sizes = sorted(gaps)
        lost = [x for x in left if not sizes or x > sizes[-1]]
        if lost:
            big = sum(left[x] for x in lost if 2 * x > capacity)
            open_new(big or max(1, -(-sum(x * left[x] for x in lost) // capacity)))
            sizes = sorted(gaps)
        wanted: dict[int, list[int]] = {}
        for length in sorted(left, reverse=True):
            if (i := bisect.bisect_left(sizes, length)) < len(sizes):
                wanted.setdefault(sizes[i], []).append(length)
        shrunk: list[tuple[int, tuple[int, int]]] = []
        for gap, lengths in wanted.items():
            runs = gaps.pop(gap)
            for length in lengths:
                most = gap // length
                while runs and left.get(length):
                    base, n = runs.pop()
                    per = min(most, left[length])
                    take = min(n, left[length] // per)
                    plan.rows.append((length, rank[length], base, per, capacity - gap))
                    rank[length] += take * per
                    left[length] -= take * per
                    if not left[length]:
                        del left[length]
                    if take < n:
                        runs.append((base + take, n - take))
                    if gap > per * length:
                        shrunk.append((gap - per * length, (base, take)))
            if runs:
                gaps[gap] = runs
        for gap, run in shrunk:
            gaps.setdefault(gap, []).append(run)
    return plan


def best_fit_sequences(pieces: DataFrame, capacity: int = 2048, rows_per_salt: int = 256, max_salts: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to the pieces of token_pieces().

    The lengths are counted with partial aggregation; the counts (at most `capacity` rows) steer the rounds. Every piece
    then gets its rank among those of its length: lengths are split into salts of about rows_per_salt rows (no hot length meets
    in one task; at most max_salts of a length), ranks run within a salt, and sums over the salts before it shift them. The plan
    goes to the tasks; its size depends on the capacity, not on the corpus.
    """
    pieces = materialize(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = match_rounds(counts, capacity).arrays()
    salts = {length: min(max_salts, -(-n // rows_per_salt)) for length, n in counts.items() if n > rows_per_salt}
    salt_count = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in salts.items() for x in kv)), F.col("length")), F.lit(1)) if salts else F.lit(1)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salt_count.cast("long")))
    before = (
        salted.groupBy("length", "_salt")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    ranked = salted.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in")).select(*pieces.columns, "_rank")
    names, bits = pieces.columns, 40
    keys = (plan["length"] << bits) + plan["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = np.searchsorted(keys, (length << bits) + rank, side="right") - 1
            nth = rank - plan["first"][row]
            sequence = plan["base"][row] + nth // plan["per"][row]
            offset = plan["offset"][row] + nth % plan["per"][row] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, T.StructType([*pieces.schema.fields, *T._parse_datatype_string("sequence_id long, offset long").fields]))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The sequence and offset of each piece, longest first into the fullest sequence that still holds it; how many sequences.

    A segment tree over the gaps 0..capacity marks which gaps occur, so that the smallest sufficient one is found in
    O(log capacity) steps; the sequences of one gap wait on a stack.
    """
    leaves = 1 << max(1, int(capacity).bit_length())
    tree = bytearray(2 * leaves)  # whether any gap below the node occurs
    stacks: dict[int, list[int]] = {}
    sequence, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0

    def mark(gap: int, value: int) -> None:
        node = leaves + gap
        tree[node] = value
        node >>= 1
        while node:
            now = tree[2 * node] | tree[2 * node + 1]
            if tree[node] == now:
                break
            tree[node] = now
            node >>= 1

    def successor(gap: int) -> int:
        node = leaves + gap
        if tree[node]:
            return gap
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - leaves
            node >>= 1
        return -1

    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        gap = successor(length)
        if gap < 0:
            at, gap, n = n, capacity, n + 1
        else:
            at = stacks[gap].pop()
            if not stacks[gap]:
                mark(gap, 0)
        sequence[i], offset[i] = at, capacity - gap
        if rest := gap - length:
            stack = stacks.setdefault(rest, [])
            stack.append(at)
            if len(stack) == 1:
                mark(rest, 1)
    return sequence, offset, n


MATRIX_FIELDS = "sequence_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, resets array<int>, pieces array<int>, starts array<long>"


def packed_matrices(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str | None = None, end_id: int = 0, pad_id: int = 0, shard_tokens: int = 4 << 20
) -> DataFrame:
    """One row for each packed sequence: its ids, positions and segment bounds.

    input_ids and position_ids are `capacity` little-endian 32-bit numbers (a row of the id matrix); cu_seqlens the cumulative
    segment lengths from 0 on, resets the places at which positions start again at 0; doc_ids, pieces and starts say which part
    of which document each segment is. Padding has pad_id, position 0 and no segment. Sequence ids number the shards' sequences
    within a Spark partition above its index.

    Each task packs shards of about shard_tokens tokens of its own input by itself, longest piece first into the fullest
    sequence that holds it: no shuffle, memory bounded by the shard. A shard wastes at most its last sequences.
    """
    path = path or tokens.default_path()
    source = pick(docs, doc_id=id_col, text=text_col)
    id_type = source.schema["doc_id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        made = (context.partitionId() if context else 0) << 40
        shard: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, shard, held
            owners = pa.concat_arrays([x[0] for x in shard])
            ids = np.concatenate([x[1] for x in shard])
            sizes = np.concatenate([np.diff(x[2]) for x in shard])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            row, number, length = _cut(bounds, capacity)
            start = number * capacity
            sequence, offset, n = best_fit_decreasing(length, capacity)
            order = np.lexsort((offset, sequence))
            for low in range(0, n, 256):
                high = min(n, low + 256)
                a, b = np.searchsorted(sequence[order], [low, high])
                own = order[a:b]
                seq, off, size = sequence[own] - low, offset[own], length[own]
                ends = np.cumsum(size)
                inner = np.arange(ends[-1]) - np.repeat(ends - size, size)
                flat = np.repeat(seq * capacity + off, size) + inner
                matrix, places = np.full((high - low) * capacity, pad_id, "<u4"), np.zeros((high - low) * capacity, "<u4")
                matrix[flat] = ids[np.repeat(bounds[row[own]] + start[own], size) + inner]
                places[flat] = inner
                cuts = np.searchsorted(seq, np.arange(high - low + 1))
                total = np.bincount(seq, size, high - low).astype(np.int32)
                lists = lambda values, kind, cuts=cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))
                closed = np.insert(off, cuts[1:], total)
                as_rows = lambda x: pa.array([r.tobytes() for r in x.reshape(high - low, capacity)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(made + low, made + high)), pa.array(total), as_rows(matrix), as_rows(places), lists(closed, pa.int32(), cuts + np.arange(len(cuts))), lists(off, pa.int32()), lists(number[own], pa.int32()), lists(start[own], pa.int64()), lists(owners.take(pa.array(row[own])), None)],
                    names=["sequence_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "resets", "pieces", "starts", "doc_ids"],
                )
            made, shard, held = made + n, [], 0

        for batch in batches:
            for part, ids, bounds in tokens.documents(batch, "text", path, end_id):
                shard.append((part.column("doc_id"), ids, bounds))
                held += len(ids)
                if held >= shard_tokens:
                    yield from flush()
        if shard:
            yield from flush()

    return source.mapInArrow(pack, T.StructType([*T._parse_datatype_string(MATRIX_FIELDS).fields, T.StructField("doc_ids", T.ArrayType(id_type))]))


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Writes the rows of packed_matrices() as Parquet part files, each a block of the id matrix."""
    packed_matrices(docs, **options).write.option("compression", "zstd").parquet(path)
