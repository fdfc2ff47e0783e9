"""Near-duplicate documents by order MinHash and banded alignment (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import connected_components, discard, materialize, pick, spare_names
from tessera.llm.tokens import give_back, power_tables, slices, text_bytes

#: Words of a k-mer, k-mers of a sketch, sketches; least similarity.
K, ORDERED, SKETCHES, SIMILARITY = 5, 2, 64, 0.8
#: Rounds of pivots; members and words of a block of a bucket; bins of a block's word counts.
PIVOTS, MEMBERS, WORDS, BINS = 2, 2048, 1 << 20, 128
#: Longer sequences are first aligned by furthest-reaching points up to so many edits; bits that a band's table of occurrences may have.
LONG, STEPS, TABLE_BITS = 1 << 13, 2000, 1 << 32

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint32(0x85EBCA6B)
#: Letters and digits in lower case; white space becomes a space; all other ASCII bytes are dropped.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))
_DROPPED = bytes(b for b in range(128) if not chr(b).isalnum() and b not in b" \t\n\v\f\r")
_NOT_WORD = r"[^\x00-\x7F\pL\pN\pM]+"


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit numbers: every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, without what is no letter, mark or digit, and each text's bounds.

    Words end at ASCII white space. A word's hash is a polynomial of its bytes, taken from running sums over all bytes of the slice.
    """
    texts = pc.fill_null(texts, "")
    raw, bounds = text_bytes(texts)
    if len(raw) and raw.max() > 127:
        raw, bounds = text_bytes(pc.replace_substring_regex(pc.utf8_lower(texts), _NOT_WORD, ""))
    whole = raw.tobytes()
    clean = [whole[a:b].translate(_FOLD, _DROPPED) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    # one space after each text ends its last word
    x = np.frombuffer(b" ".join(clean) + b" ", np.uint8)
    text_ends = np.cumsum(np.fromiter(map(len, clean), np.int64, len(clean)) + 1)
    if not len(clean):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    space = np.flatnonzero(x == 32)
    powers, inverses = power_tables(len(x))
    sums = np.cumsum(x * powers)
    starts = np.concatenate([[0], space[:-1] + 1])
    used = space > starts
    a, b = starts[used], space[used]
    hashes = (sums[b - 1] - np.where(a > 0, sums[a - 1], np.uint64(0))) * inverses[a]
    upto = np.concatenate([[0], np.cumsum(used)])
    return mix(hashes + (b - a).astype(np.uint64)), upto[np.concatenate([[0], np.searchsorted(space, text_ends - 1) + 1])]


def kmers(words: np.ndarray, bounds: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled hashes of all runs of k words, and each text's bounds. A shorter text is one k-mer; one without words none."""
    sizes = np.diff(bounds)
    n = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(n)])
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    rolled = np.zeros(len(words) + 1, np.uint64)
    for j in range(k):
        rolled[:-1] += padded[j : j + len(words)] * factors[j]
    runs = rolled[np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], n)]
    for i in np.flatnonzero((sizes > 0) & (sizes < k)).tolist():
        runs[ends[i]] = (words[bounds[i] : bounds[i + 1]] * factors[: sizes[i]]).sum(dtype=np.uint64)
    runs = mix(runs)
    # label the occurrences of equal k-mers of a text in text order; few k-mers occur twice
    scoped = runs ^ np.repeat(mix(np.arange(len(sizes), dtype=np.uint64) * _MIX + np.uint64(1)), n)
    ordered = np.sort(scoped)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        again = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, scoped), len(twice) - 1)] == scoped)
        order = again[np.argsort(scoped[again], kind="stable")]
        same = np.concatenate([[False], scoped[order][1:] == scoped[order][:-1]])
        i = np.arange(len(order))
        nth = (i - np.maximum.accumulate(np.where(same, 0, i))).astype(np.uint64)
        runs[order] = np.where(nth > 0, mix(runs[order] + nth * _MIX), runs[order])
    return runs, ends


def sketches(runs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order MinHash of each text (rows, SKETCHES): the ORDERED least k-mers under each hash function, hashed in text order. 0: no k-mer.

    Each hash value carries its place in its low half, so that one grouped minimum finds both; taking that place out, the next minimum follows.
    """
    out = np.zeros((len(ends) - 1, SKETCHES), np.uint64)
    full = np.flatnonzero(np.diff(ends))
    if not len(full):
        return out
    starts, sizes = ends[:-1][full], np.diff(ends)[full]
    x, place = (runs >> np.uint64(32)).astype(np.uint32), np.arange(len(runs), dtype=np.uint64)
    factors = (mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _MIX) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low, none = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF)
    at = np.empty((ORDERED, len(full)), np.uint64)
    for s in range(SKETCHES):
        g = x * factors[s]
        g ^= g >> np.uint32(16)
        g *= _ODD
        placed = g.astype(np.uint64)
        placed <<= np.uint64(32)
        placed |= place
        for i in range(ORDERED):
            least = np.minimum.reduceat(placed, starts) & low
            at[i] = np.where(sizes > i, least, low)
            placed[least[sizes > i].astype(np.int64)] = none
        key = np.full(len(full), s + 1, np.uint64)
        for p in np.sort(at, axis=0):
            known = p != low
            key = np.where(known, mix(key * _MIX + runs[np.where(known, p, 0).astype(np.int64)]), key)
        out[full, s] = key | np.uint64(1)
    return out


def within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two sequences if it is at most `most`, else -1: an alignment within a band of `most` diagonals either way.

    Common ends are taken off first; runs of one to three items that only one side has give lower bounds that spare most alignments. The band is
    kept in the bits of integers, column by column. Beyond LONG items furthest-reaching points come first, with memory for the length
    and time for the square of the distance alone: near copies of a million words take a second.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return -1
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    pre = int(differ[0]) if len(differ) else k
    a, b, k = a[pre:], b[pre:], k - pre
    differ = np.flatnonzero(a[len(a) - k :] != b[len(b) - k :])
    suf = k - 1 - int(differ[-1]) if len(differ) else k
    a, b = a[: len(a) - suf], b[: len(b) - suf]
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return max(n, m) if max(n, m) <= most else -1
    _, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    kinds = int(code.max()) + 1
    one, two = code[:n].astype(np.int64), code[n:].astype(np.int64)
    for k in (1, 2, 3):  # an edit breaks k runs of k items at most
        if k > 1:
            one, two = one[:-1] * kinds + code[k - 1 : n], two[:-1] * kinds + code[n + k - 1 :]
        if max(n, m) - k + 1 - k * most > _shared(one, two):
            return -1
    a, b, most = code[:n], code[n:], min(most, max(n, m))
    if min(n, m) > LONG:
        d = _furthest(a, b, min(most, STEPS))
        if d >= 0 or most <= STEPS or kinds * n > TABLE_BITS:
            return d if d >= 0 or most <= STEPS else _furthest(a, b, most)
    return _in_band(a.tolist(), b.tolist(), most)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many items two sequences have in common, occurrences counted."""
    if not len(a) or not len(b):
        return 0
    (x, nx), (y, ny) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int(np.where(x[at] == y, np.minimum(nx[at], ny), 0).sum())


def _in_band(a: list[int], b: list[int], most: int) -> int:
    """Bit-parallel banded alignment: bit t of a column j stands for row j - most + t; the band slides down a row with each column.

    The bits hold whether a cell is one more or one less than that above it. The distance is followed along the band's lowest diagonal to the last
    row, then along that row.
    """
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > most:
        return -1
    occurs: dict[int, int] = {}
    for i, x in enumerate(a):
        occurs[x] = occurs.get(x, 0) | 1 << i
    width = (1 << 2 * most + 1) - 1
    up, down = width >> most << most, 0  # rows from 1 on grow by one
    distance, slack = min(most, n), most + m - max(0, n - most)
    for j in range(1, m + 1):
        # bit t of match: whether row j - most + t, item j - most + t - 1 of a, equals b's item
        match = occurs.get(b[j - 1], 0)
        shift = j - most - 1
        match = (match >> shift if shift >= 0 else match << -shift) & width
        diagonal = (((match & up) + up) ^ up) | match | down
        plus, minus = down | ~(diagonal | up), diagonal & up
        if j <= n - most:
            distance += 1 - (diagonal >> 2 * most & 1)
            if distance > slack:
                return -1
        else:
            t = n - j + most
            distance += (plus >> t & 1) - (minus >> t & 1)
        diagonal = (diagonal & width) >> 1
        up, down = (minus | ~(diagonal | plus)) & width, diagonal & plus & width
    return distance if distance <= most else -1


def _furthest(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance if it is at most `most`, else -1: for each distance the furthest point of every diagonal that it reaches.

    Runs of equal items are followed by doubling steps over prefix hashes, on all diagonals at once.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return -1
    powers, inverses = power_tables(max(n, m) + 1)
    hash_a, hash_b = (np.concatenate([[np.uint64(0)], np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * powers[: len(x)])]) for x in (a, b))

    def follow(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many items are equal from places x of a and y of b on."""
        room = np.minimum(n - x, m - y)
        length, step = np.zeros_like(x), 1
        live = np.arange(len(x))
        growing = True
        while len(live):
            xs, ys = x[live] + length[live], y[live] + length[live]
            fits = length[live] + step <= room[live]
            to = np.where(fits, step, 0)
            equal = fits & ((hash_a[xs + to] - hash_a[xs]) * inverses[xs] == (hash_b[ys + to] - hash_b[ys]) * inverses[ys])
            length[live[equal]] += step
            if growing and equal.any():
                # those that failed are done growing; they search on below
                step *= 2
                continue
            growing = False
            step //= 2
            if step == 0:
                break
        return length

    goal = n - m
    diagonals = np.array([0])
    far = follow(np.array([0]), np.array([0]))
    for d in range(most + 1):
        hit = np.flatnonzero(diagonals == goal)
        if len(hit) and far[hit[0]] >= n:
            return d
        low, high = max(-m, -(d + 1), goal - (most - d - 1)), min(n, d + 1, goal + (most - d - 1))
        if low > high:
            return -1
        new = np.arange(low, high + 1)
        known = np.full(len(new) + 4, -2, np.int64)  # places of diagonals low - 2 .. high + 2
        inside = (diagonals >= low - 2) & (diagonals <= high + 2)
        known[diagonals[inside] - (low - 2)] = far[inside]
        # place x on diagonal x - y: from above (insert), the same (substitute), below (delete)
        x = np.maximum(np.maximum(known[3:-1], known[2:-2] + 1), known[1:-3] + 1)
        x = np.minimum(np.minimum(x, n), m + new)
        ok = (x >= 0) & (x - new >= 0) & (x >= np.maximum(0, new))
        new, x = new[ok], x[ok]
        far = x + follow(x, x - new)
        diagonals = new
    return -1


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """1 - edit distance / longer length of two word sequences, or -1 where that is under `least`."""
    longer = max(len(a), len(b))
    if not longer:
        return -1.0
    d = within(a, b, int(longer * (1 - least) + 1e-9))
    return -1.0 if d < 0 else 1 - d / longer


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two word sequences are within a fifth of the longer one: where most words stand in the same places, no alignment is needed."""
    if len(a) == len(b) > 0 and np.count_nonzero(a != b) <= int(len(a) * (1 - SIMILARITY) + 1e-9):
        return True
    return similarity(a, b) >= 0


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the whole text, number of words, sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                words, bounds = word_hashes(part.column("text"))
                found = sketches(*kmers(words, bounds))
                cells = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * SKETCHES, pa.int32()), pa.array(found.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(np.diff(bounds)), cells], names=["doc_id", "digest", "n_words", "sketch"])
        give_back()

    fields = T._parse_datatype_string("n_words long, sketch array<bigint>").fields
    return docs.select("doc_id", "digest", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], docs.schema["digest"], *fields]))


def _encoded(docs: DataFrame) -> DataFrame:
    """digest of each text and its words as 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                words, bounds = word_hashes(part.column("text"))
                small = (words >> np.uint64(32)).astype("<u4")
                raw = [small[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(raw, pa.binary())], names=["digest", "words"])
        give_back()

    return docs.select("digest", "text").mapInArrow(run, "digest binary, words binary")


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are alike."""
    one = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    two = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [alike(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")) for x, y in zip(batch.column("wa"), batch.column("wb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(seen, pa.bool_()))
        give_back()

    return pairs.join(one, "a").join(two, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def _group_links(words: list[np.ndarray], label: np.ndarray, keys: np.ndarray, at: np.ndarray, home: np.ndarray, block: np.ndarray, crossed: bool) -> list[tuple[int, int]]:
    """Pairs of members of one group that are alike and join all classes which such pairs join.

    Members of different classes whose lengths are within a fifth compare in the first sketch that both share (keys; at is this one's number).
    What shares fewer words in a table of BINS counts than a link leaves is not aligned: the counts bound the shared words from above.
    Two guests do not compare (they do at home), nor two members of one block where the group is a crossing of two.
    """
    sizes = np.array([len(w) for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(owner * BINS + np.concatenate(words) % BINS, minlength=len(words) * BINS).reshape(-1, BINS)
    counts = counts.astype(np.uint8 if counts.max() < 256 else np.int32)
    root = {c: c for c in label.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for low in range(0, len(words), 256):
        p = slice(low, low + 256)
        longer = np.maximum(sizes[p, None], sizes[None, low:])
        differ = (label[p, None] != label[None, low:]) & (home[p, None] | home[None, low:]) & (np.arange(low, low + len(longer))[:, None] < np.arange(low, len(words))[None])
        differ &= np.minimum(sizes[p, None], sizes[None, low:]) >= longer - (longer * (1 - SIMILARITY) + 1e-9).astype(np.int64)
        if crossed:
            differ &= block[p, None] != block[None, low:]
        ones, others = np.nonzero(differ)
        for start in range(0, len(ones), 1 << 16):
            x, y = ones[start : start + (1 << 16)] + low, others[start : start + (1 << 16)] + low
            most = np.maximum(sizes[x], sizes[y])
            fits = np.minimum(counts[x], counts[y]).sum(1, dtype=np.int64) >= most - (most * (1 - SIMILARITY) + 1e-9).astype(np.int64)
            x, y = x[fits], y[fits]
            first = (keys[x] == keys[y]).argmax(1) == at[x]
            for i, j in zip(x[first].tolist(), y[first].tolist(), strict=True):
                a, b = top(int(label[i])), top(int(label[j]))
                if a != b and alike(words[i], words[j]):
                    root[a] = b
                    out.append((i, j))
    return out


GROUP = ("key", "g", "i", "j")


def _across(rows: DataFrame) -> DataFrame:
    """a, b: classes that links join, from the members (home, block, at, class, sketch, words) of groups key, g, i, j."""

    def compare(table: pa.Table) -> pa.RecordBatch:
        key = np.stack([table.column(c).to_numpy() for c in GROUP], 1)
        block, at, label = (table.column(c).to_numpy() for c in ("block", "at", "class"))
        home = table.column("home").to_numpy()
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES).astype(np.int32)
        words = [np.frombuffer(w.as_buffer(), "<u4") for w in table.column("words")]
        change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        one, two = [], []
        for a, b in zip([0, *change.tolist()], [*change.tolist(), len(key)], strict=True):
            for x, y in _group_links(words[a:b], label[a:b], sketch[a:b], at[a:b], home[a:b], block[a:b], bool(key[a, 2] != key[a, 3])):
                one.append(label[a + x])
                two.append(label[a + y])
        return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            last = np.logical_and.reduce([(x := table.column(c).to_numpy()) == x[-1] for c in GROUP])
            cut = table.num_rows - int(last.sum())
            if cut:
                yield compare(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield compare(held)
        give_back()

    dealt = rows.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.select(*GROUP, "block", "at", "class", "home", "sketch", "words").mapInArrow(run, "a long, b long")


def _groups(members: DataFrame) -> DataFrame:
    """Deals the members (key, at, node, n, class) of buckets that hold several classes into groups g of blocks i, j; see near_duplicates."""
    big = (F.col("size") > MEMBERS) | (F.col("words") > WORDS)
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("words"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    buckets = sizes.select(F.col("key").alias("_key"), big.alias("big"))
    # lengths within a fifth are in one range or in neighbouring ones
    span = F.when(F.col("big"), F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.2501))).cast("int")).otherwise(F.lit(-1))
    dealt = members.join(buckets, F.col("key") == F.col("_key")).drop("_key").withColumn("span", span)
    dealt = dealt.withColumn("g", F.explode(F.when(F.col("big"), F.array("span", F.col("span") + 1)).otherwise(F.array("span")))).withColumn("home", F.col("g") == F.col("span"))
    groups = dealt.groupBy("key", "g").agg(
        F.count("*").alias("size"), F.sum("n").alias("words"), F.max("home").alias("home"), F.min("class").alias("low"), F.max("class").alias("high")
    ).where("home and low < high")
    blocks = F.ceil(F.greatest(F.col("size") / MEMBERS, F.col("words") / WORDS)).cast("int")
    groups = groups.select(F.col("key").alias("_key"), F.col("g").alias("_g"), blocks.alias("blocks"))
    dealt = dealt.join(groups, (F.col("key") == F.col("_key")) & (F.col("g") == F.col("_g")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", "g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "at", "node", "class", "home")


def _alike_lengths(n: str, m: str):
    return F.least(n, m) >= F.greatest(n, m) * (SIMILARITY - 1e-9)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of docs (doc_id, digest), and for each digest its class's least doc_id and the text that stays (class_id, stays)."""
    all_rows = materialize(_sketched(docs), "sketches")
    texts = all_rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_words").alias("n"), F.first("sketch").alias("sketch"))
    # written once: the numbers stand for the texts from here on
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    spread = texts.where("n > 0").select("node", "n", F.posexplode("sketch").alias("at", "value")).select("node", "n", "at", F.xxhash64("at", "value").alias("key"))
    # counts are written before they are joined, here and below: Spark splits a skewed join only where both sides come from a shuffle
    shared_keys = materialize(spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select(F.col("key").alias("_key")), "keys")
    shared = materialize(spread.join(shared_keys, F.col("key") == F.col("_key")).drop("_key"), "buckets")
    # always by a shuffle: the set of candidates grows with the input
    some = texts.join(shared.select("node").distinct(), "node").select("digest", "node", "sketch", F.col("doc_id").alias("_id"))
    chosen = docs.join(some.select("_id").distinct().hint("merge"), docs["doc_id"] == F.col("_id"), "left_semi")
    encoded = _encoded(chosen).groupBy("digest").agg(F.first("words").alias("words"))  # one copy of each text suffices
    words = materialize(encoded.join(some.select("digest", "node", "sketch"), "digest").select("node", "words", "sketch"), "words")

    left, links = shared, []
    for turn in range(PIVOTS):
        pivots = materialize(left.groupBy("key").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(turn))).alias("pivot")), "pivots")
        starred = left.join(pivots, "key").select("key", "node", "n", F.col("pivot.node").alias("p"), F.col("pivot.n").alias("np")).where(F.col("node") != F.col("p"))
        starred = materialize(starred, "stars")
        pairs = starred.where(_alike_lengths("n", "np")).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        for known in links:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        links.append(materialize(_verified(pairs, words), "links"))
        near = reduce(DataFrame.union, links).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        before, left = left, materialize(starred.join(near, (F.least("node", "p") == F.col("_a")) & (F.greatest("node", "p") == F.col("_b")), "left_anti").select("node", "n", "key"), "left")
        discard(starred, pivots, *([before] if turn else []))
    discard(left, shared_keys)
    classes = materialize(connected_components(reduce(DataFrame.union, links)), "classes")
    members = materialize(shared.join(classes, "node", "left").select("key", "at", "node", "n", F.coalesce("component", "node").alias("class")), "members")
    across = _across(_groups(members).join(words, "node"))
    # links between classes join these
    joined = materialize(connected_components(across).select(F.col("node").alias("_class"), F.col("component").alias("_least")), "joined")
    discard(shared, words, members, *links)
    own = texts.select("digest", "doc_id", "node").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    own = own.join(joined, F.col("class") == F.col("_class"), "left").select("digest", "doc_id", F.coalesce("_least", "class").alias("class"))
    least = materialize(own.groupBy("class").agg(F.min(F.struct("doc_id", "digest")).alias("least")), "least")
    known = own.select("digest", "class").join(least, "class")
    return all_rows, materialize(known.select(F.col("digest").alias("_digest"), F.col("least.doc_id").alias("class_id"), (F.col("digest") == F.col("least.digest")).alias("stays")), "known")


def _with_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col).withColumn("digest", F.unhex(F.md5("text")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least doc_id of its group of near duplicates) and kept (whether that is itself) for every row.

    Two documents are linked when the words of one turn into the other's with edits of at most a fifth of the longer one, and they share
    one of SKETCHES order MinHashes: each is the ORDERED least occurrence-labelled runs of five words under a hash function, in text order. Two texts share one
    sketch with a probability of about J^2, J being the agreement of their runs; scattered changes of 3, 10, 15 and 19 % of the words leave a J of 0.75, 0.42,
    0.29 and 0.21, so of links with 300 words 0.999, 0.999, 0.99 and 0.94 share one of 64 (tests measure it); block changes leave more. The rule
    is the same in buckets of every size, none of which is capped. Equal texts collapse by digest first.

    Each bucket compares its members with a pivot, PIVOTS times, those linked to the first pivot aside the second time: this finds most
    classes with few alignments. Then all members of buckets that hold several classes, linked to a pivot or not, compare with all others of the bucket
    that are not yet of their class; comparing within a class could change nothing. A bucket above MEMBERS members or WORDS words goes into ranges of
    lengths, of which only neighbours can hold links, and these into blocks, each pair of blocks in its own row group; no pairs are written. So a
    bucket of n members of one range ships n^2 / MEMBERS rows, each group of which is compared by word counts before anything is aligned.

    A null text is its own class; texts without words are grouped only when equal. Repeated rows get one class. Where one id stands
    for several texts, each row goes by its own text, and classes with the same least id show the same class_id. Empty tables give empty results; other columns are ignored.
    """
    all_rows, known = _classes(_with_digest(docs, id_col, text_col))
    joined = all_rows.select("doc_id", "digest").join(known, F.col("digest") == F.col("_digest"), "left")
    class_id = F.coalesce("class_id", "doc_id")
    return joined.select("doc_id", class_id.alias("class_id"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are: one row of each group of near duplicates.

    It has the group's least id, and of several texts or rows with that id, the least digest and the least hash of the row. Rows with a null id stay, as do
    null texts (one row of each id). Empty tables give empty results; no column name is special.
    """
    base = _with_digest(docs.where(docs[f"`{id_col}`"].isNotNull()), id_col, text_col)
    all_rows, known = _classes(base)
    joined = all_rows.select("doc_id", "digest").join(known, F.col("digest") == F.col("_digest"), "left")
    kept = joined.where((F.col("stays") & (F.col("doc_id") == F.col("class_id"))) | F.col("digest").isNull())
    digest, nth, own_id, own_digest = spare_names(docs, "digest", "nth", "own_id", "own_digest")
    kept = kept.select(F.col("doc_id").alias(own_id), F.coalesce("digest", F.lit(b"")).alias(own_digest)).distinct()
    hashed = [docs[f"`{f.name}`"] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    marked = docs.withColumn(digest, F.coalesce(F.unhex(F.md5(docs[f"`{text_col}`"])), F.lit(b""))).withColumn(nth, F.xxhash64(*hashed))
    marked = marked.join(kept, (marked[f"`{id_col}`"] == kept[own_id]) & (marked[digest] == kept[own_digest]), "left_semi")
    first = F.row_number().over(Window.partitionBy(f"`{id_col}`", digest).orderBy(nth))
    rows = marked.withColumn(nth, first).where(F.col(nth) == 1).select(*(f"`{c}`" for c in docs.columns))
    return rows.union(docs.where(docs[f"`{id_col}`"].isNull()))
