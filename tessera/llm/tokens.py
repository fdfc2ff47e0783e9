"""Token ids of whole texts, by a tokenizers file of the public vocabularies.

A vocabulary whose pre-tokenizer never crosses white space gives every white-space-free chunk the ids it has on its own. Texts
are therefore cut into chunks and hashed by numpy, every distinct chunk is encoded once, and the ids of all texts are gathered by
numpy. A bounded table keeps the ids of chunks, by 64-bit hash, between batches of a Python worker. Chunks beyond Latin-1 take the tokenizer's whole path;
so does all text where the file's pre-tokenizer is another than the expected one.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; chunks and pieces a worker keeps.
SLICE_BYTES, CACHE_WORDS, PIECES = 1 << 20, 1_000_000, 100_000

_LETTER, _NUMBER, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
#: The vocabulary's pattern for pieces of a chunk, in Latin-1 classes. Fixed value.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: The parts of a file whose texts may be cut at white space. Fixed values.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_LATIN_WORD = re.compile(f"[{_LETTER}]+").fullmatch
_ODD_SPACE = re.compile("[\x00-\x20\x7f-\xa0\xad]").search


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkTokenizer:
    """Ids of texts under a word-splitting BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_chars()
        parts = json.loads(self.tokenizer.to_str())
        self.by_chunk = (parts["normalizer"], parts["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER) and parts["model"]["type"] == "BPE"
        self.pieces: dict[str, bytes] = {}
        self._forget()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
            ids = self.pieces[piece] = array("I", [t.id for t in found]).tobytes()
        return ids

    def _ids(self, chunk: str) -> bytes:
        low = chunk.lower()
        if chunk.isascii():
            if low.isalpha():
                return self._piece(low)
        else:
            try:
                chunk.encode("latin-1")
            except UnicodeEncodeError:
                return self._whole(chunk)
            if _LATIN_WORD(low):
                return self._piece(low)
        if "<|" in chunk or _ODD_SPACE(chunk):
            return self._whole(chunk)
        return b"".join(map(self._piece, _PIECE.findall(low)))

    def _whole(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the bounds of each text (n + 1 offsets). A null text has no ids."""
        if not self.by_chunk:
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        raw, bounds = text_bytes(pc.fill_null(texts, ""))
        if not len(raw):
            return np.zeros(0, "<u4"), bounds
        space = _IS_SPACE[raw]
        breaks = np.zeros(len(raw) + 1, bool)
        breaks[1:] = space
        breaks[bounds] = True
        # every break starts a stretch; those that hold more than one space are chunks
        starts = np.flatnonzero(breaks[:-1])
        ends = np.append(starts[1:], len(raw))
        ends = ends - space[ends - 1]
        full = ends > starts
        upto = np.concatenate([[0], np.cumsum(full)])
        chunk_bounds = upto[np.searchsorted(starts, bounds)]
        if not full.any():
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        starts, ends = starts[full], ends[full]
        hashes, codes = np.unique(span_hashes(raw, starts, ends), return_inverse=True)
        where, sizes = self._known(raw, starts, ends, hashes, codes)
        lengths = sizes[codes]
        at = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.repeat(where[codes] - at[:-1], lengths) + np.arange(at[-1])], at[chunk_bounds]

    def _known(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the chunks with these sorted hashes begin in self.ids, and how many each has; encodes those that are not held."""
        if len(self.hashes) > CACHE_WORDS:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        held = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        held[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~held)
        if len(new):
            first = np.empty(len(hashes), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            whole = raw.tobytes()
            found = [self._ids(whole[a:b].decode()) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            self.where = np.insert(self.where, at[new], len(self.ids) + np.cumsum(sizes) - sizes)
            self.sizes = np.insert(self.sizes, at[new], sizes)
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
            at = np.searchsorted(self.hashes, hashes)
        if len(self.pieces) > PIECES:
            self.pieces = {}
        return self.where[at], self.sizes[at]

    def _forget(self) -> None:
        self.hashes, self.where, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the bounds of each."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2^64, and of its inverse."""
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        if len(_powers.get(base, ())) < n:
            size = 1 << max(16, (n - 1).bit_length())
            _powers[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
    return tuple(x[:n] for x in _powers.values())


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of stretches of bytes that are not empty, from running sums over all bytes."""
    powers, inverses = power_tables(max(1, len(raw)))
    sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0)) if len(starts) else np.zeros(0, np.uint64)
    return (sums[ends - 1] - before) * inverses[starts] + (ends - starts).astype(np.uint64)


def give_back() -> None:
    """Returns freed memory to the system at a task's end: Spark keeps Python workers for later stages, which need it elsewhere."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_loaded: dict[str, ChunkTokenizer] = {}


def load(path: str) -> ChunkTokenizer:
    """One tokenizer for each Python worker and file."""
    if path not in _loaded:
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the column's bytes in each part stay near the limit (a longer value stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def documents(batch: pa.RecordBatch, text: str, path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the ids of their documents, each closed by end_id: (part, ids, n + 1 bounds)."""
    tokenizer = load(path)
    for part in slices(batch, text):
        ids, bounds = tokenizer.encode(part.column(text))
        closed = np.insert(ids, bounds[1:], end_id).astype("<u4")
        yield part, closed, bounds + np.arange(len(bounds))
