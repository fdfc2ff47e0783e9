"""Progressive JPEG columns (operator 8).

A decoder of progressive (and sequential) Huffman-coded JPEG files: spectral-selection and successive-approximation scans are
accumulated into coefficient arrays, which numpy inverse-transforms, upsamples and turns into full-resolution RGB tensors; and an encoder
that stores arbitrary bytes as quantized coefficients, the format's own unit, so that they come back bit by bit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.tokens import slices

UNIT = 576


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position: diagonals of the 8 x 8 block in alternating direction."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    order = sorted(cells, key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = _zigzag()
#: cosines of the inverse transform in 13 fractional bits: all products are whole numbers a double holds exactly.
_COS = np.round(8192 * np.array([[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)]))


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    blocks: np.ndarray = field(default=None, repr=False)  # (rows, columns, 64) in zigzag order, padded to whole MCUs
    rows: int = 0  # of blocks that the component's own scans hold
    cols: int = 0


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]

    def prepare(self) -> None:
        hmax, vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.hmax, self.vmax = hmax, vmax
        self.mcus_x, self.mcus_y = -(-self.width // (8 * hmax)), -(-self.height // (8 * vmax))
        for c in self.components:
            c.cols = -(-(-(-self.width * c.h // hmax)) // 8)
            c.rows = -(-(-(-self.height * c.v // vmax)) // 8)
            c.blocks = np.zeros((self.mcus_y * c.v, self.mcus_x * c.h, 64), np.int16)


# --- Huffman tables -----------------------------------------------------------------------------------------------------------


def code_table(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) by the canonical assignment."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(64)
def lookup(counts: bytes, symbols: bytes) -> Lookup:
    return Lookup(counts, symbols)


class Lookup:
    """For every 16 bits ahead the symbol and its code's length (0: no code)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes = code_table(counts, symbols)
        self.symbol, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        for s, (code, n) in self.codes.items():
            self.symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
            self.length[code << (16 - n) : (code + 1) << (16 - n)] = n


# --- decoding -----------------------------------------------------------------------------------------------------------------


class Bits:
    """A bit reader over one entropy-coded segment without stuffing; reads zeros past the end."""

    def __init__(self, data: bytes):
        self.value, self.left, self.data, self.at = 0, 0, data, 0

    def need(self, n: int) -> None:
        while self.left < n:
            chunk = self.data[self.at : self.at + 6].ljust(6, b"\0")
            self.value = ((self.value & ((1 << self.left) - 1)) << 48) | int.from_bytes(chunk, "big")
            self.left += 48
            self.at += 6

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, table: Lookup) -> int:
        self.need(16)
        ahead = (self.value >> (self.left - 16)) & 0xFFFF
        n = int(table.length[ahead])
        if not n:
            raise ValueError("no such code")
        self.left -= n
        return int(table.symbol[ahead])


def extend(v: int, n: int) -> int:
    return v if n == 0 or v >= 1 << (n - 1) else v - (1 << n) + 1


def _dc_scan(blocks: list[tuple[int, np.ndarray]], segment: bytes, tables: dict[int, Lookup], high: int, low: int) -> None:
    bits, last = Bits(segment), {}
    for c, b in blocks:
        if high:
            if bits.take(1):
                b[0] |= 1 << low
        else:
            n = bits.symbol(tables[c])
            last[c] = last.get(c, 0) + extend(bits.take(n), n)
            b[0] = last[c] << low


def _ac_first(blocks: list[np.ndarray], segment: bytes, table: Lookup, start: int, end: int, low: int) -> None:
    bits, skip = Bits(segment), 0
    for b in blocks:
        if skip:
            skip -= 1
            continue
        k = start
        while k <= end:
            run, n = divmod(bits.symbol(table), 16)
            if n:
                k += run
                b[k] = extend(bits.take(n), n) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) + bits.take(run) - 1
                break


def _ac_refine(blocks: list[np.ndarray], segment: bytes, table: Lookup, start: int, end: int, low: int) -> None:
    bits, skip, one = Bits(segment), 0, 1 << low

    def correct(b: np.ndarray, k: int) -> None:
        if bits.take(1) and not abs(int(b[k])) & one:
            b[k] += one if b[k] > 0 else -one

    for b in blocks:
        k = start
        if not skip:
            while k <= end:
                run, n = divmod(bits.symbol(table), 16)
                new = 0
                if n:
                    new = one if bits.take(1) else -one
                elif run < 15:
                    skip = (1 << run) + bits.take(run)
                    break
                while k <= end:
                    if b[k]:
                        correct(b, k)
                    else:
                        if not run:
                            break
                        run -= 1
                    k += 1
                if new and k <= end:
                    b[k] = new
                k += 1
        if skip:
            while k <= end:
                if b[k]:
                    correct(b, k)
                k += 1
            skip -= 1


def _uniform_first(blocks: np.ndarray, segment: bytes, table: Lookup, start: int, end: int, low: int) -> bool:
    """Decodes a first AC scan in which every coefficient has the same code 0/size; False (nothing done) where one differs.

    If the code and its bits take w bits, the codes must lie at multiples of w. When all places hold that one code, decoding
    from the left reads just these: no other parse exists.
    """
    ahead = int.from_bytes(segment[:2].ljust(2, b"\xff"), "big")
    symbol, n = int(table.symbol[ahead]), int(table.length[ahead])
    if not n or symbol >> 4 or not symbol & 15:
        return False
    size, width, count = symbol & 15, n + (symbol & 15), len(blocks) * (end - start + 1)
    if len(segment) * 8 < width * count:
        return False
    if width == 8:
        raw = np.frombuffer(segment, np.uint8, count)
        codes, values = raw >> size, (raw & ((1 << size) - 1)).astype(np.int16)
    else:
        bits = np.unpackbits(np.frombuffer(segment, np.uint8), count=width * count).reshape(count, width)
        weights = 1 << np.arange(width - 1, -1, -1)
        whole = bits.astype(np.int32) @ weights
        codes, values = whole >> size, (whole & ((1 << size) - 1)).astype(np.int16)
    if (codes != table.codes[symbol][0]).any():
        return False
    values = np.where(values < 1 << (size - 1), values - ((1 << size) - 1), values)
    blocks[:, start : end + 1] = (values << low).reshape(len(blocks), -1)
    return True


def _uniform_refine(blocks: np.ndarray, segment: bytes, table: Lookup, start: int, end: int, low: int) -> bool:
    """Decodes an AC refinement in which all coefficients are known: end-of-band runs and correction bits only."""
    band = blocks[:, start : end + 1]
    if not (band != 0).all():
        return False
    raw = np.unpackbits(np.frombuffer(segment, np.uint8))
    at, done, width = 0, 0, band.shape[1]
    while done < len(blocks):
        ahead = int.from_bytes(np.packbits(raw[at : at + 16]).tobytes().ljust(2, b"\0"), "big")
        symbol, n = int(table.symbol[ahead]), int(table.length[ahead])
        run = symbol >> 4
        if not n or symbol & 15 or run == 15:
            return False
        at += n
        run_length = (1 << run) + (int("".join(map(str, raw[at : at + run])), 2) if run else 0)
        at += run
        m = min(run_length, len(blocks) - done)
        if at + m * width > len(raw):
            return False
        more = raw[at : at + m * width].reshape(m, width).astype(np.int16) << low
        part = band[done : done + m]
        sign = part >> 15
        size = (part ^ sign) - sign
        part[...] = ((size | more) ^ sign) - sign
        at, done = at + m * width, done + m
    return True


def _mcu_order(frame: Frame, chosen: list) -> np.ndarray:
    """The DC coefficients of interleaved components, one row an MCU, in the order of a scan (a copy)."""
    mcus = frame.mcus_y * frame.mcus_x
    parts = [c.blocks[:, :, 0].reshape(frame.mcus_y, c.v, frame.mcus_x, c.h).transpose(0, 2, 1, 3).reshape(mcus, c.v * c.h) for c, _, _ in chosen]
    return np.concatenate(parts, 1)


def _uniform_dc(frame: Frame, chosen: list, segment: bytes, high: int, low: int, huff: dict) -> bool:
    """Decodes an interleaved DC refinement, or a first DC scan whose differences are all zero."""
    per = [c.v * c.h for c, _, _ in chosen]
    n = frame.mcus_y * frame.mcus_x * sum(per)
    raw = np.unpackbits(np.frombuffer(segment, np.uint8), count=n) if len(segment) * 8 >= n else None
    if raw is None:
        return False
    if not high:
        tables = [huff.get((0, dc)) for _, dc, _ in chosen]
        if any(t is None or t.codes.get(0) != (0, 1) for t in tables) or raw.any():
            return False
        for c, _, _ in chosen:
            c.blocks[:, :, 0] = 0
        return True
    raw = (raw.astype(np.int16) << low).reshape(-1, sum(per))
    at = 0
    for (c, _, _), k in zip(chosen, per, strict=True):
        bits = raw[:, at : at + k].reshape(frame.mcus_y, frame.mcus_x, c.v, c.h).transpose(0, 2, 1, 3)
        c.blocks[:, :, 0] |= bits.reshape(c.blocks.shape[:2])
        at += k
    return True


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded segments from `at` on, cut at restart markers and without stuffing, and the place of the next marker."""
    out, start, look = [], at, at
    while True:
        look = data.find(b"\xff", look)
        if look < 0 or look + 1 >= len(data):
            look = len(data)
            break
        marker = data[look + 1]
        if marker == 0:
            look += 2
        elif 0xD0 <= marker <= 0xD7:
            out.append(data[start:look].replace(b"\xff\x00", b"\xff"))
            start = look = look + 2
        else:
            break
    return [*out, data[start:look].replace(b"\xff\x00", b"\xff")], look


def decode_coefficients(data: bytes) -> Frame:
    """Accumulates all scans of a file into its coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, frame, progressive, interval = 2, None, True, 0
    quant: dict[int, np.ndarray] = {}
    huff: dict[tuple[int, int], Lookup] = {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, key = divmod(body[0], 16)
                n = 128 if wide else 64
                quant[key] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[divmod(body[0], 16)] = lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC2):
            progressive = marker == 0xC2
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            frame = Frame(width, height, parts, quant)
            frame.prepare()
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("scan before frame")
            n = body[0]
            chosen = [(next(c for c in frame.components if c.id == body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            start, end, approx = body[1 + 2 * n : 4 + 2 * n]
            segments, at = _segments(data, at)
            _scan(frame, chosen, segments, huff, (start, end, approx >> 4, approx & 15), progressive, interval)
    if frame is None:
        raise ValueError("no frame")
    return frame


def _scan(frame: Frame, chosen: list, segments: list[bytes], huff: dict, spec: tuple[int, int, int, int], progressive: bool, interval: int) -> None:
    start, end, high, low = spec
    if len(chosen) == 1:
        c, dc, ac = chosen[0]
        own = c.blocks[: c.rows, : c.cols]
        flat = own.reshape(-1, 64) if own.flags.c_contiguous else np.ascontiguousarray(own).reshape(-1, 64)
        if len(segments) == 1 and start and (_uniform_refine if high else _uniform_first)(flat, segments[0], huff[1, ac], start, end, low):
            own[...] = flat.reshape(own.shape)
            return
        rows = [flat[i] for i in range(len(flat))]
        per = interval or len(rows)
        for k, segment in enumerate(segments):
            part = rows[k * per : (k + 1) * per]
            if not progressive:
                _sequential([(0, b) for b in part], segment, {0: (huff[0, dc], huff[1, ac])})
            elif start == 0:
                _dc_scan([(0, b) for b in part], segment, {0: huff.get((0, dc))}, high, low)
            elif high:
                _ac_refine(part, segment, huff[1, ac], start, end, low)
            else:
                _ac_first(part, segment, huff[1, ac], start, end, low)
        own[...] = flat.reshape(own.shape)
        return
    if progressive and len(segments) == 1 and _uniform_dc(frame, chosen, segments[0], high, low, huff):
        return
    mcus = []
    for y in range(frame.mcus_y):
        for x in range(frame.mcus_x):
            mcus.append([(i, c.blocks[y * c.v + dy, x * c.h + dx]) for i, (c, _, _) in enumerate(chosen) for dy in range(c.v) for dx in range(c.h)])
    per = interval or len(mcus)
    for k, segment in enumerate(segments):
        part = [b for m in mcus[k * per : (k + 1) * per] for b in m]
        if progressive:
            _dc_scan(part, segment, {i: huff.get((0, dc)) for i, (_, dc, _) in enumerate(chosen)}, high, low)
        else:
            _sequential(part, segment, {i: (huff[0, dc], huff[1, ac]) for i, (_, dc, ac) in enumerate(chosen)})


def _sequential(blocks: list[tuple[int, np.ndarray]], segment: bytes, tables: dict[int, tuple[Lookup, Lookup]]) -> None:
    bits, last = Bits(segment), {}
    for c, b in blocks:
        dc, ac = tables[c]
        n = bits.symbol(dc)
        last[c] = b[0] = last.get(c, 0) + extend(bits.take(n), n)
        k = 1
        while k < 64:
            run, n = divmod(bits.symbol(ac), 16)
            if n:
                k += run
                b[k] = extend(bits.take(n), n)
                k += 1
            elif run == 15:
                k += 16
            else:
                break


def planes(frame: Frame) -> list[np.ndarray]:
    """The components' samples, inverse-transformed; whole blocks."""
    out = []
    for c in frame.components:
        rows, cols, _ = c.blocks.shape
        natural = np.empty((rows * cols, 64))
        natural[:, ZIGZAG] = c.blocks.reshape(-1, 64) * frame.quant[c.table]
        x = (natural.reshape(-1, 8) @ _COS.T).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _COS.T
        samples = np.clip(np.floor(x * 2.0**-26 + 128.5), 0, 255).astype(np.uint8).reshape(rows, cols, 8, 8)  # [block, x, y]
        out.append(samples.transpose(0, 3, 1, 2).reshape(rows * 8, cols * 8))
    return out


def rgb(frame: Frame) -> np.ndarray:
    """The full-resolution RGB tensor (height, width, 3); subsampled components are upsampled by repetition."""
    full = []
    for c, p in zip(frame.components, planes(frame), strict=True):
        if frame.vmax != c.v:
            p = np.repeat(p, frame.vmax // c.v, 0)
        if frame.hmax != c.h:
            p = np.repeat(p, frame.hmax // c.h, 1)
        full.append(p[: frame.height, : frame.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, 2)
    y, cb, cr = (p.astype(np.int32) for p in full)
    cb, cr = cb - 128, cr - 128
    out = np.empty((*y.shape, 3), np.uint8)  # 16 fractional bits
    out[..., 0] = np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255)
    out[..., 1] = np.clip(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 0, 255)
    out[..., 2] = np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255)
    return out


# --- storing bytes ------------------------------------------------------------------------------------------------------------

#: Samples of one 4:2:0 MCU: four luma blocks and one of each chroma component.
PER_MCU = 6 * 64
_SPLIT = 6  # spectral selection: coefficients 1..5, then 6..63


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, key: int, symbols: list[int]) -> bytes:
    """A table with symbols[0] coded as 0 and the others as 10, 110, ..."""
    return bytes([kind << 4 | key]) + bytes([1] * len(symbols) + [0] * (16 - len(symbols))) + bytes(symbols)


def _stuffed(raw: bytes) -> bytes:
    return raw.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    """Bits to bytes, filled up with ones."""
    if spare := -len(bits) % 8:
        bits = np.concatenate([bits, np.ones(spare, bits.dtype)])
    return _stuffed(np.packbits(bits).tobytes())


def geometry(n_bytes: int) -> tuple[int, int]:
    """MCU columns and rows of a nearly square image that holds so many bytes."""
    mcus = max(1, -(-n_bytes // PER_MCU))
    cols = int(np.ceil(np.sqrt(mcus)))
    return cols, -(-mcus // cols)


#: Codes of the refinement table: end-of-band runs, the longest first.
_RUNS = [0xE0, *(r << 4 for r in range(14))]
_RUN_CODES = code_table(bytes([1] * 15 + [0]), bytes(_RUNS))
_TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)), _segment(0xC4, _huffman(0, 0, [0]) + _huffman(1, 0, [0x07]) + _huffman(1, 1, _RUNS))


def _sos(keys: tuple[int, ...], start: int, end: int, high: int, low: int, table: int = 0) -> bytes:
    return _segment(0xDA, bytes([len(keys), *(x for k in keys for x in (k, table)), start, end, high << 4 | low]))


def store_bytes(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG file whose quantized coefficients are the payload's bytes.

    A byte b is the AC coefficient b (128..255) or b - 255 (0..127): the values whose magnitude takes eight bits. The
    first scans hold all but the lowest bit of the magnitudes, in two bands; a refinement scan adds it. A DC coefficient is the byte
    itself, brought by eight one-bit refinements of a first scan of zeros. Room beyond the payload holds bytes 255.
    """
    cols, rows = geometry(len(payload))
    mcus = cols * rows
    data = np.full(mcus * PER_MCU, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(-1, 64)
    luma, chroma = data[: mcus * 4], data[mcus * 4 :].reshape(2, mcus, 64)
    parts = [_TABLES[0], _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES[1]]
    dc = np.concatenate([luma[:, 0].reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(mcus, 4), chroma[0, :, :1], chroma[1, :, :1]], 1).reshape(-1)
    parts += [_sos((1, 2, 3), 0, 0, 0, 8), _packed(np.zeros(len(dc), np.uint8))]
    for bit in range(7, -1, -1):
        parts += [_sos((1, 2, 3), 0, 0, bit + 1, bit), _packed((dc >> bit) & 1)]
    positive = data >= 128
    magnitude = np.where(positive, data, 255 - data)
    half = magnitude >> 1
    first, last = np.where(positive, half, 127 - half), magnitude & 1  # code 0 and seven bits; the lowest bit
    at = 0
    for key, n in ((1, 4 * mcus), (2, mcus), (3, mcus)):
        own = first[at : at + n]
        for start, end in ((1, _SPLIT - 1), (_SPLIT, 63)):
            parts += [_sos((key,), start, end, 0, 1), own[:, start : end + 1].tobytes()]  # no byte is 255: nothing to stuff
        parts += [_sos((key,), 1, 63, 1, 0, 1), _packed(_refinement(last[at : at + n, 1:]))]
        at += n
    return b"\xff\xd8" + b"".join(parts) + b"\xff\xd9"


def _refinement(low: np.ndarray) -> np.ndarray:
    """End-of-band runs and correction bits of blocks without zero coefficients."""
    out, done = [], 0
    while done < len(low):
        n = min(len(low) - done, 32767)
        run = n.bit_length() - 1
        code, length = _RUN_CODES[run << 4]
        head = f"{code:0{length}b}" + (f"{n - (1 << run):0{run}b}" if run else "")
        out += [np.frombuffer(head.encode(), np.uint8) - 48, low[done : done + n].reshape(-1)]
        done += n
    return np.concatenate(out)


def read_bytes(frame: Frame, n_bytes: int) -> bytes:
    """The payload of a file of store_bytes()."""
    y, cb, cr = (c.blocks.reshape(-1, 64) for c in frame.components)
    data = np.concatenate([y, cb, cr])
    out = np.where(data < 0, data + 255, data).astype(np.uint8)
    out[:, 0] = data[:, 0]
    return out.tobytes()[:n_bytes]


def features(image: np.ndarray) -> str:
    """A short summary of an RGB tensor: its shape, channel means, and the bits of 8 x 8 areas brighter than the mean."""
    h, w, _ = image.shape
    means = image.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (h * w)
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    cells = np.add.reduceat(np.add.reduceat(image.sum(2, dtype=np.int64), rows, 0), cols, 1)
    bits = np.packbits(cells * 64 > cells.sum()).tobytes().hex()
    return f"{w}x{h}:{means[0]}.{means[1]}.{means[2]}:{bits}"


# --- columns ------------------------------------------------------------------------------------------------------------------


def payload_of(text: bytes | None) -> tuple[bytes, int]:
    raw = text or b""
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def decoded_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds height, width and tensor (RGB, row by row, one byte a sample) to rows with a JPEG file; null or broken files give nulls."""
    names = [c for c in media.columns if c not in ("height", "width", "tensor")]
    source = media.select(*(media[f"`{c}`"] for c in names))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media_col, 1 << 20):
                out = []
                for x in part.column(media_col).to_pylist():
                    try:
                        image = rgb(decode_coefficients(x))
                        out.append((image.shape[0], image.shape[1], image.tobytes()))
                    except (ValueError, TypeError, KeyError, IndexError, struct.error):
                        out.append((None, None, None))
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=[*names, "height", "width", "tensor"])

    return source.mapInArrow(decode, T.StructType([*source.schema.fields, *T._parse_datatype_string("height int, width int, tensor binary").fields]))


DIGEST_FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False, with_tensor: bool = False) -> DataFrame:
    """Stores each whole text as a progressive JPEG file, reads it back from the file's bytes and describes the decoded image.

    The payload is the text in UTF-8 and bytes 255 up to a positive multiple of 576. All digests are of what was read
    back. with_media adds the file, with_tensor height, width and the RGB tensor. Null text is empty; equal texts give equal values; repeated
    rows give repeated results. One text is handled at a time; no shuffle.
    """
    source = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("binary").alias("text"))
    schema = DIGEST_FIELDS + (", media binary" if with_media else "") + (", height int, width int, tensor binary" if with_tensor else "")
    fields = T._parse_datatype_string(schema).fields
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    payload, n = payload_of(text)
                    media = store_bytes(payload)
                    frame = decode_coefficients(media)
                    back = read_bytes(frame, len(payload))
                    image = rgb(frame)
                    row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(image))
                    row += ((media,) if with_media else ()) + ((image.shape[0], image.shape[1], image.tobytes()) if with_tensor else ())
                    rows.append(row)
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(cols, fields, strict=True))], names=["doc_id", *(f.name for f in fields)])

    return source.mapInArrow(store, T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *fields]))
