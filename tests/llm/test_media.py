import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import progressive_jpeg as pj


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n - 1, -1, -1)]

    def done(self):
        self.bits += [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


ALL = list(range(256))
COUNTS = bytes([0] * 8 + [256 - 1, 1] + [0] * 6)  # 255 codes of nine bits, one of ten
CODES = pj.code_table(COUNTS, bytes(ALL))


def size_bits(v):
    n = abs(int(v)).bit_length()
    return n, (v if v > 0 else v + (1 << n) - 1) if n else 0


def general_file(blocks, width, height, interval=0):
    """Writes one gray component by a general progressive script: DC with refinement, two bands, runs, zero runs, refinement."""
    out = [pj._segment(0xDB, bytes([0]) + bytes([1] * 64)), pj._segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))]
    out.append(pj._segment(0xC4, b"".join(bytes([kind << 4]) + COUNTS + bytes(ALL) for kind in (0, 1))))
    if interval:
        out.append(pj._segment(0xDD, interval.to_bytes(2, "big")))

    def scan(start, end, high, low, code):
        out.append(pj._segment(0xDA, bytes([1, 1, 0, start, end, high << 4 | low])))
        per = interval or len(blocks)
        for k, at in enumerate(range(0, len(blocks), per)):
            if k:
                out.append(bytes([0xFF, 0xD0 + (k - 1) % 8]))
            w = Writer()
            code(w, blocks[at : at + per])
            out.append(w.done())

    def dc_first(w, part):
        last = 0
        for b in part:
            v = int(b[0]) >> 1
            n, extra = size_bits(v - last)
            last = v
            w.put(*CODES[n])
            w.put(extra, n)

    def ac_first(start, end, low):
        def code(w, part):
            skip = 0

            def flush():
                nonlocal skip
                if skip:
                    n = skip.bit_length() - 1
                    w.put(*CODES[n << 4])
                    w.put(skip - (1 << n), n)
                    skip = 0

            for b in part:
                run = 0
                for k in range(start, end + 1):
                    v = int(np.sign(b[k])) * (abs(int(b[k])) >> low)
                    if not v:
                        run += 1
                        continue
                    flush()
                    while run > 15:
                        w.put(*CODES[0xF0])
                        run -= 16
                    n, extra = size_bits(v)
                    w.put(*CODES[run << 4 | n])
                    w.put(extra, n)
                    run = 0
                if run:
                    skip += 1
            flush()

        return code

    def ac_refine(start, end, low):
        def code(w, part):
            for b in part:
                k, held, run = start, [], 0
                last_new = max((i for i in range(start, end + 1) if abs(int(b[i])) >> low == 1), default=-1)
                while k <= last_new:
                    mag = abs(int(b[k])) >> low
                    if mag > 1:
                        held.append(mag & 1)
                    elif mag == 0:
                        run += 1
                        if run == 16:
                            w.put(*CODES[0xF0])
                            for x in held:
                                w.put(x, 1)
                            held, run = [], 0
                    else:
                        w.put(*CODES[run << 4 | 1])
                        w.put(int(b[k] > 0), 1)
                        for x in held:
                            w.put(x, 1)
                        held, run = [], 0
                    k += 1
                if run or held or k <= end:
                    w.put(*CODES[0])
                    for x in held:
                        w.put(x, 1)
                    while k <= end:
                        if abs(int(b[k])) >> low > 1:
                            w.put(abs(int(b[k])) >> low & 1, 1)
                        k += 1

        return code

    scan(0, 0, 0, 1, dc_first)
    scan(1, 9, 0, 1, ac_first(1, 9, 1))
    scan(10, 63, 0, 1, ac_first(10, 63, 1))
    scan(0, 0, 1, 0, lambda w, part: [w.put(int(b[0]) & 1, 1) for b in part])
    scan(1, 63, 1, 0, ac_refine(1, 63, 0))
    return b"\xff\xd8" + b"".join(out) + b"\xff\xd9"


def sparse_blocks(seed, n, share):
    rng = np.random.default_rng(seed)
    b = np.where(rng.random((n, 64)) < share, rng.integers(-300, 300, (n, 64)), 0)
    b[:, 0] = rng.integers(-500, 500, n)
    return b


def test_general_scans_decode():
    for seed, share, interval in ((0, 0.05, 0), (1, 0.3, 0), (2, 0.9, 4), (3, 0.0, 0), (4, 0.02, 3), (5, 1.0, 0)):
        blocks = sparse_blocks(seed, 12, share)
        frame = pj.decode_coefficients(general_file(blocks, 32, 24, interval))
        assert (frame.components[0].blocks.reshape(-1, 64) == blocks).all(), seed


def test_inverse_transform_and_upsampling():
    frame = pj.decode_coefficients(general_file(sparse_blocks(7, 4, 0.1) // 8, 16, 16))
    block = np.zeros(64)
    block[pj.ZIGZAG] = frame.components[0].blocks[0, 1]
    u = np.arange(8)
    basis = np.cos((2 * np.arange(8)[:, None] + 1) * u[None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)[None]
    want = np.clip(np.floor(basis @ block.reshape(8, 8) @ basis.T + 128.5), 0, 255)
    assert np.abs(pj.planes(frame)[0][:8, 8:16].astype(int) - want).max() <= 1
    image = pj.rgb(frame)
    assert image.shape == (16, 16, 3) and (image[..., 0] == image[..., 2]).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_bytes_round_trip(data):
    payload, n = pj.payload_of(data)
    assert n == len(data) and len(payload) % 576 == 0 and len(payload) >= 576
    media = pj.store_bytes(payload)
    frame = pj.decode_coefficients(media)
    assert pj.read_bytes(frame, len(payload)) == payload
    assert pj.rgb(frame).shape == (frame.height, frame.width, 3)


def test_fast_paths_equal_the_general_decoder(monkeypatch):
    media = pj.store_bytes(pj.payload_of(bytes(range(256)) * 9)[0])
    quick = pj.decode_coefficients(media)
    for name in ("_uniform_first", "_uniform_refine", "_uniform_dc"):
        monkeypatch.setattr(pj, name, lambda *a: False)
    slow = pj.decode_coefficients(media)
    for a, b in zip(quick.components, slow.components, strict=True):
        assert (a.blocks == b.blocks).all()


def test_stored_texts(spark):
    rows = [(1, "abc", 5), (2, None, 6), (3, "", 7), (4, "é" * 4000, 8), (5, "abc", 9), (5, "abc", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature int")
    got = pj.stored_texts(docs, with_media=True, with_tensor=True).collect()
    assert len(got) == 6
    seen = {}
    for r in got:
        raw = (dict((x[0], x[1]) for x in rows)[r["doc_id"]] or "").encode()
        payload = pj.payload_of(raw)[0]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and r["media_bytes"] == len(r["media"])
        assert len(r["tensor"]) == r["height"] * r["width"] * 3
        assert seen.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert pj.stored_texts(docs.where("false")).count() == 0
    media = spark.createDataFrame([(1, bytearray(got[0]["media"])), (2, bytearray(b"no jpeg")), (3, None)], "id int, media binary")
    back = {r["id"]: r for r in pj.decoded_media(media).collect()}
    assert bytes(back[1]["tensor"]) == bytes(got[0]["tensor"]) and back[2]["tensor"] is None and back[3]["height"] is None
