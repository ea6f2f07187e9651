"""Media columns: AVI files of motion-JPEG frames, and the clips between their shots.

A payload is kept losslessly as quantised DCT coefficients, the unit in which JPEG's entropy coder loses nothing: each byte is the
amplitude of a coefficient of size class 8 (its 8 amplitude bits are the byte). 576 bytes fill nine 8x8 blocks, that is three MCUs
of three components, between restart markers. Quantisers are 1. The reader parses RIFF lists and the ``idx1`` index, decodes the
intra frames (any baseline JPEG; frames with one class per table by array steps), takes the histogram of the first component, and
cuts where the difference of neighbours exceeds a running mean by several deviations.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.text import as_bytes, map_batches

UNIT, RATE = 576, 25
#: Units in a frame at most (a frame is 24 pixels wide, and 8 high for each unit); units coded at once.
FRAME_UNITS, AT_ONCE = 2, 256
BINS, MEMORY, DEVIATIONS, FLOOR = 16, 0.9, 4.0, 0.1
#: The zigzag order of a block's 64 coefficients follows from its diagonals.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_K = np.arange(8)
_COS = np.cos((2 * _K[:, None] + 1) * _K[None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)
#: From coefficients in zigzag order to samples in rows.
IDCT = np.einsum("yv,xu->vuyx", _COS, _COS).reshape(64, 64)[ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(64)
def frame_head(units: int) -> bytes:
    """A baseline JPEG's segments up to its scan: quantisers of 1, one Huffman code a table, a restart after each unit."""
    one = bytes([1] + [0] * 15) + b"\x08"
    parts = [
        b"\xff\xd8", _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xC0, struct.pack(">BHHB", 8, 8 * units, 24, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))),
        _segment(0xC4, b"\x00" + one + b"\x10" + one), _segment(0xDD, struct.pack(">H", 3)), _segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"),
    ]
    return b"".join(parts)


def coded_frames(payload: bytes, units: int) -> list[bytes]:
    """JPEG frames of ``units`` units; the last frame is filled up with 255."""
    total = len(payload) // UNIT
    data = np.frombuffer(payload + b"\xff" * (-total % units * UNIT), np.uint8).reshape(-1, UNIT)
    out, head = [], frame_head(units)
    step = max(1, AT_ONCE // units) * units
    for at in range(0, len(data), step):
        own = data[at : at + step]
        bits = np.zeros((len(own), UNIT, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(own, axis=1).reshape(len(own), UNIT, 8)
        coded = np.empty((len(own), UNIT * 9 // 8 + 2), np.uint8)
        coded[:, :-2] = np.packbits(bits.reshape(len(own), -1), axis=1)
        coded[:, -2], coded[:, -1] = 0xFF, 0xD0 + np.arange(len(own)) % units % 8
        coded[units - 1 :: units, -1] = 0xD9
        full = np.zeros(coded.shape, bool)
        full[:, :-2] = coded[:, :-2] == 0xFF
        lengths = (full.sum(1) + coded.shape[1]).reshape(-1, units).sum(1)
        stuffed = np.insert(coded.ravel(), np.flatnonzero(full.ravel()) + 1, 0).tobytes()
        ends = np.cumsum(lengths).tolist()
        out += [head + stuffed[a:b] for a, b in zip([0, *ends], ends)]
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def avi(payload: bytes) -> bytes:
    """An AVI file with index; the payload's length is a comment (ICMT)."""
    units = min(FRAME_UNITS, len(payload) // UNIT)
    frames = coded_frames(payload, units)
    height, most = 8 * units, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, 24, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I", 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0) + struct.pack("<4h", 0, 0, 24, height)
    form = struct.pack("<IiiHH4sIiiII", 40, 24, height, 1, 24, b"MJPG", 24 * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"%d" % len(payload)))
    index, at, chunks = [], 4, []
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        chunks.append(_chunk(b"00dc", frame))
        at += len(chunks[-1])
    body = b"AVI " + head + info + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parsed(data: bytes) -> dict:
    """Width, height, frames a second, comment, and the frames that the index names; the list itself where there is no index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"rate": float(RATE), "comment": b"", "frames": []}
    movi, index, listed = 0, [], []

    def walk(at, end):
        nonlocal movi, index
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body, stop = at + 8, min(at + 8 + size, end)
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                walk(body + 4, stop)
            elif name == b"avih":
                out["width"], out["height"] = struct.unpack_from("<II", data, body + 32)
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                out["rate"] = rate / max(1, scale)
            elif name == b"ICMT":
                out["comment"] = data[body:stop].rstrip(b"\x00")
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, k) for k in range(body, stop - 15, 16)]
            elif name[2:] in (b"dc", b"db"):
                listed.append(data[body:stop])
            at = body + size + size % 2

    walk(12, len(data))
    if index:  # offsets count from the movi list, or from the file's start
        named = [x for x in index if x[0][2:] in (b"dc", b"db")]
        base = movi if not named or data[movi + named[0][2] : movi + named[0][2] + 4] == named[0][0] else 0
        out["frames"] = [data[base + at + 8 : base + at + 8 + size] for _, _, at, size in named]
    else:
        out["frames"] = listed
    return out


def huffman(body: bytes):
    """Tables by (class, number): code lengths and symbols as {(length, code): symbol}."""
    out, at = {}, 0
    while at < len(body):
        kind, counts = body[at], body[at + 1 : at + 17]
        at, code, table = at + 17, 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = body[at]
                at, code = at + 1, code + 1
            code <<= 1
        out[kind >> 4, kind & 15] = table
    return out


_ONE = {(1, 0): 8}


def frame_head_of(frame: bytes) -> dict:
    """What a JPEG's segments say, and where its scan begins."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    out, at = {"quant": {}, "tables": {}, "restart": 0}, 2
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                out["quant"][body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int32)
                body = body[65:]
        elif marker == 0xC0:
            out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
            out["parts"] = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif marker == 0xC4:
            out["tables"] |= huffman(body)
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out["scan"] = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)}
            return out | {"at": at + 2 + size}
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only baseline frames are read")
        at += 2 + size


_heads: dict[bytes, dict] = {}


def unstuffed(scan: np.ndarray) -> list[np.ndarray]:
    """The entropy-coded bytes between restart markers, without stuffed zeros."""
    full = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[full + 1]
    drop, marks = full[after == 0] + 1, full[after != 0]
    keep = np.ones(len(scan), bool)
    keep[drop] = False
    moved = np.cumsum(keep)
    data, ends = scan[keep], moved[marks] - 1
    return [data[a:b] for a, b in zip([0, *(ends[:-1] + 2)], ends)]


def coefficients(frame: bytes) -> tuple[np.ndarray, dict]:
    """Quantised coefficients in zigzag order, (blocks, 64) in scan order with DC values summed up, and the head."""
    key = frame[: frame.index(b"\xff\xda") + 14]
    head = _heads.get(key) or frame_head_of(frame)
    if len(_heads) < 256:
        _heads[key] = head
    runs = unstuffed(np.frombuffer(frame, np.uint8, len(frame) - head["at"], head["at"]))
    if head["restart"] == 3 and len(head["parts"]) == 3 and all(t == _ONE for t in head["tables"].values()) and len({len(r) for r in runs}) == 1 and len(runs[0]) == UNIT * 9 // 8:
        bits = np.unpackbits(np.stack(runs), axis=1).reshape(len(runs), UNIT, 9)
        if not bits[:, :, 0].any():
            raw = np.packbits(bits[:, :, 1:], axis=2)[:, :, 0].astype(np.int32)
            out = np.where(raw < 128, raw - 255, raw).reshape(len(runs), 3, 3, 64)
            out[..., 0] = np.cumsum(out[..., 0], axis=1)
            return out.reshape(-1, 64), head
    return _by_symbols(runs, head), head


def _by_symbols(runs, head) -> np.ndarray:
    """Any baseline scan, symbol by symbol."""
    order = [(c, t) for c, h, v, _ in head["parts"] for t in [head["scan"][c]] for _ in range(h * v if len(head["parts"]) > 1 else 1)]
    out: list[list[int]] = []
    wide, high = 8 * max(p[1] for p in head["parts"]), 8 * max(p[2] for p in head["parts"])
    mcus = -(-head["width"] // wide) * -(-head["height"] // high)
    each = head["restart"] or mcus
    for run in runs:
        bits, at, last = np.unpackbits(run).tolist(), 0, {}

        def symbol(table):
            nonlocal at
            code = 0
            for length in range(1, 17):
                code, at = code << 1 | bits[at], at + 1
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("a code is not in its table")

        def amplitude(size):
            nonlocal at
            value = int("".join(map(str, bits[at : at + size])) or "0", 2)
            at += size
            return value if not size or value >> (size - 1) else value - (1 << size) + 1

        for _ in range(min(each, mcus - len(out) // len(order))):
            for part, (dc, ac) in order:
                block = [0] * 64
                block[0] = last[part] = last.get(part, 0) + amplitude(symbol(head["tables"][0, dc]))
                k = 1
                while k < 64:
                    run_size = symbol(head["tables"][1, ac])
                    if run_size == 0:
                        break
                    k += run_size >> 4
                    if run_size & 15:
                        block[k] = amplitude(run_size & 15)
                    k += 1
                out.append(block)
    return np.array(out, np.int32)


def stored_bytes(blocks: np.ndarray) -> bytes:
    """The payload bytes of a frame made by ``coded_frames``."""
    own = blocks.reshape(-1, 3, 3, 64).copy()
    own[:, 1:, :, 0] -= blocks.reshape(-1, 3, 3, 64)[:, :-1, :, 0]
    return np.where(own < 0, own + 255, own).astype(np.uint8).tobytes()


def histogram(blocks: np.ndarray, head: dict) -> np.ndarray:
    """Shares of the first component's samples by brightness."""
    each = [h * v if len(head["parts"]) > 1 else 1 for _, h, v, _ in head["parts"]]
    own = blocks.reshape(-1, sum(each), 64)[:, : each[0]].reshape(-1, 64) * head["quant"][head["parts"][0][3]]
    samples = np.clip(own.astype(np.float32) @ IDCT + 128.5, 0, 255).astype(np.uint8)
    return np.bincount(samples.ravel() >> 4, minlength=BINS) / samples.size


def shots(histograms: list[np.ndarray]) -> list[int]:
    """First frames of shots: where the histogram difference exceeds the running mean by DEVIATIONS running deviations."""
    cuts, mean, var, seen = [0], 0.0, 0.0, 0
    for k in range(1, len(histograms)):
        d = float(np.abs(histograms[k] - histograms[k - 1]).sum()) / 2
        if seen and d > max(FLOOR, mean + DEVIATIONS * var**0.5):
            cuts.append(k)
            continue
        weight = max(1 - MEMORY, 1 / (seen + 1))
        var = (1 - weight) * (var + weight * (d - mean) ** 2)
        mean, seen = mean + weight * (d - mean), seen + 1
    return cuts


def clips_of(data: bytes) -> tuple[list[tuple[float, float, int]], bytes, dict]:
    """Timed clips (start and end in seconds, frames), the payload read back, and what the container says."""
    film = parsed(data)
    payload, seen = [], []
    for frame in film["frames"]:
        blocks, head = coefficients(frame)
        seen.append(histogram(blocks, head))
        if film["comment"].isdigit():
            payload.append(stored_bytes(blocks))
    cuts = shots(seen)
    ends = [*cuts[1:], len(seen)]
    clips = [(a / film["rate"], b / film["rate"], b - a) for a, b in zip(cuts, ends)] if seen else []
    return clips, b"".join(payload)[: int(film["comment"] or b"0")], film


def padded(text: bytes) -> bytes:
    size = max(1, -(-len(text) // UNIT)) * UNIT
    return text + b"\xff" * (size - len(text))


def films(docs: DataFrame) -> DataFrame:
    """doc_id, film: each text stored as an AVI file."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(own, "doc_id long, film binary", lambda: lambda doc_id, text: (doc_id, [avi(padded(x)) for x in as_bytes(text)]))


def clips(rows: DataFrame) -> DataFrame:
    """doc_id, clip, start_s, end_s, frames: one row for each clip of the AVI files in ``film``. A null film has none; a broken one raises."""

    def f(doc_id, film):
        out = [(d, k, *c) for d, x in zip(doc_id.to_pylist(), film.to_pylist()) if x is not None for k, c in enumerate(clips_of(x)[0])]
        return list(zip(*out)) or [[]] * 5

    return map_batches(rows.select(F.col("doc_id").cast("long"), "film"), "doc_id long, clip int, start_s double, end_s double, frames int", lambda: f)


def media_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null text is an empty one (one unit of 255). Repeated rows give repeated rows, a null doc_id stays null, other columns are not
    looked at. Everything but n_bytes comes from the stored file as it is read back.
    """

    def f(doc_id, text):
        rows = []
        for x in as_bytes(text):
            film = avi(padded(x))
            found, payload, head = clips_of(film)
            feature = f"{head['width']}x{head['height']} frames={len(head['frames'])} clips=" + ",".join(f"{a:.2f}-{b:.2f}" for a, b, _ in found)
            rows.append((len(x), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(film), hashlib.sha256(film).hexdigest(), feature))
        return [doc_id, *zip(*rows)]

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(own, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", lambda: f)
