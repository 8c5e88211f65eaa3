"""AVI motion-JPEG columns: bytes in, an AVI file out, and back.

``encode`` lays a payload out as baseline JPEG frames in a RIFF/AVI file.  The
unit that holds a byte is the quantised DCT coefficient: with a quantiser of one
and coefficients of size category 8, the category's 256 values are the bytes, so
every frame is an ordinary baseline JPEG and the bytes come back exactly.
Blocks that carry data hold 32 coefficients; a blank block ends the data.

``frames`` parses the RIFF index (or the movi list where an index is missing),
``coefficients`` decodes a frame's entropy-coded data (any baseline, one-component
Huffman tables; a vectorised path for tables in which all data symbols have one
length), ``pixels`` applies an exact integer inverse transform, and ``clips``
detects shots where the luma histogram changes by more than the mean plus
``k`` deviations of the differences around it.

Defined results: a null or empty payload becomes 64 zero bytes, one frame, one
clip; a file without frames has no clips; equal bytes give equal files; a very long text becomes one
file of as many frames as it needs, held in memory by itself; repeated rows each give a row; an empty table
gives an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAD = 64
PER_BLOCK = 32
GRID = (16, 8)  # blocks across and down
FRAME_BYTES = GRID[0] * GRID[1] * PER_BLOCK
FPS = 25


def _zigzag() -> np.ndarray:
    """Row-major positions of the 64 coefficients in coding order."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


ZIGZAG = _zigzag()


def _inverse() -> np.ndarray:
    """The inverse transform, scaled by 256 and rounded: 64 coefficients in coding order to 64 pixels."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(0.125), 0.5)
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.rint(full[ZIGZAG] * 256).astype(np.float32)


_IDCT = _inverse()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables(kind: int, codes: list[tuple[int, int]]) -> bytes:
    """A DHT segment from (length, symbol) in code order."""
    counts = [sum(1 for n, _ in codes if n == length) for length in range(1, 17)]
    return _segment(0xC4, bytes([kind, *counts, *(s for _, s in codes)]))


_HEAD = (
    b"\xff\xd8"
    + _segment(0xE0, b"AVI1" + bytes(10))
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, GRID[1] * 8, GRID[0] * 8, 1) + b"\x01\x11\x00")
    + _tables(0x00, [(1, 0)])
    + _tables(0x10, [(1, 8), (2, 0)])
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
#: a data block: DC code 0, then (code 0, eight bits) for each byte, then the end code 10
_BLOCK_BITS = 1 + 9 * PER_BLOCK + 2
_BLANK = np.array([0, 1, 0], np.uint8)


def encode_frame(data: np.ndarray) -> bytes:
    """One JPEG from up to FRAME_BYTES bytes, a multiple of PER_BLOCK."""
    blocks = len(data) // PER_BLOCK
    bits = np.zeros((blocks, _BLOCK_BITS), np.uint8)
    bits[:, 1 : 1 + 9 * PER_BLOCK].reshape(blocks, PER_BLOCK, 9)[:, :, 1:] = np.unpackbits(data).reshape(blocks, PER_BLOCK, 8)
    bits[:, -2] = 1
    stream = np.concatenate([bits.ravel(), np.tile(_BLANK, GRID[0] * GRID[1] - blocks)])
    stream = np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])
    return _HEAD + np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def padded(payload: bytes) -> bytes:
    return payload + bytes(PAD if not payload else -len(payload) % PAD)


def encode(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI file whose frames hold ``payload`` (a positive multiple of 64 bytes)."""
    data = np.frombuffer(payload, np.uint8)
    images = [encode_frame(data[i : i + FRAME_BYTES]) for i in range(0, len(data), FRAME_BYTES)]
    width, height = GRID[0] * 8, GRID[1] * 8
    largest = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(images), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(images), largest, 10000, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for image in images:
        part = _chunk(b"00dc", image)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(image)))
        movi.append(part)
        at += len(part)
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        yield name, start + 8, min(start + 8 + size, end)
        start += 8 + size + size % 2


def frames(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the JPEG frames of an AVI file, by its index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = float(FPS), None, None
    for name, a, b in _walk(data, 12, len(data)):
        if name == b"LIST" and data[a : a + 4] == b"hdrl":
            for inner, c, _ in _walk(data, a + 4, b):
                if inner == b"avih":
                    fps = 1e6 / max(1, struct.unpack_from("<I", data, c)[0])
        elif name == b"LIST" and data[a : a + 4] == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = (a, b)
    if movi is None:
        return fps, []
    if index is None:
        return fps, [data[a:b] for name, a, b in _walk(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    out, base = [], None
    for i in range(index[0], index[1] - 15, 16):
        name, _, at, size = struct.unpack_from("<4sIII", data, i)
        if base is None:  # offsets count from the list or from the file
            base = movi[0] if data[movi[0] + at : movi[0] + at + 4] == name else 0
        if name[2:] in (b"dc", b"db"):
            out.append(data[base + at + 8 : base + at + 8 + size])
    return fps, out


_known: tuple[bytes, dict] | None = None


def _parse(image: bytes) -> dict:
    """The header of a frame; the last one seen is kept, as a file's frames share it."""
    global _known
    if _known is None or not image.startswith(_known[0]):
        head = _segments(image)
        head["books"] = _codebook(head["huff"][head["dc"]]), _codebook(head["huff"][head["ac"]])
        _known = image[: head["scan"]], head
    return _known[1]


def _segments(image: bytes) -> dict:
    """The segments of a baseline JPEG with one component."""
    out: dict = {"huff": {}, "quant": {}}
    at = 2
    while at + 4 <= len(image):
        marker, size = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        body = image[at + 4 : at + 2 + size]
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huff"][body[0]] = (tuple(body[1:17]), body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                out["quant"][body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int32)
                body = body[65:]
        elif marker == 0xC0:
            _, out["height"], out["width"], parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("one component expected")
            out["q"] = body[8]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("baseline frames only")
        elif marker == 0xDA:
            out["dc"], out["ac"] = body[2] >> 4, 0x10 | (body[2] & 15)
            out["scan"] = at + 2 + size
            return out
        at += 2 + size
    raise ValueError("no scan in this frame")


def _codebook(table: tuple) -> dict[tuple[int, int], int]:
    counts, symbols = table
    book, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            book[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return book


def _slow(bits: np.ndarray, blocks: int, dc: dict, ac: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sequential Huffman decoding with any tables."""
    out, used, at, pred = np.zeros((blocks, 64), np.int32), np.zeros(blocks, np.int64), 0, 0

    def symbol(book: dict) -> int:
        nonlocal at
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(bits[at])
            at += 1
            if (length, code) in book:
                return book[length, code]
        raise ValueError("bad code")

    def value(size: int) -> int:
        nonlocal at
        v = 0
        for _ in range(size):
            v = v << 1 | int(bits[at])
            at += 1
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    for b in range(blocks):
        pred += value(symbol(dc))
        out[b, 0] = pred
        k = 1
        while k < 64:
            s = symbol(ac)
            if s == 0:
                break
            if s == 0xF0:
                k += 16
                continue
            k += s >> 4
            out[b, k] = value(s & 15)
            used[b] += 1
            k += 1
    return out, used


def coefficients(image: bytes) -> tuple[np.ndarray, np.ndarray, dict]:
    """Quantised coefficients in coding order (blocks x 64), coded AC values a block, the frame's header."""
    head = _parse(image)
    body = image[head["scan"] :]
    end = body.rfind(b"\xff\xd9")
    bits = np.unpackbits(np.frombuffer(body[: end if end >= 0 else len(body)].replace(b"\xff\x00", b"\xff"), np.uint8))
    blocks = -(-head["width"] // 8) * -(-head["height"] // 8)
    dc, ac = head["books"]
    if dc == {(1, 0): 0} and ac == {(1, 0): 8, (2, 2): 0}:
        full = _uniform(bits, blocks)
        if full is not None:
            return (*full, head)
    return (*_slow(bits, blocks, dc, ac), head)


def _uniform(bits: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The vectorised path: ``data`` full blocks and then blank ones; None for another layout."""
    spare = len(bits) - 3 * blocks
    data = spare // (_BLOCK_BITS - 3)
    if not 0 <= data <= blocks:
        return None
    grid = bits[: data * _BLOCK_BITS].reshape(data, _BLOCK_BITS)
    cells = grid[:, 1 : 1 + 9 * PER_BLOCK].reshape(data, PER_BLOCK, 9)
    tail = bits[data * _BLOCK_BITS : data * _BLOCK_BITS + 3 * (blocks - data)].reshape(-1, 3)
    if grid[:, 0].any() or cells[:, :, 0].any() or not (grid[:, -2:] == (1, 0)).all() or not (tail == _BLANK).all():
        return None
    raw = np.packbits(cells[:, :, 1:].reshape(-1, 8), axis=1).reshape(data, PER_BLOCK).astype(np.int32)
    out, used = np.zeros((blocks, 64), np.int32), np.zeros(blocks, np.int64)
    out[:data, 1 : 1 + PER_BLOCK] = np.where(raw >= 128, raw, raw - 255)
    used[:data] = PER_BLOCK
    return out, used


def samples(coef: np.ndarray, used: np.ndarray) -> bytes:
    """The bytes that ``encode_frame`` stored."""
    v = coef[used == PER_BLOCK, 1 : 1 + PER_BLOCK]
    return np.where(v < 0, v + 255, v).astype(np.uint8).tobytes()


def pixels(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Luma of each block; integer products below 2**24, so exact in any order of summation."""
    scaled = (coef * quant).astype(np.float32) @ _IDCT
    return np.clip(np.floor((scaled + np.float32(128 * 256 + 128)) * np.float32(1 / 256)), 0, 255).astype(np.uint8)


def histogram(luma: np.ndarray, bins: int = 16) -> np.ndarray:
    return np.bincount((luma >> 4).ravel(), minlength=bins)[:bins]


def clips(hists: list[np.ndarray], fps: float, window: int = 12, k: float = 2.5, least: float = 0.02) -> list[tuple[int, int, float, float]]:
    """(first frame, frame after the last, start s, end s) of each shot."""
    if len(hists) < 2:
        return [(0, 1, 0.0, round(1 / fps, 3))] if hists else []
    h = np.array(hists, np.float64)
    h /= np.maximum(h.sum(axis=1, keepdims=True), 1)
    diff = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    bounds = [0]
    for i, d in enumerate(diff):
        around = np.delete(diff[max(0, i - window) : i + window + 1], min(i, window))
        limit = least if not len(around) else max(least, round(float(around.mean() + k * around.std()), 9))
        if d > limit:
            bounds.append(i + 1)
    bounds.append(len(hists))
    return [(a, b, round(a / fps, 3), round(b / fps, 3)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def analyse(data: bytes) -> tuple[bytes, list[tuple[int, int, float, float]]]:
    """The payload read back from an AVI file, and its clips."""
    fps, images = frames(data)
    payload, hists = [], []
    for image in images:
        coef, used, head = coefficients(image)
        payload.append(samples(coef, used))
        live = used > 0
        hists.append(histogram(pixels(coef[live] if live.any() else coef[:1], head["quant"][head["q"]])))
    return b"".join(payload), clips(hists, fps)


_CLIP = T.ArrayType(
    T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])
)


def _rows(keep_media: bool, chunk: int = 64):
    clip = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                cols: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips", "media")}
                for text in part.column("text").cast(pa.large_binary()):
                    raw = text.as_py() or b""
                    media = encode(padded(raw))
                    back, found = analyse(media)
                    cols["n_bytes"].append(len(raw))
                    cols["payload_bytes"].append(len(back))
                    cols["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                    cols["tail_crc32"].append(zlib.crc32(back[-PAD:]))
                    cols["media_bytes"].append(len(media))
                    cols["media_sha256"].append(hashlib.sha256(media).hexdigest())
                    cols["clips"].append([dict(zip(("first", "stop", "start_s", "end_s"), c, strict=True)) for c in found])
                    cols["media"].append(media if keep_media else None)
                i, s = pa.int64(), pa.string()
                kinds = {"n_bytes": i, "payload_bytes": i, "payload_sha256": s, "tail_crc32": i, "media_bytes": i, "media_sha256": s, "clips": clip, "media": pa.binary()}
                names = [c for c in kinds if c != "media" or keep_media]
                yield pa.record_batch([part.column("doc_id"), *(pa.array(cols[c], kinds[c]) for c in names)], names=["doc_id", *names])

    return run


def media_rows(docs: DataFrame, keep_media: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sizes and digests, the clips, and the file itself if ``keep_media``."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    i, s = T.LongType(), T.StringType()
    fields = {"n_bytes": i, "payload_bytes": i, "payload_sha256": s, "tail_crc32": i, "media_bytes": i, "media_sha256": s, "clips": _CLIP}
    fields |= {"media": T.BinaryType()} if keep_media else {}
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), *(T.StructField(k, v) for k, v in fields.items())])
    return src.mapInArrow(_rows(keep_media), schema)


def clip_rows(rows: DataFrame) -> DataFrame:
    """One row per timed clip."""
    return rows.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", F.col("clip").cast("long"), "c.first", "c.stop", "c.start_s", "c.end_s")


def digest(rows: DataFrame) -> DataFrame:
    parts = F.transform("clips", lambda c: F.concat(c["start_s"].cast("string"), F.lit("-"), c["end_s"].cast("string")))
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat(F.lit("clips="), F.size("clips").cast("string"), F.lit(";"), F.array_join(parts, ",")).alias("feature"),
    )
