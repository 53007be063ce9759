"""AVI motion-JPEG columns: lossless storage of bytes, index parsing, intra decoding and shots.

Storage.  One minimum coded unit of an 8x8, 4:4:4 baseline frame has 3 x 64 coefficients, so 192 payload bytes
fill one unit.  A byte becomes the coefficient of size category 8 whose additional bits are that byte (128..255
as they are, 0..127 as value - 255), quantised by 1.  The one Huffman code in use is eight zero bits long, and a
restart marker follows each unit, so that a unit is 128 bytes a component and can be read without looking
at the others.  The result is an ordinary baseline JPEG and an ordinary indexed AVI file.

Reading takes any baseline JPEG: frames of the layout above are read at once, others code by code.

Shots.  Frames are compared by 32-bin luma histograms; a cut stands where the difference exceeds the mean of
the differences since the last cut by `spread` deviations and `floor`.  Each shot is a clip row with its times.

Defined results: a null or empty text has a payload of 192 blanks; equal bytes give equal files; a media value that is
null, cut off or no baseline motion-JPEG AVI gives null fields and no clips; an empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .shingles import row_slices

UNIT = 192
UNITS_PER_FRAME = 8
FPS = 25
#: The zigzag order of ITU-T T.81.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_k = np.arange(8)
COSINES = np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)
MARKER = re.compile(rb"\xff[\xd0-\xd7]")


def pad(data: bytes) -> bytes:
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int) -> bytes:
    one_code = bytes([0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 8])
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    scan = b"\x03" + b"".join(bytes([c, 0]) for c in (1, 2, 3)) + b"\x00\x3f\x00"
    tables = _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, frame) + _segment(0xC4, b"\x00" + one_code) + _segment(0xC4, b"\x10" + one_code)
    return b"\xff\xd8" + tables + _segment(0xDD, b"\x00\x01") + _segment(0xDA, scan)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode(data: bytes) -> bytes:
    """An AVI file that holds `pad(data)`; its comment has the length of `data`."""
    payload = pad(data)
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    per_frame = min(UNITS_PER_FRAME, len(units))
    count = -(-len(units) // per_frame)
    if count * per_frame > len(units):
        units = np.concatenate([units, np.full((count * per_frame - len(units), UNIT), 32, np.uint8)])
    head, tail = _head(8 * per_frame, 8), b"\xff\xd9"
    if (units == 255).any():
        scans = []
        for f in range(count):
            body = [np.stack([np.zeros(UNIT, np.uint8), u], 1).tobytes().replace(b"\xff", b"\xff\0") for u in units[f * per_frame : (f + 1) * per_frame]]
            scans.append(b"".join(x + (bytes([255, 0xD0 + i % 8]) if i + 1 < per_frame else b"") for i, x in enumerate(body)))
    else:
        coded = np.zeros((count, per_frame, 2 * UNIT + 2), np.uint8)
        coded[:, :, 1 : 2 * UNIT : 2] = units.reshape(count, per_frame, UNIT)
        coded[:, :, -2] = 255
        coded[:, :, -1] = 0xD0 + np.arange(per_frame) % 8
        flat = coded.reshape(count, -1)[:, :-2]
        scans = [row.tobytes() for row in flat]
    movi, index, at = [b"movi"], [], 4
    for scan in scans:
        chunk = _chunk(b"00dc", head + scan + tail)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(head) + len(scan) + 2))
        movi.append(chunk)
        at += len(chunk)
    width, largest = 8 * per_frame, max(map(len, movi))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, count, 0, 1, largest, width, 8, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, count, largest, 0xFFFFFFFF, 0, 0, 0, width, 8)
    image = struct.pack("<IiiHH4sIiiII", 40, width, 8, 1, 24, b"MJPG", width * 8 * 3, 0, 0, 0, 0)
    lists = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image)))
    lists += _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"bytes=%d\0" % len(data)))
    return _chunk(b"RIFF", b"AVI " + lists + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def frames_of(media: bytes) -> tuple[list[bytes], float, int | None]:
    """JPEG frames by the index (else in file order), frames a second, and the stored length if there is one."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found, index, movi, fps, length = [], [], 0, float(FPS), None
    for name, at, size in _chunks(media, 12, len(media)):
        kind = media[at : at + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            for inner, i, _ in _chunks(media, at + 4, at + size):
                if inner == b"avih" and (us := struct.unpack_from("<I", media, i)[0]):
                    fps = 1e6 / us
        elif kind == b"INFO":
            for inner, i, n in _chunks(media, at + 4, at + size):
                if inner == b"ICMT" and (m := re.match(rb"bytes=(\d+)", media[i : i + n])):
                    length = int(m[1])
        elif kind == b"movi":
            movi = at
            found = [(i, n) for inner, i, n in _chunks(media, at + 4, at + size) if inner[2:] in (b"dc", b"db")]
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", media, at + k) for k in range(0, size - 15, 16)]
    if entries := [(x[2], x[3]) for x in index if x[0][2:] in (b"dc", b"db")]:
        base = movi if media[movi + entries[0][0] : movi + entries[0][0] + 4] == index[0][0] else 0
        found = [(base + offset + 8, n) for offset, n in entries]
    return [media[i : i + n] for i, n in found], fps, length


def _codes(body: bytes) -> dict[int, dict[tuple[int, int], int]]:
    """Huffman tables of a segment: (length, code) to symbol, by class and number."""
    tables, at = {}, 0
    while at + 17 <= len(body):
        code, k, table = 0, at + 17, {}
        for length in range(1, 17):
            for _ in range(body[at + length]):
                table[length, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        tables[body[at]] = table
        at = k
    return tables


def _read_unit(bits: str, at: int, table: dict[tuple[int, int], int]) -> tuple[int, int]:
    code, length = 0, 0
    while length < 16:
        code, length = code << 1 | (bits[at + length] == "1"), length + 1
        if (length, code) in table:
            return table[length, code], at + length
    raise ValueError("bad Huffman code")


def _value(bits: str, at: int, size: int) -> int:
    raw = int(bits[at : at + size], 2) if size else 0
    return raw if not size or raw >> (size - 1) else raw - (1 << size) + 1


def decode_frame(jpeg: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each component: its coefficients in zigzag order, a row a block in coding order, and its quantisers."""
    at, quant, codes, parts, restart = 2, {}, {}, [], 0
    width = height = 0
    chosen: dict[int, int] = {}
    while at + 4 <= len(jpeg):
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                k += 129 if wide else 65
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif marker == 0xC4:
            codes |= _codes(body)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if not parts or not chosen or not min(width, height, *(min(p[1:3]) for p in parts)):
        raise ValueError("no frame or no scan")
    scan = jpeg[at : jpeg.rfind(b"\xff\xd9")]
    h, v = max(p[1] for p in parts), max(p[2] for p in parts)
    units = -(-width // (8 * h)) * -(-height // (8 * v)) if len(parts) > 1 else -(-width // 8) * -(-height // 8)
    quants = [quant[p[3]] for p in parts]
    plain = restart == 1 and len(parts) == 3 and all(p[1:3] == (1, 1) for p in parts) and all(t == {(8, 0): 8} for t in codes.values())
    if plain and len(scan) == units * (2 * UNIT + 2) - 2:
        coded = np.frombuffer(scan + b"\xff\xd0", np.uint8).reshape(units, -1)[:, : 2 * UNIT]
        if not (coded == 255).any():
            raw = coded[:, 1::2].astype(np.int64).reshape(units, 3, 64)
            values = np.where(raw < 128, raw - 255, raw)
            return [values[:, c] for c in range(3)], quants
    blocks: list[list[list[int]]] = [[] for _ in parts]
    shapes = [(p[0], p[1] * p[2] if len(parts) > 1 else 1) for p in parts]
    done = 0
    for run in MARKER.split(scan):
        run = run.replace(b"\xff\0", b"\xff")
        bits, k, last = bin(int.from_bytes(b"\x01" + run, "big"))[3:], 0, [0] * len(parts)
        for _ in range(min(restart or units, units - done)):
            for c, (name, each) in enumerate(shapes):
                dc, ac = codes[chosen[name] >> 4], codes[0x10 | chosen[name] & 15]
                for _ in range(each):
                    block = [0] * 64
                    size, k = _read_unit(bits, k, dc)
                    last[c] += _value(bits, k, size)
                    block[0], k, place = last[c], k + size, 1
                    while place < 64:
                        symbol, k = _read_unit(bits, k, ac)
                        run_length, size = symbol >> 4, symbol & 15
                        if not size and run_length != 15:
                            break
                        place += run_length
                        if size:
                            block[place], k = _value(bits, k, size), k + size
                        place += 1
                    blocks[c].append(block)
            done += 1
    return [np.array(b, np.int64).reshape(-1, 64) for b in blocks], quants


def luma(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit samples of each block."""
    square = np.zeros((len(coefficients), 64))
    square[:, ZIGZAG] = coefficients * quant
    return np.clip(np.rint(COSINES @ square.reshape(-1, 8, 8) @ COSINES.T) + 128, 0, 255).astype(np.uint8).reshape(-1, 64)


def histograms(frames: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Normalised 32-bin histograms of the luma of each frame."""
    if not frames:
        return np.zeros((0, 32))
    counts = [len(c) for c, _ in frames]
    samples = luma(np.concatenate([c * q for c, q in frames]), np.ones(64, np.int64)) >> 3
    bins = np.repeat(np.arange(len(frames)), counts)[:, None] * 32 + samples
    found = np.bincount(bins.ravel(), minlength=32 * len(frames)).reshape(-1, 32)
    return found / found.sum(1, keepdims=True)


def cuts(hist: np.ndarray, spread: float = 3.0, floor: float = 0.15) -> list[int]:
    """First frames of the shots."""
    starts, seen, total, square = [0] if len(hist) else [], 0, 0.0, 0.0
    for i, d in enumerate(np.abs(np.diff(hist, axis=0)).sum(1) / 2, 1):
        mean = total / seen if seen else 0.0
        if d > floor and (not seen or d > mean + spread * max(square / seen - mean * mean, 0.0) ** 0.5):
            starts.append(i)
            seen, total, square = 0, 0.0, 0.0
        else:
            seen, total, square = seen + 1, total + d, square + d * d
    return starts


def read(media: bytes) -> dict:
    """Payload, clips and a feature string of a stored file."""
    jpegs, fps, length = frames_of(media)
    decoded = [decode_frame(j) for j in jpegs]
    hist = histograms([(c[0], q[0]) for c, q in decoded])
    starts = cuts(hist)
    payload = None
    if length is not None and decoded:
        values = np.concatenate([np.stack(c, 1).reshape(-1) for c, _ in decoded])
        payload = np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()[: max(UNIT, -(-length // UNIT) * UNIT)]
    clips = [(k, a, b, round(1000 * a / fps), round(1000 * b / fps)) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(jpegs)], strict=True))]
    steps = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    feature = f"frames={len(jpegs)};shots={len(starts)};step={round(1000 * float(steps.max(initial=0.0)))};peak={int(hist.mean(0).argmax()) if len(hist) else -1}"
    return {"payload": payload, "clips": clips, "feature": feature}


def try_read(media: bytes | None) -> dict | None:
    """`read`, or None where the bytes can't be read."""
    if media is None:
        return None
    try:
        return read(media)
    except (ValueError, LookupError, struct.error):
        return None


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in row_slices(batch["text"]):
            raw = [t.encode() for t in batch["text"].slice(a, b - a).to_pylist()]
            columns = [batch["doc_id"].slice(a, b - a), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(x) for x in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an AVI file."""
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips string"
CLIPS = "doc_id long, clip long, first_frame long, end_frame long, start_ms long, end_ms long"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(a, b - a) for whole in batches for a, b in row_slices(whole["media"])):
        rows: list[tuple] = []
        for doc, n, media in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            found = try_read(media)
            if found is None:
                rows.append((doc, n, *[None] * 7))
                continue
            p = found["payload"]
            times = ",".join(f"{start}-{end}" for *_, start, end in found["clips"])
            own = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) if p is not None else (None,) * 3
            rows.append((doc, n, *own, len(media), hashlib.sha256(media).hexdigest(), found["feature"], times))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in STORED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True)], names)


def describe(media: DataFrame) -> DataFrame:
    """Digests, features and the clips (start-end in milliseconds, comma-joined) of stored files, read back."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_describe, STORED)


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc, *clip) for doc, media in zip(batch["doc_id"].to_pylist(), batch["media"].to_pylist(), strict=True) for clip in (try_read(media) or {"clips": []})["clips"]]
        names = [x.split()[0] for x in CLIPS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 6)], names)


def clips(media: DataFrame) -> DataFrame:
    """One row a shot, with its frames and times."""
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(_clips, CLIPS)
