"""Dump files as streams of messages in bounded memory, several tasks a file.

A file is opened in the task that reads it, by its literal name, and goes through in pieces: gzip members and bzip2 streams are inflated piece by
piece, so neither the file nor its plain bytes are ever whole in memory, and no size limit holds.

Large files are cut into ranges.  A range of a plain file is its bytes; a range of a bzip2 file is the blocks whose 48-bit mark begins
in it, each of which can be inflated alone.  Where the first message of a range begins is guessed from a chain of plausible
headers, and proved: the message before it, followed from the range before, has to end there, and so on from the file's
start.  A file in which a guess fails is read as one range.  Gzip cannot be entered midway and is one range.
"""

from __future__ import annotations

import bz2
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import checkpointed
from . import wire

PIECE = 1 << 20
#: Bytes of a range, as stored; a bzip2 byte costs far more to inflate than a plain one to read.
RANGES = {"plain": 64 << 20, "bzip2": 8 << 20}
TASK = 16 << 20
MARGIN = 3 << 20
#: The marks of a bzip2 block and of a stream's end; record kinds of the dump format.
BLOCK_MARK, END_MARK = 0x314159265359, 0x177245385090
KINDS = (11, 12, 13, 16, 17, 32, 33, 48, 49)
#: How many headers in a row, within how many seconds, make a guess.
CHAIN, NEAR = 16, 86400

SPLIT = "resource_id string, format string, url string, pack string, size bigint, part int, parts int, lo bigint, hi bigint, skip bigint, first bigint, fault string"
MESSAGE = "resource_id string, seq bigint, time_sec bigint, time_usec int, kind int, subtype int, router string, router_ip string, body binary, status string, skipped bigint"


def store(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the literal path in it."""
    scheme, found, rest = url.partition("://")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), rest if found else url.removeprefix("file:")
    authority, _, path = rest.partition("/")
    system, root = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}/")
    return system, f"{root.rstrip('/')}/{path}"


def _raw(file, lo: int, hi: int) -> Iterator[bytes]:
    file.seek(lo)
    while lo < hi and (data := file.read(min(PIECE, hi - lo))):
        lo += len(data)
        yield data


def _gunzipped(raw: Iterator[bytes]) -> Iterator[bytes]:
    opened = None
    for data in raw:
        while data:
            opened = opened or zlib.decompressobj(31)
            yield opened.decompress(data, PIECE)
            data, opened = (opened.unused_data, None) if opened.eof else (opened.unconsumed_tail, opened)
    while opened and not opened.eof:
        if not (rest := opened.decompress(b"", PIECE)):
            raise EOFError("gzip member is cut")
        yield rest


def _bunzipped(raw: Iterator[bytes]) -> Iterator[bytes]:
    opened = None
    for data in raw:
        while data or (opened and not opened.needs_input):
            opened = opened or bz2.BZ2Decompressor()
            yield opened.decompress(data, PIECE)
            data, opened = (opened.unused_data, None) if opened.eof else (b"", opened)
    if opened:
        raise EOFError("bzip2 stream is cut")


def marks(data: bytes) -> list[tuple[int, bool]]:
    """(bit, whether a block begins there) of the marks in a stretch of a bzip2 file."""
    raw, found = np.frombuffer(data, np.uint8), []
    for shift in range(8):
        moved = data if not shift else ((raw[:-1] << shift) | (raw[1:] >> (8 - shift))).astype(np.uint8).tobytes()
        for mark in (BLOCK_MARK, END_MARK):
            pattern, at = mark.to_bytes(6, "big"), -1
            while (at := moved.find(pattern, at + 1)) >= 0:
                found.append((8 * at + shift, mark == BLOCK_MARK))
    return sorted(found)


def _block(data: bytes, start: int, end: int) -> Iterator[bytes]:
    """The plain bytes of the block between two bits: a stream of its own, whose checksum is the block's."""
    bits = end - start
    value = int.from_bytes(data[start // 8 : (end + 7) // 8], "big") >> (-end % 8) & ((1 << bits) - 1)
    checksum = value >> (bits - 80) & 0xFFFFFFFF
    value = (value << 80) | (END_MARK << 32) | checksum
    bits += 80
    stream = b"BZh9" + (value << (-bits % 8)).to_bytes((bits + 7) // 8, "big")
    return _bunzipped(iter([stream]))


def _blocks(file, size: int, lo: int, hi: int) -> Iterator[tuple[bytes, bool]]:
    at = lo
    while at < size:
        file.seek(at)
        upto = min(max(hi, at) + MARGIN, size)
        data = file.read(upto - at)
        found = marks(data)
        following = upto - 6  # a mark that the end cuts in two begins there or later
        for k, (bit, begins) in enumerate(found):
            if begins and k + 1 == len(found):
                if upto == size:
                    raise EOFError("bzip2 block is cut")
                following = at + bit // 8
            elif begins:
                for piece in _block(data, bit, found[k + 1][0]):
                    yield piece, at + bit // 8 < hi
        if upto == size:
            return
        if following <= at:
            raise EOFError("bzip2 block without end")
        at = following


def pieces(file, pack: str, size: int, lo: int, hi: int) -> Iterator[tuple[bytes, bool]]:
    """Plain pieces from a range on, and whether they begin in it."""
    if pack == "plain":
        yield from ((x, True) for x in _raw(file, lo, hi))
        yield from ((x, False) for x in _raw(file, hi, size))
    elif pack == "bzip2" and (lo, hi) != (0, size):
        yield from _blocks(file, size, lo, hi)
    else:
        yield from ((x, True) for x in (_gunzipped if pack == "gzip" else _bunzipped)(_raw(file, lo, hi)))


class Messages:
    """The messages that begin in a range, in order.  Afterwards `over` is by how much the last one reaches beyond it, None if it broke off."""

    def __init__(self, plain: Iterator[tuple[bytes, bool]], form: str, skip: int = 0) -> None:
        self.plain, self.read, self.skip = plain, wire.bmp_at if form == "bmp" else wire.mrt_at, skip
        self.data, self.at, self.base, self.border, self.over = b"", 0, 0, None, None

    def more(self) -> bool:
        for piece, inside in self.plain:
            if not inside and self.border is None:
                self.border = self.base + len(self.data)
            if piece:
                self.data, self.base, self.at = self.data[self.at :] + piece, self.base + self.at, 0
                return True
        return False

    def __iter__(self) -> Iterator[wire.Frame]:
        try:
            while len(self.data) < self.skip and self.more():
                pass
            self.at = min(self.skip, len(self.data))
            while self.border is None or self.base + self.at < self.border:
                if self.at == len(self.data):
                    if self.more():
                        continue
                    break
                if (found := self.read(self.data, self.at)) is None:
                    if self.more():
                        continue
                    head = self.data[self.at : self.at + 12]
                    yield wire.Frame(int.from_bytes(head[:4], "big") if self.read is wire.mrt_at and len(head) == 12 else 0, 0, 0, 0, b"", status="S")
                    return
                yield found[0]
                if found[0].status == "S":
                    return
                self.at = found[1]
        except (EOFError, OSError, ValueError, struct.error, zlib.error):
            yield wire.Frame(0, 0, 0, 0, b"", status="S")
            return
        end = self.base + self.at
        self.over = end - (end if self.border is None else self.border)


def likely_start(data: bytes) -> int | None:
    """The first place from which `CHAIN` plausible headers follow one another, else that of the longest chain that leaves the data; None if there is none."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < 12:
        return None
    kind = (raw[4:-7].astype(np.int64) << 8) | raw[5:-6]
    subtype = (raw[6:-5].astype(np.int64) << 8) | raw[7:-4]
    best = (0, 0)
    for at in np.flatnonzero(np.isin(kind, KINDS) & (subtype < 16)).tolist():
        place, steps = at, 0
        begun = int.from_bytes(data[at : at + 4], "big")
        while steps < CHAIN and place + 12 <= len(data):
            sec, k, s, size = struct.unpack_from(">IHHI", data, place)
            if k not in KINDS or s >= 16 or size > PIECE or abs(sec - begun) > NEAR:
                break
            place, steps = place + 12 + size, steps + 1
        if steps == CHAIN:
            return at
        if place + 12 > len(data):
            best = max(best, (steps, -at))
    return -best[1] if best[0] else None


def _head(plain: Iterator[tuple[bytes, bool]]) -> tuple[bytes, Iterator[tuple[bytes, bool]]]:
    """The first bytes inside the range, and the pieces as before."""
    held, size = [], 0
    for piece in plain:
        held.append(piece)
        size += len(piece[0])
        if size >= PIECE or not piece[1]:
            break

    def again() -> Iterator[tuple[bytes, bool]]:
        yield from held
        yield from plain

    return b"".join(x for x, inside in held if inside), again()


def _planned(batches: Iterator[pd.DataFrame], ranges: dict[str, int]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SPLIT.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for rid, form, url in zip(batch["resource_id"], batch["format"], batch["url"], strict=True):
            pack, size, fault = "plain", 0, None
            try:
                if not url:
                    continue
                system, path = store(url)
                info = system.get_file_info(path)
                if info.type == fs.FileType.NotFound:
                    continue
                size = info.size
                with system.open_input_file(path) as file:
                    head = file.read(3)
                pack = "gzip" if head[:2] == b"\x1f\x8b" else "bzip2" if head == b"BZh" else "plain"
            except (OSError, ValueError, TypeError, pa.ArrowException):
                fault = "S"
            parts = max(1, -(-size // ranges[pack])) if form == "mrt" and pack in ranges and not fault else 1
            for part in range(parts):
                lo = part * ranges[pack] if parts > 1 else 0
                rows.append((rid, form, url, pack, size, part, parts, lo, min(lo + ranges[pack], size) if parts > 1 else size, 0, 0, fault))
        yield pd.DataFrame(rows, columns=names)


def _probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for s in batch.itertuples():
            system, path = store(s.url)
            start, n, over = None, 0, None
            try:
                with system.open_input_file(path) as file:
                    head, plain = _head(pieces(file, s.pack, s.size, s.lo, s.hi))
                    if head:
                        start = likely_start(head) if s.part else 0
                        start = -1 if start is None else start  # a range that has bytes but no message begins in it
                        found = Messages(plain, s.format, max(start, 0))
                        n = sum(1 for _ in found)
                        over = -2 if found.over is None or start < 0 else found.over
            except (OSError, EOFError):
                start, over = -1, -2
            rows.append((s.resource_id, s.part, start, n, over))
        yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=t) for k, (c, t) in enumerate({"resource_id": "object", "part": "int32", "skip": "Int64", "n": "int64", "over": "Int64"}.items())})


def splits(resources: DataFrame, ranges: dict[str, int] | None = None) -> DataFrame:
    """The ranges of the files of `resources` (resource_id, format, url), each with the place of its first message; missing files have none.

    Files are looked up in the tasks.  What is large enough to be cut is read once to prove the cuts.
    """
    sizes = {**RANGES, **(ranges or {})}
    planned = checkpointed(resources.select("resource_id", "format", "url").mapInPandas(lambda it: _planned(it, sizes), SPLIT))
    cut = planned.where("parts > 1")
    if cut.isEmpty():
        return planned
    probed = checkpointed(dealt(cut).mapInPandas(_probed, "resource_id string, part int, skip bigint, n bigint, over bigint"))
    order = Window.partitionBy("resource_id").orderBy("part")  # the ranges of one file
    chained = probed.where("skip is not null").withColumn("_met", F.coalesce(F.lag("over").over(order), F.lit(0)) == F.col("skip"))
    chained = chained.withColumn("_first", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sound = chained.groupBy("resource_id").agg(F.bool_and(F.col("_met") & (F.col("over") >= 0)).alias("_sound"))
    ends = chained.groupBy("resource_id").agg(F.max_by("over", "part").alias("_last"))
    files = sound.join(ends, "resource_id").select("resource_id", (F.col("_sound") & (F.col("_last") == 0)).alias("_sound"))
    placed = chained.select("resource_id", "part", F.col("skip").alias("_skip"), "_first")
    parts = cut.join(files.where("_sound"), "resource_id").join(placed, ["resource_id", "part"]).withColumn("skip", F.col("_skip")).withColumn("first", F.col("_first"))
    whole = cut.where("part = 0").join(files.where("_sound"), "resource_id", "left_anti").withColumn("parts", F.lit(1)).withColumn("hi", F.col("size"))
    return planned.where("parts = 1").unionByName(parts.select(*planned.columns)).unionByName(whole)


def dealt(ranges: DataFrame) -> DataFrame:
    """Ranges over tasks of about `TASK` stored bytes: rows are small, what they name is not."""
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0))).first()
    tasks = min(n, max(size // TASK, ranges.sparkSession.sparkContext.defaultParallelism))
    return ranges.repartition(max(1, tasks), "resource_id", "part")


def _wanted(begin: int | None, end: int | None, routers: tuple[str, ...]) -> Callable[[wire.Frame], bool]:
    def test(f: wire.Frame) -> bool:
        if f.status == "S" or (f.kind == wire.TABLE_DUMP_V2 and f.subtype == wire.PEER_TABLE):
            return True
        return (begin is None or f.sec >= begin) and (end is None or f.sec <= end) and (not routers or f.router in routers)

    return test


def selected(messages: Iterator[wire.Frame], first: int, begin: int | None = None, end: int | None = None, routers: tuple[str, ...] = (), stop: bool = False) -> Iterator[tuple]:
    """Rows (seq, ..., skipped) of a range's messages that are wanted, and, without a body, of its first and last message.

    `skipped` counts the messages left out since the row before.  With `stop` the range ends at its first message beyond `end`, which has a row without a body.
    """
    wanted, held, skipped = _wanted(begin, end, routers), None, 0
    for seq, f in enumerate(messages, first):
        keep = wanted(f)
        status = f.status if f.status != "V" or wire.supported(f.kind, f.subtype) else "U"
        row = (seq, f.sec, f.usec, f.kind, f.subtype, f.router, f.router_ip, f.body if keep else None, status)
        beyond = stop and not keep and end is not None and f.sec > end
        if keep or seq == first or beyond:
            yield (*row, skipped + (held is not None))
            held, skipped = None, 0
        else:
            skipped += held is not None
            held = row
        if beyond:
            return
    if held is not None:
        yield (*held, skipped)


def _read(batches: Iterator[pd.DataFrame], begin: int | None, end: int | None, routers: tuple[str, ...], stop: bool) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    for batch in batches:
        for s in batch.itertuples():
            rows: list[tuple] = []
            held = 0
            try:
                if s.fault:
                    raise OSError(s.fault)
                system, path = store(s.url)
                with system.open_input_file(path) as file:
                    found = Messages(pieces(file, s.pack, s.size, s.lo, s.hi), s.format, s.skip)
                    for row in selected(iter(found), s.first, begin, end, routers, stop):
                        rows.append((s.resource_id, *row))
                        held += len(row[7] or b"")
                        if len(rows) >= 5000 or held > 4 * PIECE:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
            except (OSError, pa.ArrowException):
                rows.append((s.resource_id, s.first, 0, 0, 0, 0, None, None, b"", "S", 0))
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_messages(resources: DataFrame, begin: int | None = None, end: int | None = None, routers: tuple[str, ...] = (), stop: bool = False, ranges: dict[str, int] | None = None) -> DataFrame:
    """MESSAGE rows of the files of `resources` (resource_id, format, url) as `selected`."""
    return dealt(checkpointed(splits(resources, ranges))).mapInPandas(lambda it: _read(it, begin, end, routers, stop), MESSAGE)
