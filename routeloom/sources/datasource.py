"""`spark.readStream.format("routes")`: a polled folder or endless file of live JSON lines, and dumps by path.

The built-in file source serves stores with atomic files; this source follows one growing file by byte offset, which is
what a feed writer leaves.  Each batch reads the whole lines between two offsets, dealt out over partitions.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from . import files, wire

PIECE = 8 << 20
#: Fixed value: the bytes by which a file is known.
HEAD = 1024


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def _lines(part: Span) -> Iterator[tuple[str]]:
    """Lines that begin in [start, end)."""
    with open(part.path, "rb") as f:
        if part.start:
            f.seek(part.start - 1)
            f.readline()
        while f.tell() < part.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield (line.decode("utf-8", "replace").rstrip("\r\n"),)


def _spans(path: str, start: int, end: int) -> list[Span]:
    return [Span(path, k, min(k + PIECE, end)) for k in range(start, end, PIECE)]


class LineStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        """The end of the last whole line."""
        if not os.path.exists(self.path):
            return {"byte": 0}
        size = os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            at = size
            while at:
                step = min(65536, at)
                f.seek(at - step)
                if (cut := f.read(step).rfind(b"\n")) >= 0:
                    return {"byte": at - step + cut + 1}
                at -= step
        return {"byte": 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _spans(self.path, start["byte"], end["byte"])

    def read(self, partition: Span) -> Iterator[tuple[str]]:
        return _lines(partition)

    def commit(self, end: dict) -> None:
        pass


def _messages(url: str, form: str) -> Iterator[wire.Frame]:
    """The messages of a whole file, in pieces."""
    system, path = files.store(url)
    size = system.get_file_info(path).size
    with system.open_input_file(path) as f:
        head = f.read(3)
        pack = "gzip" if head[:2] == b"\x1f\x8b" else "bzip2" if head == b"BZh" else "plain"
        yield from files.Messages(files.pieces(f, pack, size, 0, size), form)


#: What a pushed comparison of `time_sec` with a number means for the interval [begin, end].
BOUNDS = {GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0), EqualTo: (0, 0)}


class FrameReader(DataSourceReader):
    """Messages of dump files, a partition a file.

    Comparisons of `time_sec` are pushed down: messages outside the interval never leave the reader, and with the option `sorted` a file is left at
    its first message beyond.  Files go through in pieces, so memory is bounded.
    """

    def __init__(self, options: dict) -> None:
        self.paths, self.form, self.sorted = options["path"].split(","), options.get("format", "mrt"), options.get("sorted", "false").lower() == "true"
        self.begin: int | None = None
        self.end: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            low, high = BOUNDS.get(type(f), (None, None)) if getattr(f, "attribute", None) == ("time_sec",) else (None, None)
            if low is not None:
                self.begin = max(f.value + low, f.value + low if self.begin is None else self.begin)
            if high is not None:
                self.end = min(f.value + high, f.value + high if self.end is None else self.end)
            if low is None and high is None:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Span(p, 0, 0) for p in self.paths]

    def read(self, partition: Span) -> Iterator[tuple]:
        for seq, m in enumerate(_messages(partition.path, self.form)):
            if self.end is not None and m.sec > self.end and m.status != "S":
                if self.sorted:
                    return
            elif self.begin is None or m.sec >= self.begin:
                yield partition.path, seq, m.sec, m.usec, m.kind, m.subtype, m.body, m.status


class HeadStream(DataSourceStreamReader):
    """Files that are offered again when their head changes; the offset is the digest of each head.  A file that is not there has none."""

    def __init__(self, options: dict) -> None:
        self.paths, self.form = options["path"].split(","), options.get("format", "mrt")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for url in self.paths:
            system, path = files.store(url)
            if system.get_file_info(path).is_file:
                with system.open_input_file(path) as f:
                    found[url] = hashlib.sha256(f.read(HEAD)).hexdigest()
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Span(url, 0, 0) for url, digest in sorted(end.items()) if start.get(url) != digest]

    def read(self, partition: Span) -> Iterator[tuple]:
        for seq, m in enumerate(_messages(partition.path, self.form)):
            yield partition.path, seq, m.sec, m.usec, m.kind, m.subtype, m.body, m.status

    def commit(self, end: dict) -> None:
        pass


class Routes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "routes"

    def schema(self) -> str | StructType:
        return "value string" if self.options.get("format") == "lines" else "path string, seq bigint, time_sec bigint, time_usec int, kind int, subtype int, body binary, status string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LineStream(self.options) if self.options.get("format") == "lines" else HeadStream(self.options)
