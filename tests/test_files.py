"""Dump files in bounded memory: pieces, ranges, pushed filters, literal names and broken sources."""

import bz2
import gzip
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from routeloom.operators import filters as flt
from routeloom.sources import catalog, datasource, dumps, files, wire
from tests.test_engine import ATTRS, dump_bytes, mrt, nlri, update


START = 1_700_000_000


def long_dump(n, seed=1, span=1000, lengths=(0, 400), start=START):
    """Messages of varied length with rising times; bodies are noise, which often looks like a header but for its time."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        body = bytes(rng.choices((0, 0, 0, 13, 16, 4, 255, 7), k=rng.randint(*lengths)))
        out.append(mrt(start + k * span // n, 16, 4, body))
    return b"".join(out)


def resources(spark, *urls, form="mrt"):
    rows = [("file", form, u, 100 + k, 300, "ris", "rrc0", "updates", {}) for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, catalog.RESOURCE)


def whole(data):
    return [(f.sec, f.kind, f.body, f.status) for f in wire.frame_mrt(data)]


@pytest.mark.parametrize("pack", ["plain", "gzip", "members", "bzip2", "streams"])
@pytest.mark.parametrize("cut", [0, 5])
def test_pieces_give_the_messages_of_the_whole(tmp_path, monkeypatch, pack, cut):
    monkeypatch.setattr(files, "PIECE", 1000)
    data = long_dump(500)
    half = len(data) // 2
    stored = {"plain": data, "gzip": gzip.compress(data), "members": gzip.compress(data[:half]) + gzip.compress(data[half:]), "bzip2": bz2.compress(data, 1), "streams": bz2.compress(data[:half]) + bz2.compress(data[half:])}[pack]
    stored = stored[: len(stored) - cut]
    (tmp_path / "d").write_bytes(stored)
    kind = {"plain": "plain", "gzip": "gzip", "members": "gzip"}.get(pack, "bzip2")
    with open(tmp_path / "d", "rb") as f:
        found = [(m.sec, m.kind, m.body, m.status) for m in files.Messages(files.pieces(f, kind, len(stored), 0, len(stored)), "mrt")]
    expected = whole(data)
    assert found == expected if not cut else found[-1][3] == "S" and found[:-1] == expected[: len(found) - 1]


@pytest.mark.parametrize("level", [1, 9])
def test_bzip2_blocks_inflate_alone(tmp_path, level):
    data = random.Random(level).randbytes(700_000) + b"a" * 3_000_000 + random.Random(2).randbytes(300_000)
    stored = bz2.compress(data, level) + bz2.compress(b"tail" * 1000)
    (tmp_path / "d").write_bytes(stored)
    for step in (70_000, 400_000, len(stored)):
        got = b""
        with open(tmp_path / "d", "rb") as f:
            for lo in range(0, len(stored), step):
                got += b"".join(x for x, inside in files._blocks(f, len(stored), lo, min(lo + step, len(stored))) if inside)
        assert got == data + b"tail" * 1000


@pytest.mark.parametrize("pack", ["plain", "bzip2"])
def test_ranges_of_a_file_meet(spark, tmp_path, pack):
    """Several tasks read one file and number its messages as one would."""
    data = long_dump(9000, lengths=(0, 700))
    stored = data if pack == "plain" else bz2.compress(data, 1)
    (tmp_path / "d").write_bytes(stored)
    table = resources(spark, str(tmp_path / "d"))
    ranges = {"plain": 200_000, "bzip2": len(stored) // 5}
    cut = files.splits(table.withColumn("resource_id", F.lit("r")), ranges)
    assert cut.count() >= 5
    rows = dumps.messages(table, ranges=ranges).orderBy("seq").collect()
    assert [(r.seq, r.time_sec, r.kind, bytes(r.body), r.status) for r in rows] == [(k, *m[:3], "V") for k, m in enumerate(whole(data))]
    part = dumps.messages(table, flt.Filters().between(START + 300, START + 400), ranges=ranges).orderBy("seq").collect()
    kept = [(k, m[2]) for k, m in enumerate(whole(data)) if START + 300 <= m[0] <= START + 400]
    assert [(r.seq, bytes(r.body)) for r in part if r.body is not None] == kept
    assert len(part) + sum(r.skipped for r in part) == 9000 and {0, 8999} <= {r.seq for r in part}


def test_a_wrong_guess_is_found_out(spark, tmp_path, monkeypatch):
    """A body of whole messages misleads the guess; the proof fails and the file is one range."""
    inner = long_dump(3000, seed=4)
    data = long_dump(10) + mrt(START + 500, 16, 4, inner) + long_dump(2000, seed=5)
    (tmp_path / "d").write_bytes(data)
    table = resources(spark, str(tmp_path / "d"))
    ranges = {"plain": len(inner) // 3}
    assert files.splits(table.withColumn("resource_id", F.lit("r")), ranges).count() == 1
    rows = dumps.messages(table, ranges=ranges).orderBy("seq").collect()
    assert [(r.time_sec, bytes(r.body)) for r in rows] == [(m[0], m[2]) for m in whole(data)]


def test_a_cut_large_file_keeps_what_is_before(spark, tmp_path):
    data = long_dump(4000)[:-7]
    (tmp_path / "d").write_bytes(data)
    rows = dumps.messages(resources(spark, str(tmp_path / "d")), ranges={"plain": 100_000}).orderBy("seq").collect()
    assert [r.status for r in rows] == ["V"] * 3999 + ["S"]


def test_memory_is_bounded(tmp_path):
    """Three hundred MB of messages in a small file are read within a few pieces."""
    one = mrt(100, 16, 4, bytes(300_000))
    with gzip.open(tmp_path / "d.gz", "wb", compresslevel=1) as f:
        for _ in range(1000):
            f.write(one)
    size = (tmp_path / "d.gz").stat().st_size
    tracemalloc.start()
    with open(tmp_path / "d.gz", "rb") as f:
        n = sum(len(m.body) for m in files.Messages(files.pieces(f, "gzip", size, 0, size), "mrt"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300_000_000 and peak < 12 << 20


def test_literal_names_and_bad_addresses(spark, tmp_path):
    names = ["a[1].mrt", "b{x}.mrt", "c*.mrt", "d?.mrt", "e f.mrt", "é.mrt"]
    for n in names:
        (tmp_path / n).write_bytes(dump_bytes())
    (tmp_path / "cx.mrt").write_bytes(b"")
    good = [str(tmp_path / n) for n in names] + [f"file://{tmp_path}/a[1].mrt"]
    table = resources(spark, *good, None, "", "http://example.invalid/x", "nope://x/y", str(tmp_path), str(tmp_path / "none"))
    found = {}
    for r in dumps.records(table).collect():
        found.setdefault(r.dump_time - 100, []).append(r.status)
    assert all(found[k] == ["V"] * 3 for k in range(7))
    assert [found[k] for k in range(7, 13)] == [["E"], ["E"], ["S"], ["S"], ["S"], ["E"]]
    assert dumps.elems(table).groupBy("resource_id").count().where("count = 6").count() == 7


def test_early_stop_over_ranges(spark, tmp_path):
    data = long_dump(3000)
    (tmp_path / "d").write_bytes(data)
    f = flt.Filters().between(START + 400, START + 500)
    rows = dumps.records(resources(spark, str(tmp_path / "d")), f, early_stop=True).orderBy("seq").collect()
    times = [m[0] for m in whole(data)]
    kept = [k for k, t in enumerate(times) if START + 400 <= t <= START + 500]
    assert [(r.seq, r.status) for r in rows] == [(k, "V") for k in kept] + [(kept[-1] + 1, "O")]
    assert [r.dump_pos for r in rows][-1] == "E" and {r.dump_pos for r in rows[:-1]} == {"M"}


def test_pushed_times_leave_the_file(spark, tmp_path, monkeypatch):
    data = long_dump(20_000)
    (tmp_path / "d").write_bytes(data)
    spark.dataSource.register(datasource.Routes)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("routes").option("path", str(tmp_path / "d"))
        for options in ({}, {"sorted": "true"}):
            rows = read.options(**options).load().where(f"time_sec >= {START + 200} and time_sec < {START + 210} and kind = 16").orderBy("seq")
            expected = [(k, m[0], m[2]) for k, m in enumerate(whole(data)) if START + 200 <= m[0] < START + 210]
            assert [(r.seq, r.time_sec, bytes(r.body)) for r in rows.collect()] == expected
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    drawn = {}
    real = files._raw
    for name in ("false", "true"):
        reader = datasource.FrameReader({"path": str(tmp_path / "d"), "sorted": name})
        rest = list(reader.pushFilters([datasource.LessThanOrEqual(("time_sec",), START + 50), datasource.GreaterThan(("time_sec",), START + 20), datasource.EqualTo(("kind",), 16)]))
        assert [type(f) for f in rest] == [datasource.EqualTo] and (reader.begin, reader.end) == (START + 21, START + 50)
        drawn[name] = 0

        def counted(file, lo, hi, name=name):
            for x in real(file, lo, hi):
                drawn[name] += len(x)
                yield x

        monkeypatch.setattr(files, "_raw", counted)
        monkeypatch.setattr(files, "PIECE", 1 << 14)
        assert {r[2] for r in reader.read(reader.partitions()[0])} == set(range(START + 21, START + 51))
    assert drawn["false"] == len(data) and drawn["true"] < len(data) / 8


def test_bmp_messages_across_pieces(monkeypatch):
    peer = bytes([0, 0]) + b"\0" * 8 + b"\0" * 12 + bytes([10, 0, 0, 1]) + (65001).to_bytes(4, "big") + b"\0" * 4 + bytes(8)
    body = peer + update(attrs=ATTRS, new=nlri("10.2.0.0/16"))
    message = bytes([3]) + (6 + len(body)).to_bytes(4, "big") + bytes([0]) + body
    name = b"router-1"
    header = bytes([0x80, 12]) + (777).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes(16) + b"\0\0" + bytes(16) + bytes([10, 9, 8, 7]) + bytes(12) + len(name).to_bytes(2, "big") + name
    binary = b"OBMP" + bytes([1, 7]) + (12 + len(header)).to_bytes(2, "big") + len(message).to_bytes(4, "big") + header
    data = message + binary + message + b"V: 1.7\nX: y\n\n" + message
    for step in (1, 7, len(data)):
        found = list(files.Messages(iter([(data[k : k + step], True) for k in range(0, len(data), step)]), "bmp"))
        assert [(f.sec, f.usec, f.router, f.router_ip, f.status) for f in found] == [(0, 0, None, None, "V"), (777, 5, "router-1", "10.9.8.7", "V"), (0, 0, None, None, "V")]
    assert [f.status for f in files.Messages(iter([(data[:-3], True)]), "bmp")][-1] == "S"
    assert [f.status for f in files.Messages(iter([(b"\3\0\0\0\1\0", True)]), "bmp")] == ["S"]
