"""Merged live feeds, hand-over from a backlog, and files that are offered again."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from routeloom.operators import records
from routeloom.plans.elems import elem_view
from routeloom.streaming import live
from tests.test_engine import mrt

SMALL = "/root/testdata/sf0.001"
RECORD = "collector string, time_sec long, time_usec int, rec_type string, resource_id string, seq long"
FEED = "collector string, peer_ip string, time_sec long, time_usec int, digest string"


def write(folder, parts, start=0):
    os.makedirs(folder, exist_ok=True)
    for k, rows in enumerate(parts, start):
        path = os.path.join(folder, f"{k}.json")
        with open(path, "w") as f:
            f.write("\n".join(map(json.dumps, rows)) + "\n")
        os.utime(path, (1_600_000_000 + k, 1_600_000_000 + k))


def collected(frame, name, mode="append", checkpoint=None):
    writer = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination(240)
    return frame.sparkSession.table(name).collect()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the tables")
def test_merged_feeds_are_in_the_merge_order(spark, tmp_path):
    """Files that come in an order of their own give the order of `rank_in_order`."""
    view = elem_view(spark, SMALL).select("collector", "time_sec", "time_usec", "rec_type", F.concat("project", "elem_type").alias("resource_id"), F.col("event_id").alias("seq"))
    rows = [r.asDict() for r in view.orderBy("time_sec").collect()]
    rng, parts = random.Random(2), []
    for k in range(0, len(rows), 100):  # out of order within what the watermark allows
        part = rows[k : k + 100]
        rng.shuffle(part)
        parts.append(part)
    end = [{**rows[-1], "collector": "end", "time_sec": rows[-1]["time_sec"] + 10**7}]
    write(str(tmp_path / "in"), [*parts, end])
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = collected(live.merged(live.with_time(stream, "30 days"), "1 day"), "merged")
    by = {}
    for r in sorted(got, key=lambda r: (r.slice, r.place)):
        by.setdefault(r.collector, []).append(r.seq)
    expected = {}
    for r in sorted(records.rank_in_order(view, ["collector"]).collect(), key=lambda r: r.place):
        expected.setdefault(r.collector, []).append(r.seq)
    assert by == expected
    batch = live.merged(live.with_time(view), "1 day").collect()
    assert sorted((r.slice, r.place, r.seq) for r in batch) == sorted((r.slice, r.place, r.seq) for r in got)


def test_hand_over_gives_each_record_once(spark, tmp_path):
    row = lambda c, t, d, p="10.0.0.1": {"collector": c, "peer_ip": p, "time_sec": t, "time_usec": 0, "digest": d}
    backlog = [row("a", t, f"d{t}") for t in range(0, 5000, 10)] + [row("b", 100, "x"), row("b", 100, "y", None), row(None, 7, "z")]
    feed = [[row("a", t, f"d{t}") for t in range(4500, 5000, 10)], [row("b", 100, "x"), row("b", 100, "y", None), row("b", 100, "new"), row("c", 1, "c"), row(None, 7, "z"), row(None, 8, "z")]]
    more = [[row("a", t, f"d{t}") for t in range(4900, 5200, 10)], [row("a", 5190, "d5190"), row("a", 5190, "other"), row("a", 20, "d20")]]
    old = spark.createDataFrame([tuple(r.values()) for r in backlog], FEED)
    write(str(tmp_path / "in"), feed)
    stream = lambda: live.with_time(spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), "3 hours")
    sink, tail, check = (str(tmp_path / x) for x in ("out", "tail", "check"))
    live.start(live.hand_over(old, stream(), tail).drop("ts"), sink, check).awaitTermination(240)
    write(str(tmp_path / "in"), more, start=2)  # the feed goes on, repeats itself, and the query starts again
    grown = old.unionByName(spark.createDataFrame([("a", "10.0.0.1", 5190, 0, "d5190")], FEED))
    live.start(live.hand_over(grown, stream(), tail).drop("ts"), sink, check).awaitTermination(240)
    got = sorted((r.collector or "", r.time_sec, r.digest) for r in spark.read.schema(FEED).parquet(sink).collect())
    everything = {(r["collector"], r["peer_ip"], r["time_sec"], r["digest"]) for part in feed + more for r in part}
    known = {(r["collector"], r["peer_ip"], r["time_sec"], r["digest"]) for r in backlog}
    assert got == sorted((c or "", t, d) for c, _, t, d in everything - known)


def test_a_file_is_read_again_when_its_head_changes(spark, tmp_path):
    def dump(sec, n=3, tail=b""):
        return b"".join(mrt(sec + k, 16, 4, bytes(500)) for k in range(n)) + tail

    paths = [str(tmp_path / x) for x in ("a", "b[1]", "none")]
    for path, sec in zip(paths, (100, 200)):
        with open(path, "wb") as f:
            f.write(dump(sec))
    check = str(tmp_path / "check")

    def again():
        sink = str(tmp_path / f"out{len(os.listdir(tmp_path))}")
        frame = live.follow_file(spark, ",".join(paths)).select("path", "time_sec")
        query = frame.writeStream.foreachBatch(lambda rows, _: rows.write.mode("append").parquet(sink)).option("checkpointLocation", check).trigger(once=True).start()
        query.awaitTermination(120)
        return sorted((os.path.basename(r.path), r.time_sec) for r in spark.read.schema("path string, time_sec long").parquet(sink).collect()) if os.path.isdir(sink) else []

    assert again() == [("a", 100), ("a", 101), ("a", 102), ("b[1]", 200), ("b[1]", 201), ("b[1]", 202)]
    assert again() == []
    with open(paths[0], "ab") as f:  # the head is as it was
        f.write(dump(110, 1))
    assert again() == []
    with open(paths[1], "wb") as f:
        f.write(dump(300, 2))
    assert again() == [("b[1]", 300), ("b[1]", 301)]
    with open(paths[2], "wb") as f:
        f.write(dump(400, 1))
    assert again() == [("none", 400)]
