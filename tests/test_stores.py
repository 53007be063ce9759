"""Stores that grow: ids stay, go on, and come out equal when a batch is repeated."""

import json
import os

from pyspark.sql import functions as F

from routeloom.functions import aspath
from routeloom.operators import intern, stores
from routeloom.streaming import live

ROWS = "collector string, peer_ip string, peer_asn bigint, seen bigint, as_path string"


def batch(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("path", aspath.parse_path(F.col("as_path")))


FIRST = [("a", "1", 1, 5, "1 2 3"), ("b", "1", 1, 3, "2 3"), (None, "1", 1, 9, None), ("a", "1", 7, 8, "1 2 3"), ("a", None, 2, 4, "")]
SECOND = [("a", "1", 9, 1, "2 3"), ("c", "1", 1, 2, "9 9 9 {4,5}"), (None, "1", 1, 0, "1 5 3"), ("c", "2", 1, 3, "1 2 3")]


def test_peers_keep_their_ids(spark, tmp_path):
    path = str(tmp_path / "peers")
    assert stores.read(spark, path, stores.PEERS).count() == 0
    got = {(r.collector, r.peer_ip): (r.peer_id, r.peer_asn) for r in stores.add_peers(batch(spark, FIRST), path, 0).collect()}
    assert got == {("b", "1"): (1, 1), ("a", None): (2, 2), ("a", "1"): (3, 1), (None, "1"): (4, 1)}
    for _ in range(2):  # repeated after a failure
        later = {(r.collector, r.peer_ip): (r.peer_id, r.peer_asn) for r in stores.add_peers(batch(spark, SECOND), path, 1).collect()}
        assert later == {**got, ("c", "1"): (5, 1), ("c", "2"): (6, 1)}
    assert stores.add_peers(batch(spark, FIRST), path, 2).count() == 6
    ids = stores.with_peers(batch(spark, [*FIRST, ("x", "x", 1, 1, None)]), stores.read(spark, path, stores.PEERS))
    assert sorted((r.collector or "", r.peer_ip or "", r.peer_id) for r in ids.where("peer_id is not null").collect()) == [("", "1", 4), ("a", "", 2), ("a", "1", 3), ("a", "1", 3), ("b", "1", 1)]
    assert ids.where("peer_id is null").count() == 1


def test_paths_keep_their_places(spark, tmp_path):
    path = str(tmp_path / "paths")
    rows = lambda found: {(r.core_text, r.stripped): (r.hash, r.idx) for r in found.collect()}
    first = rows(stores.add_paths(batch(spark, FIRST), path, 0))
    second = rows(stores.add_paths(batch(spark, SECOND), path, 1))
    assert {k: second[k] for k in first} == first and len(set(second.values())) == len(second) > len(first)
    assert rows(stores.add_paths(batch(spark, SECOND), path, 1)) == second
    together = intern.with_paths(batch(spark, FIRST + SECOND), stores.read(spark, path, stores.PATHS))
    assert together.where("path is not null and hash is null").count() == 0
    back = intern.rebuilt(together.select("hash", "idx", "peer_asn", "as_path"), stores.read(spark, path, stores.PATHS))
    assert all(r.as_path == r.text for r in back.select("as_path", aspath.path_text(F.col("path")).alias("text")).collect())


def test_places_within_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("g"), ((F.col("id") * 7919) % 5000).alias("o")).repartition(6)
    found = intern.rank_within(rows, ["g"], ["o"], "place").collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.g, r.o)):
        by.setdefault(r.g, []).append(r.place)
    assert all(p == list(range(len(p))) for p in by.values()) and len(found) == 5000


def test_a_stream_grows_the_stores(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, part in enumerate((FIRST, SECOND)):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("collector", "peer_ip", "peer_asn", "time_sec", "as_path"), r, strict=True))) for r in part))
        os.utime(folder / f"{k}.json", (1_600_000_000 + k, 1_600_000_000 + k))
    rows = spark.readStream.schema("collector string, peer_ip string, peer_asn bigint, time_sec bigint, as_path string").option("maxFilesPerTrigger", 1).json(str(folder))
    rows = rows.withColumn("time_usec", F.lit(0)).withColumn("path", aspath.parse_path(F.col("as_path")))
    peers, paths = str(tmp_path / "peers"), str(tmp_path / "paths")
    live.grow_stores(rows, peers, paths, str(tmp_path / "check")).awaitTermination(120)
    found = {(r.collector, r.peer_ip): (r.peer_id, r.batch) for r in stores.read(spark, peers, stores.PEERS).collect()}
    assert found == {("b", "1"): (1, 0), ("a", None): (2, 0), ("a", "1"): (3, 0), (None, "1"): (4, 0), ("c", "1"): (5, 1), ("c", "2"): (6, 1)}
    assert stores.read(spark, paths, stores.PATHS).count() == 6
