"""The decode cache, counters and SQL decoders, and the queries over whole dump files."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from routeloom.functions import ip
from routeloom.operators import filters as flt
from routeloom.plans import dumpset
from routeloom.sources import cache, catalog, decoders, dumps
from tests.test_engine import ATTRS, attribute, dump_bytes, mrt, nlri, update
from tests.test_files import resources

SMALL = "/root/testdata/sf0.001"
NAMES = ["dump_files_elems", "dump_files_filtered", "dump_files_records", "dump_files_counters", "decode_in_sql"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the tables")
@pytest.mark.parametrize("name", NAMES)
def test_whole_dump_files_agree_with_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    found, result = dumpset.QUERIES[name](spark, SMALL), db.execute(dumpset.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in found.collect()))) == sorted(map(str, result.fetchall()))


def test_what_is_cached_is_not_opened_again(spark, tmp_path):
    paths = [str(tmp_path / f"d{k}") for k in range(3)]
    for p in paths[:2]:
        with open(p, "wb") as f:
            f.write(dump_bytes())
    open(paths[2], "wb").close()
    table, folder = resources(spark, *paths), str(tmp_path / "cache")
    shown = lambda frame: sorted((r.resource_id, r.seq, r.elem_idx, r.elem_type, r.prefix_text, r.as_path_text) for r in frame.collect())
    first, plain = shown(cache.cached_elems(table.where("initial_time = 100"), folder)), shown(dumps.elems(table))
    assert first == [r for r in plain if ".100." in r[0]] and len(first) == 6
    assert shown(cache.cached_elems(table, folder)) == plain and cache.fill(table, folder) == 0
    for p in paths:
        os.remove(p)
    assert shown(cache.cached_elems(table, folder)) == plain
    f = flt.parse("elemtype announcements and prefix more 10.2.0.0/16").between(100, 200)
    assert [(r[3], r[4]) for r in shown(cache.cached_elems(table, folder, f))] == [("A", "10.2.0.0/16")] * 2
    os.makedirs(tmp_path / "cache" / "elems" / "batch=torn" / "day=1970-01-01")  # a run that failed before it listed its part
    torn = spark.read.parquet(f"{folder}/elems").drop("batch", "day")
    torn.write.mode("overwrite").parquet(f"{folder}/elems/batch=torn/day=1970-01-01")
    assert shown(cache.cached_elems(table, folder)) == plain
    assert cache.cached_elems(resources(spark, paths[2]).withColumn("initial_time", F.lit(7).cast("long")), str(tmp_path / "other")).count() == 0


def test_counters_of_a_run(spark, tmp_path):
    data = dump_bytes() + mrt(150, 16, 4, b"\0\1") + mrt(160, 99, 0, b"") + mrt(170, 16, 5, b"")[:-2]
    (tmp_path / "a").write_bytes(data)
    (tmp_path / "b").write_bytes(dump_bytes())
    table, counts = resources(spark, str(tmp_path / "a"), str(tmp_path / "b")), dumps.Counts()
    assert dumps.elems(table, flt.Filters().between(100, 200), counts).count() == 10
    assert counts.get() == {"n_read": 8, "n_skipped": 2, "n_unsupported": 1, "n_broken": 1, "n_elems": 10, "n_corrupt": 1}
    by = {r.resource_id.split(".")[3]: tuple(r)[1:] for r in dumps.counters(dumps.messages(table, flt.Filters().between(100, 200))).collect()}
    assert by == {"100": (5, 1, 1, 1), "101": (3, 1, 0, 0)}


def test_decoders_in_sql(spark):
    six = attribute(14, b"\0\2\1\x10" + bytes(15) + b"\1" + b"\0" + nlri("2001:db8::/32") + nlri("2001:db9::/48"), 0x80)
    gone = attribute(15, b"\0\2\1" + nlri("2001:dba::/32"), 0x80)
    extra = attribute(4, (77).to_bytes(4, "big"), 0x80) + attribute(7, (65010).to_bytes(4, "big") + bytes([9, 9, 9, 9]), 0xC0)
    head = (65001).to_bytes(4, "big") + (65002).to_bytes(4, "big") + b"\0\0\0\1" + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    body = head + update(nlri("10.1.0.0/16"), ATTRS + six + gone + extra, nlri("10.2.0.0/16"))
    rows = spark.createDataFrame([("r", 1, 16, 4, body), ("r", 2, 16, 4, b"\1"), ("r", 3, 16, 4, None)], "resource_id string, seq bigint, kind int, subtype int, body binary")
    decoders.register(spark)
    got = spark.sql("SELECT * FROM decode_messages(TABLE(SELECT * FROM {m}))", m=rows).orderBy("seq", "elem_idx").collect()
    assert [(r.seq, r.elem_idx, r.elem_type, r.prefix) for r in got] == [(1, 0, "W", "10.1.0.0/16"), (1, 1, "W", "2001:dba::/32"), (1, 2, "A", "10.2.0.0/16"), (1, 3, "A", "2001:db8::/32"), (1, 4, "A", "2001:db9::/48"), (2, 0, "corrupt", None)]
    assert (got[2].med, got[2].agg_asn, got[2].agg_ip, got[3].nexthop) == (77, 65010, "9.9.9.9", "::1")
    beside = spark.sql("SELECT m.seq, d.* FROM {m} m, LATERAL decode_message(m.kind, m.subtype, m.body) d", m=rows).orderBy("seq", "elem_idx").collect()
    names = [n for n in decoders.SCHEMA.names if n != "resource_id"]
    assert [tuple(r[n] for n in names) for r in beside] == [tuple(r[n] for n in names) for r in got]
    assert dumps.dress(spark.sql("SELECT * FROM decode_messages(TABLE(SELECT * FROM {m}))", m=rows)).where("elem_type = 'A'").select(ip.prefix_text(F.col("prefix")).alias("p")).count() == 3


def test_catalog_selects_before_files_are_opened(spark, tmp_path):
    (tmp_path / "d").write_bytes(dump_bytes())
    table = resources(spark, str(tmp_path / "d"), "nope://never/opened")
    chosen = catalog.select(table, flt.Filters().between(100, 200)).where("url not like 'nope%'")
    assert dumps.records(chosen).count() == 3
