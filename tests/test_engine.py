"""Filters, joins, dumps, feeds and catalogs on small inputs."""

import gzip
import ipaddress
import json
import os
import random
import socket
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from routeloom.functions import ip
from routeloom.operators import filters as flt
from routeloom.operators import prefixes, records
from routeloom.plans import queries as engine
from routeloom.sources import catalog, dumps, rislive, wire

SMALL = "/root/testdata/sf0.001"


def test_grammar():
    f = flt.parse('project ris and prefix more 10.0.0.0/8 exact 1.2.3.0/24 and path "_1_" and path "!_2_" and peer 1 2')
    assert f.project == ("ris",) and f.prefix == (("more", "10.0.0.0/8"), ("exact", "1.2.3.0/24")) and f.aspath == ("_1_", "!_2_") and f.peer == (1, 2)
    for bad in ("", "project", "project ris and", "nope 1", "project a and project b", "peer 1 or peer 2", "extcommunity 1:2", 'path "a', "ipversion 5", "prefix more", "type x"):
        with pytest.raises(flt.FilterError):
            flt.parse(bad)


def test_trie_against_brute_force(spark):
    random.seed(9)
    nets = [ipaddress.ip_network((random.getrandbits(8) << 24 | random.getrandbits(3) << 21, n), strict=False) for n in (random.randint(0, 32) for _ in range(60))]
    nets += [ipaddress.ip_network((0x2001 << 112 | random.getrandbits(4) << 60, n), strict=False) for n in (random.randint(0, 128) for _ in range(40))]
    nets = sorted(set(nets), key=str)
    table = spark.createDataFrame([(str(n),) for n in nets], "t string").select("t", ip.parse_prefix(F.col("t")).alias("prefix"))
    above = {(n, m) for n in nets for m in nets if n.version == m.version and n != m and n.subnet_of(m)}
    got = {(ipaddress.ip_network(r.t), ipaddress.ip_network(r.c)) for r in prefixes.less_specifics(table, table).select("t", F.col("cover.t").alias("c")).collect()}
    assert got == above
    top = {ipaddress.ip_network(r.p) for r in prefixes.minimum_coverage(table).select(ip.prefix_text(F.col("prefix")).alias("p")).collect()}
    assert top == {n for n in nets if not any(a == n for a, _ in above)}
    below = {(ipaddress.ip_network(r.t), ipaddress.ip_network(r.i)) for r in prefixes.more_specifics(table, table).select("t", F.col("inner.t").alias("i")).collect()}
    assert below == {(m, n) for n, m in above}


def test_networks_touched(spark):
    rows = spark.createDataFrame([(t,) for t in ("192.0.43.0/24", "130.217.0.0/16", "130.217.250.0/24", "2001:500:88::/48", "2001:500:88:beef::/64", "2001:48d0:101:501::/64", "2001:48d0:101:501:beef::/96")], "t string")
    table = rows.select(ip.parse_prefix(F.col("t")).alias("prefix"))
    assert prefixes.count_24(table).first().n_24 == 257
    assert int(prefixes.count_64(table).first().n_64) == 65537


def attribute(kind, body, flags=0x40):
    return bytes([flags, kind, len(body)]) + body


def nlri(text):
    net = ipaddress.ip_network(text)
    return bytes([net.prefixlen]) + net.network_address.packed[: (net.prefixlen + 7) // 8]


def update(gone=b"", attrs=b"", new=b""):
    body = struct.pack(">H", len(gone)) + gone + struct.pack(">H", len(attrs)) + attrs + new
    return b"\xff" * 16 + struct.pack(">HB", 19 + len(body), 2) + body


def mrt(sec, kind, subtype, body):
    return struct.pack(">IHHI", sec, kind, subtype, len(body)) + body


ATTRS = attribute(1, b"\0") + attribute(2, bytes([2, 2]) + struct.pack(">II", 65001, 70000)) + attribute(3, bytes([1, 2, 3, 4])) + attribute(8, struct.pack(">HH", 1, 2))


def dump_bytes():
    six = attribute(14, struct.pack(">HBB", 2, 1, 16) + socket.inet_pton(socket.AF_INET6, "fe80::1") + b"\0" + nlri("2001:db8::/32"), 0x80)
    head = struct.pack(">IIHH", 65001, 65002, 0, 1) + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    out = mrt(100, 16, 4, head + update(nlri("10.1.0.0/16"), ATTRS + six, nlri("10.2.0.0/16") + nlri("10.3.0.0/24")))
    out += mrt(101, 16, 5, head + struct.pack(">HH", 6, 1))
    return out + mrt(500, 16, 4, head + update(nlri("10.9.0.0/16")))


def resource(spark, path, kind="updates", form="mrt"):
    return spark.createDataFrame([("file", form, path, 100, 300, "ris", "rrc0", kind, {})], catalog.RESOURCE)


def test_update_dump(spark, tmp_path):
    path = str(tmp_path / "u.gz")
    with gzip.open(path, "wb") as f:
        f.write(dump_bytes())
    rows = dumps.elems(resource(spark, path), flt.Filters().between(100, 200)).orderBy("seq", "elem_idx").collect()
    assert [(r.elem_type, r.prefix_text, r.nexthop, r.as_path_text, r.communities_text) for r in rows] == [
        ("W", "10.1.0.0/16", None, None, None),
        ("A", "10.2.0.0/16", "1.2.3.4", "65001 70000", "1:2"),
        ("A", "10.3.0.0/24", "1.2.3.4", "65001 70000", "1:2"),
        ("A", "2001:db8::/32", "fe80::1", "65001 70000", "1:2"),
        ("S", None, None, None, None),
    ]
    found = {r.seq: r.dump_pos for r in dumps.records(resource(spark, path), flt.Filters().between(100, 200)).collect()}
    assert found == {0: "B", 1: "M"}


def test_rib_dump_and_statuses(spark, tmp_path):
    peers = struct.pack(">IHH", 1, 0, 1) + bytes([2]) + struct.pack(">I", 9) + bytes([10, 0, 0, 1]) + struct.pack(">I", 65001)
    entry = struct.pack(">I", 0) + nlri("10.0.0.0/8") + struct.pack(">H", 2) + b"".join(struct.pack(">HIH", k, 50, len(ATTRS)) + ATTRS for k in (0, 7))
    (tmp_path / "rib").write_bytes(mrt(100, 13, 1, peers) + mrt(100, 13, 2, entry))
    rows = dumps.elems(resource(spark, str(tmp_path / "rib"), "ribs")).collect()
    assert [(r.elem_type, r.peer_ip, r.peer_asn, r.prefix_text) for r in rows] == [("R", "10.0.0.1", 65001, "10.0.0.0/8")]
    (tmp_path / "empty").write_bytes(b"")
    assert [r.status for r in dumps.records(resource(spark, str(tmp_path / "empty"))).collect()] == ["E"]
    assert [r.status for r in dumps.records(resource(spark, str(tmp_path / "rib"), "ribs"), flt.Filters().between(900, None)).collect()] == ["F"]
    (tmp_path / "cut").write_bytes(dump_bytes()[:-3])
    assert [r.status for r in dumps.records(resource(spark, str(tmp_path / "cut"))).orderBy("seq").collect()] == ["V", "V", "S"]


def test_bmp_frames():
    peer = bytes([0, 0]) + b"\0" * 8 + b"\0" * 12 + bytes([10, 0, 0, 1]) + struct.pack(">I", 65001) + b"\0" * 4 + struct.pack(">II", 7, 8)
    message = lambda kind, body: bytes([3]) + struct.pack(">I", 6 + len(body)) + bytes([kind]) + body
    data = message(0, peer + update(attrs=ATTRS, new=nlri("10.2.0.0/16"))) + message(2, peer) + message(3, peer)
    found = [e for f in wire.frame_bmp(data) for e in wire.decode(f.kind, f.subtype, f.body)]
    assert [(e["elem_type"], e.get("prefix"), e.get("new_state"), e["orig_sec"]) for e in found] == [("A", "10.2.0.0/16", None, 7), ("S", None, 1, 7), ("S", None, 3, 7)]


def test_live_lines(spark):
    raw = update(attrs=ATTRS, new=nlri("45.161.192.0/23")).hex()
    base = {"timestamp": 1553627987.89, "peer": "72.22.223.9", "peer_asn": "11708", "host": "rrc00"}
    lines = [{"type": "ris_message", "data": {**base, "type": "UPDATE", "raw": raw}}, {"type": "ris_message", "data": {**base, "type": "RIS_PEER_STATE", "state": "down"}}, {"type": "ris_error", "data": {}}]
    lines += [{"type": "ris_message", "data": {**base, "type": k}} for k in ("OPEN", "NOTIFICATION", "KEEPALIVE")]
    frame = spark.createDataFrame([(json.dumps(x),) for x in lines] + [('{"type":"ris_message","data":{',)], "value string")
    found = rislive.lines_to_records(frame, "singlefile")
    assert sorted(r.status for r in found.collect()) == sorted("VVVUUUR")
    from routeloom.functions import render

    got = dumps.dress(rislive.records_to_elems(found)).select(render.elem_line().alias("x")).collect()
    assert {r.x for r in got} == {
        "U|A|1553627987.890000|singlefile|rrc00|||11708|72.22.223.9|45.161.192.0/23|1.2.3.4|65001 70000|70000|1:2||",
        "U|S|1553627987.890000|singlefile|rrc00|||11708|72.22.223.9|||||||IDLE",
    }


def test_catalogs(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("a,ris,ribs,rrc0,1000,120,50\nb,ris,updates,rrc0,2000,300,50\nc,other,updates,x,2000,300,50\n")
    found = catalog.load(spark, "csvfile", flt.parse("project ris").between(1500, 3000), csv_file=str(path))
    assert sorted(r.url for r in found.collect()) == ["a", "b"]
    rows = spark.createDataFrame([("ris", "rrc0", "updates", 2000, "b", 300, 50), ("ris", "rrc0", "ribs", 1000, "a", 120, 50)], "project string, collector string, record_type string, initial_time bigint, url string, duration bigint, added bigint")
    catalog.write_database(rows, str(tmp_path / "db"))
    assert [r.url for r in catalog.load(spark, "sqlite", flt.parse("type updates"), db_file=str(tmp_path / "db")).collect()] == ["b"]
    body = {"version": 2, "time": 1, "error": None, "data": {"resources": [{"url": "u", "project": "ris", "collector": "rrc0", "type": "updates", "initialTime": 5, "duration": 0, "transport": "kafka", "format": "bmp", "attr": {}}]}}
    (tmp_path / "r.json").write_text(json.dumps(body) + "\n")
    row = catalog.load(spark, "broker", responses=str(tmp_path / "r.json")).first()
    assert (row.url, row.duration, row.transport) == ("u", None, "kafka")
    assert "types[]=ribs" in catalog.broker_url("http://x", flt.parse("type ribs").between(1, 2))
    with pytest.raises(ValueError):
        catalog.load(spark, "nope")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the tables")
@pytest.mark.parametrize("name", ["prefix_set_semijoin", "lpm", "overlap_mask", "ip_space_union", "rpki_validate", "render_elem", "peer_ids", "rib_period", "session_by_peer", "catalog_upsert", "less_specifics", "min_cover", "ip_overlap", "record_merge_order", "path_intern", "path_rebuild", "ip6_unique_count", "ip6_overlap", "walk_up_down", "dump_decode"])
def test_queries_agree_with_sql(spark, name):
    db = duckdb.connect()
    for table in ("events", "supplier", "customer", "orders", "nation", "region"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    found = engine.QUERIES[name](spark, SMALL)
    result = db.execute(engine.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in found.collect()))) == sorted(map(str, result.fetchall()))


def test_broken_sources(spark, tmp_path):
    """What can't be read gives a record, not an end of the job."""
    whole = gzip.compress(dump_bytes())
    (tmp_path / "cut.gz").write_bytes(whole[:-20])
    found = dumps.records(resource(spark, str(tmp_path / "cut.gz"))).orderBy("seq").collect()
    assert found[-1].status == "S" and all(r.status == "V" for r in found[:-1])
    assert [r.status for r in dumps.records(resource(spark, str(tmp_path / "missing"))).collect()] == ["E"]
    bad = mrt(100, 13, 1, b"\0\0") + mrt(100, 16, 4, b"\0\1\2") + dump_bytes()
    (tmp_path / "bad").write_bytes(bad)
    assert [r.status for r in dumps.records(resource(spark, str(tmp_path / "bad")), check=True).orderBy("seq").collect()] == ["R", "V", "V", "V"]
    assert dumps.elems(resource(spark, str(tmp_path / "bad"))).count() == 6
    (tmp_path / "bmp").write_bytes(b"OBMP" + bytes([1, 7, 0, 20, 0, 0, 0, 9, 0x80, 12]) + b"\0\0\0")
    assert [r.status for r in dumps.records(resource(spark, str(tmp_path / "bmp")).withColumn("format", F.lit("bmp"))).collect()] == ["S"]


def test_end_of_interval(spark, tmp_path):
    (tmp_path / "u").write_bytes(dump_bytes() + mrt(150, 16, 5, b""))
    f = flt.Filters().between(100, 200)
    stopped = dumps.records(resource(spark, str(tmp_path / "u")), f, early_stop=True).orderBy("seq").collect()
    assert [(r.seq, r.status) for r in stopped] == [(0, "V"), (1, "V"), (2, "O")]
    assert [r.seq for r in dumps.records(resource(spark, str(tmp_path / "u")), f).orderBy("seq").collect()] == [0, 1, 3]


def test_v6_space(spark):
    texts = ["2001:db8::/32", "2001:db8:1::/48", "2001:db9::/64", "2001:db9::8000/120", "2001:dba::/120", "2001:dba::/127", "10.0.0.0/8"]
    table = spark.createDataFrame([(t,) for t in texts], "t string").select(ip.parse_prefix(F.col("t")).alias("prefix"))
    assert tuple(map(int, prefixes.unique_v6(table).first())) == (2**32 + 1, 256)
    rows = spark.createDataFrame([(1, "2001:db8:2::/48"), (2, "2001:db8::/28"), (3, "2001:dba::/64"), (4, "3000::/4"), (5, "::/0"), (6, None)], "i long, t string").select("i", ip.parse_prefix(F.col("t")).alias("prefix"))
    found = {r.i: (int(r.n_64), int(r.n_rest), r.covered) for r in prefixes.overlap_v6(rows, table, ["i"]).collect()}
    assert found == {1: (2**16, 0, True), 2: (2**32 + 1, 256, False), 3: (0, 256, False), 4: (0, 0, False), 5: (2**32 + 1, 256, False)}


def test_ranks_across_ranges(spark):
    rows = [(g, t, "R" if t % 3 else "U", "r", k) for k, (g, t) in enumerate([("a", t // 3) for t in range(300)] + [(None, 5), (None, 4), ("b", 1)])]
    frame = spark.createDataFrame(rows, "collector string, time_sec long, rec_type string, resource_id string, seq long").repartition(5)
    found = {r.seq: r.place for r in records.rank_in_order(frame, ["collector"]).collect()}
    for group in ("a", None, "b"):
        own = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2] != "R", r[3], r[4]))
        assert [found[r[4]] for r in own] == list(range(1, len(own) + 1))
