"""Trie order, nearest walks and value sets against brute force."""

import ipaddress
import random

from pyspark.sql import functions as F

from routeloom.functions import aspath, community, ip
from routeloom.operators import filters as flt
from routeloom.operators import trie, valuesets


def nets(rng, n):
    four = [ipaddress.ip_network((rng.getrandbits(4) << 28 | rng.getrandbits(4) << 20, rng.randint(0, 32)), strict=False) for _ in range(n)]
    six = [ipaddress.ip_network((rng.choice((0x2001, 0xFFFF, 0)) << 112 | rng.getrandbits(3) << 62 | rng.getrandbits(2), rng.randint(0, 128)), strict=False) for _ in range(n)]
    edge = [ipaddress.ip_network(x) for x in ("0.0.0.0/0", "255.255.255.255/32", "::/0", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/128", "8000::/1", "::/128")]
    return sorted(set(four + six + edge), key=str)


def table(spark, found, name="prefix"):
    return spark.createDataFrame([(str(n),) for n in found], "t string").select("t", ip.parse_prefix(F.col("t")).alias(name))


def above(a, b):
    return a.version == b.version and a != b and b.subnet_of(a)


def test_places_are_a_walk(spark):
    found = nets(random.Random(1), 80)
    rows = table(spark, [*found, found[0]]).repartition(5)
    got = {ipaddress.ip_network(r.p): (r.place, r.until, r.depth) for r in trie.places(rows).select(ip.prefix_text(F.col("prefix")).alias("p"), "place", "until", "depth").collect()}
    assert len(got) == len(found)
    for version in (4, 6):
        own = sorted((n for n in found if n.version == version), key=lambda n: (int(n.network_address), n.prefixlen))
        assert [got[n][0] for n in own] == list(range(len(own)))
        for n in own:
            place, until, depth = got[n]
            assert {m for m in own if place < got[m][0] < until} == {m for m in own if above(n, m)} and depth == sum(above(m, n) for m in own)


def test_walks_stop_at_the_nearest(spark):
    rng = random.Random(3)
    found, probes = nets(rng, 60), nets(rng, 40)
    rows = table(spark, [*probes, *found[:10]]).withColumnRenamed("t", "probe")
    got = {(r.probe, r.p, r.relation) for r in trie.walk_nearest(rows, table(spark, found), ["probe"]).select("probe", ip.prefix_text(F.col("prefix")).alias("p"), "relation").collect()}
    expected = set()
    for q in {*probes, *found[:10]}:
        expected |= {(str(q), str(q), "exact")} if q in found else set()
        up = [m for m in found if above(m, q)]
        expected |= {(str(q), str(max(up, key=lambda m: m.prefixlen)), "parent")} if up else set()
        down = [m for m in found if above(q, m)]
        expected |= {(str(q), str(m), "child") for m in down if not any(above(x, m) for x in down)}
    text = {str(ipaddress.ip_network(a)) + str(ipaddress.ip_network(b)) + c for a, b, c in got}
    assert text == {a + b + c for a, b, c in expected} and len(got) == len(expected)


def test_long_lists_are_joined_as_short_ones_are_compared(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        path = rng.choice([None, "", "1 2", f"1 {rng.randrange(9)}", "1 {2,3}", f"4 5 {rng.randrange(9)}"])
        listed = rng.choice([None, "", f"{rng.randrange(4)}:{rng.randrange(4)}", f"{rng.randrange(4)}:1 7:{rng.randrange(4)} 7:7"])
        rows.append((k, rng.choice("RAWS"), rng.choice([None, *range(9)]), path, listed, 5, "p", "c", "r"))
    frame = spark.createDataFrame(rows, "k int, elem_type string, peer_asn long, as_path string, communities_text string, time_sec long, project string, collector string, router string")
    frame = frame.withColumn("path", aspath.parse_path(F.col("as_path"))).withColumn("communities", community.parse_communities(F.col("communities_text"))).withColumn("prefix", ip.parse_prefix(F.lit("10.0.0.0/8")))
    for f in (flt.Filters(peer=(1, 2, 3)), flt.Filters(not_peer=(1, 2)), flt.Filters(origin=(2, 3, 4)), flt.Filters(community=("1:1", "2:*")), flt.Filters(community=("*:2", "7:7")), flt.Filters(community=("*:*", "1:1")), flt.Filters(peer=(1, 2, 5), origin=(1, 2), community=("7:*", "0:0"))):
        some, many = ({r.k for r in flt.apply(frame, f, few_values=n).collect()} for n in (100, 1))
        assert some == many and some and len(some) < 400


def test_sets_of_tables(spark):
    frame = spark.createDataFrame([(1, "A", 5), (2, "A", None), (3, "S", 6)], "k int, elem_type string, peer_asn long")
    wanted = spark.createDataFrame([(5,), (5,), (None,)], "asn int")
    assert [r.k for r in valuesets.keep_peers(frame, wanted).collect()] == [1]
    assert sorted(r.k for r in valuesets.drop_peers(frame, wanted).collect()) == [2, 3]
    assert valuesets.keep_peers(frame, wanted.limit(0)).count() == 0 and valuesets.drop_peers(frame, wanted.limit(0)).count() == 3


def test_kept_dumps_of_a_period(spark):
    from routeloom.operators import records

    rng = random.Random(8)
    rows = [(rng.choice(["p", None]), rng.choice("ab"), rng.choice([None, *range(0, 5000, 7)])) for _ in range(800)]
    frame = spark.createDataFrame(rows, "project string, collector string, initial_time long").repartition(3)
    for period in (0, 1, 50, 10_000):
        expected = set()
        for key in {r[:2] for r in rows}:
            last = None
            for t in sorted({r[2] for r in rows if r[:2] == key and r[2] is not None}):
                if last is None or t >= last + period:
                    last = t
                    expected.add((*key, t))
        assert {tuple(r) for r in records.kept_ribs(frame, period).collect()} == expected
