"""Value tables for addresses, prefixes, paths, communities and times."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from routeloom.functions import aspath, community, ip, times


def test_addresses_and_prefixes(spark):
    random.seed(4)
    texts = ["192.0.43.8", "::", "::1", "2001:500:88:beef::", "::ffff:1.2.3.4", "256.0.0.1", "1:2", "1::2::3", "x", None]
    texts += [str(ipaddress.IPv6Address(random.getrandbits(128))) for _ in range(20)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ip.address_text(ip.parse_address(F.col("t"))).alias("a")).collect()
    bad = {"256.0.0.1", "1:2", "1::2::3", "x", None}
    assert all(r.a == (None if r.t in bad else r.t) for r in rows)
    cases = {"130.217.250.7/16": "130.217.0.0/16", "2001:500:88:beef::1/48": "2001:500:88::/48", "1.2.3.4/33": None, "10.0.0.0/0": "0.0.0.0/0", "::1/129": None, "1.2.3.4": None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", ip.prefix_text(ip.parse_prefix(F.col("t"))).alias("p")).collect()
    assert {r.t: r.p for r in rows} == cases


def test_masks_of_every_length(spark):
    top = spark.range(129).select("id", ip.address_text(ip.mask_address(ip.parse_address(F.lit("ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff")), F.col("id"))).alias("a")).collect()
    for r in top:
        assert r.a == str(ipaddress.ip_network(f"ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/{r.id}", strict=False).network_address)


def test_path_text_and_parts(spark):
    text = "11 12 13 14 {21,22,23} (31 32 33 34) [41,42,43] <991 992>"
    row = spark.range(1).select(aspath.parse_path(F.lit(text)).alias("p")).select(aspath.path_text(F.col("p")).alias("t"), aspath.path_length(F.col("p")).alias("n"), aspath.origin_asn(F.col("p")).alias("o")).first()
    assert (row.t, row.n, row.o) == (text, 8, None)


@pytest.mark.parametrize(
    ("path", "as4", "merged"),
    [("1 2 23456", "70000", "1 2 70000"), ("1 23456", "5 6 70000", "1 23456"), ("1 {2,3} 23456 4", "70000 4", "1 {2,3} 70000 4"), ("7 8", None, "7 8"), (None, "9", "9")],
)
def test_four_octet_merge(spark, path, as4, merged):
    column = lambda t: aspath.parse_path(F.lit(t).cast("string"))
    assert spark.range(1).select(aspath.path_text(aspath.merge_as4(column(path), column(as4))).alias("m")).first().m == merged


def test_path_patterns(spark):
    assert aspath.translate_pattern("!_1_") == (True, "(^|$|[ {},_])1(^|$|[ {},_])")
    assert aspath.translate_pattern(r"_(1)_\1")[1].endswith("\\2")
    with pytest.raises(aspath.PathPatternError):
        aspath.translate_pattern("_" * 30)
    assert [r.x for r in spark.createDataFrame([("1 22 3",), ("122",), ("22",)], "t string").select(aspath.matches(F.col("t"), "_22_").alias("x")).collect()] == [True, False, True]


def test_communities_and_times(spark):
    row = spark.range(1).select(community.parse_communities(F.lit("1:2 3:4 1:2")).alias("c"))
    seen = row.select(community.communities_text(F.col("c")).alias("t"), *[community.match(F.col("c"), p).alias(p) for p in ("1:*", "*:4", "9:*", "*:*")]).first()
    assert tuple(seen) == ("1:2 3:4 1:2", True, True, False, True)
    with pytest.raises(ValueError):
        community.parse_pattern("70000:1")
    assert times.parse_interval("2015-04-01 00:10,1427847000") == (1427847000, 1427847000)
    assert times.recent_interval("2 h", 10_000) == (2800, None)
    with pytest.raises(ValueError):
        times.parse_interval("20,10")
