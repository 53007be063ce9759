"""Filters by sets of values that are tables: semi- and anti-joins, which Spark plans by size, with a bloom filter before large ones.

A list of a few values is a condition (`filters`); a list of many, or a table, meets the elems by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aspath


def _semi(elems: DataFrame, value, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    name = wanted.columns[0]
    known = wanted.select(F.col(name).cast("long").alias("_wanted")).where("_wanted is not null").distinct()
    return elems.withColumn("_value", value).join(known, F.col("_value") == F.col("_wanted"), how).drop("_value")


def keep_peers(elems: DataFrame, wanted: DataFrame) -> DataFrame:
    """Elems of the peers in the one column of `wanted`."""
    return _semi(elems, F.col("peer_asn"), wanted)


def drop_peers(elems: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Elems of all other peers, those without a number too."""
    return _semi(elems, F.col("peer_asn"), unwanted, "left_anti")


def keep_origins(elems: DataFrame, wanted: DataFrame) -> DataFrame:
    """Routes whose last hop is one plain number of `wanted`."""
    return _semi(elems.where("elem_type in ('R', 'A')"), aspath.origin_asn(F.col("path")), wanted)


def keep_communities(elems: DataFrame, wanted: DataFrame) -> DataFrame:
    """Routes with a community of `wanted` (asn, value), where a null is any.

    Lists repeat, so each distinct one is exploded and looked up once; elems then meet the lists that are taken.
    """
    routes = elems.where("elem_type in ('R', 'A')")
    each = routes.select("communities").where("size(communities) > 0").distinct().select("communities", F.explode("communities").alias("_c")).select("communities", "_c.asn", "_c.value")
    patterns = wanted.select(F.col("asn").cast("int").alias("asn"), F.col("value").cast("int").alias("value")).distinct()
    whole = each.join(patterns.where("asn is not null and value is not null"), ["asn", "value"], "left_semi")
    by_asn = each.join(patterns.where("asn is not null and value is null").select("asn"), "asn", "left_semi")
    by_value = each.join(patterns.where("asn is null and value is not null").select("value"), "value", "left_semi")
    anything = each.join(patterns.where("asn is null and value is null").select(F.lit(True).alias("_any")).limit(1), F.lit(True), "left_semi")
    taken = whole.select("communities").union(by_asn.select("communities")).union(by_value.select("communities")).union(anything.select("communities")).distinct()
    return routes.join(taken.withColumnRenamed("communities", "_taken"), F.col("communities") == F.col("_taken"), "left_semi")
