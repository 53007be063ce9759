"""Dimension tables with dense ids: peers and AS paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aspath
from .shared import checkpointed


def dense_ids(keys: DataFrame, order: list[str], name: str, start: int = 1, spread: int | None = None) -> DataFrame:
    """`keys` with ids from `start` in the order of `order`, without one task for all rows.

    Rows are range-partitioned by the order; a row's id is the number of rows in earlier ranges plus its place in its own.
    """
    placed = checkpointed(keys.repartitionByRange(*([spread] if spread else []), *order).withColumn("_part", F.spark_partition_id()))
    offset, pairs = start, []
    for part, n in sorted(placed.groupBy("_part").count().collect()):
        pairs += [F.lit(part), F.lit(offset)]
        offset += n
    before = F.create_map(*pairs)[F.col("_part")] if pairs else F.lit(start)
    return placed.withColumn(name, (before + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).cast("long")).drop("_part")


def rank_within(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Places from 0 within each group, ranges of rows at a time: a group that holds a third of all rows is sorted by many tasks."""
    placed = checkpointed(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"))  # a row a group and range
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)).cast("long") - 1
    return placed.withColumn("_own", own).join(offsets, [*group, "_part"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")


def peer_ids(elems: DataFrame, collector: str = "collector", peer: str = "peer_ip", asn: str = "peer_asn", seen: str = "seen") -> DataFrame:
    """(collector, peer, asn, peer_id): ids from 1 in the order in which peers are first seen; the AS number is the first one."""
    first = elems.groupBy(collector, peer).agg(F.min(seen).alias("_seen"), F.min_by(asn, seen).alias(asn))
    return dense_ids(first, ["_seen", collector, peer], "peer_id").drop("_seen")


def path_ids(elems: DataFrame, path: str = "path", peer_asn: str = "peer_asn") -> DataFrame:
    """(hash, idx, core, stripped): distinct core paths, numbered from 0 within their hash in the order of their text."""
    core, stripped = aspath.core_path(F.col(path), F.col(peer_asn))
    rows = elems.where(F.col(path).isNotNull()).select(core.alias("core"), stripped.alias("stripped")).distinct()
    rows = rows.withColumn("hash", aspath.path_hash(F.col("core"))).withColumn("core_text", aspath.path_text(F.col("core")))
    return rank_within(rows, ["hash"], ["core_text", "stripped"], "idx")


def with_paths(elems: DataFrame, store: DataFrame, path: str = "path", peer_asn: str = "peer_asn") -> DataFrame:
    """`elems` with the id of its path (`hash`, `idx`) in a table of `path_ids`; null for a null path or one that is not there."""
    core, stripped = aspath.core_path(F.col(path), F.col(peer_asn))
    own = elems.withColumn("_core", aspath.path_text(core)).withColumn("_stripped", stripped)
    known = store.select(F.col("core_text").alias("_core"), F.col("stripped").alias("_stripped"), "hash", "idx")
    return own.join(known, ["_core", "_stripped"], "left").drop("_core", "_stripped")


def rebuilt(ids: DataFrame, store: DataFrame, peer_asn: str = "peer_asn") -> DataFrame:
    """`ids` (hash, idx, peer_asn, ...) with `path`, the interned path with its first hop put back where it was stripped; null for a null id."""
    known = store.select("hash", "idx", "core", "stripped")
    return ids.join(known, ["hash", "idx"], "left").withColumn("path", F.when(F.col("core").isNotNull(), aspath.full_path(F.col("core"), F.col("stripped"), F.col(peer_asn)))).drop("core", "stripped")
