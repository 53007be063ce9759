"""Stores of peers and AS paths that grow by batches and keep every id they have given.

A store is a folder of Parquet parts, one a batch (`batch=<k>`).  A batch adds only keys that no earlier one has: an anti-join with the parts
before it, ids going on where they stopped.  Writing a batch again replaces its part with equal rows, so a stream may
call with its batch number and repeat after a failure; readers of `upto` never see a part that is being written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import aspath
from ..types import AS_PATH
from .intern import dense_ids, rank_within

PEERS = "collector string, peer_ip string, peer_asn bigint, peer_id bigint"
PATHS = f"hash bigint, idx bigint, core {AS_PATH}, core_text string, stripped boolean"


def read(spark: SparkSession, path: str, schema: str, upto: int | None = None) -> DataFrame:
    """The rows of all batches, or of those before `upto`; a store that is not there yet is empty."""
    try:
        rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", path).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], f"{schema}, batch bigint")
    return rows if upto is None else rows.where(F.col("batch") < upto)


def _append(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _same(keys: list[str]) -> Column:
    found = F.lit(True)
    for k in keys:
        found = found & F.col(f"_new.{k}").eqNullSafe(F.col(f"_old.{k}"))
    return found


def add_peers(elems: DataFrame, path: str, batch: int, seen: str = "seen") -> DataFrame:
    """Gives the peers (collector, peer_ip) of `elems` that the store lacks the next ids, in the order in which they are first seen, and returns the store up to this batch."""
    spark = elems.sparkSession
    known = read(spark, path, PEERS, batch)
    keys = ["collector", "peer_ip"]
    first = elems.groupBy(*keys).agg(F.min(seen).alias("_seen"), F.min_by("peer_asn", seen).alias("peer_asn"))
    new = first.alias("_new").join(known.select(*keys).alias("_old"), _same(keys), "left_anti")
    last = known.agg(F.max("peer_id")).first()[0] or 0
    _append(dense_ids(new, ["_seen", *keys], "peer_id", start=last + 1).select("collector", "peer_ip", "peer_asn", "peer_id"), path, batch)
    return read(spark, path, PEERS, batch + 1)


def add_paths(elems: DataFrame, path: str, batch: int, column: str = "path", peer_asn: str = "peer_asn") -> DataFrame:
    """Gives the core paths of `elems` that the store lacks the next places within their hash, and returns the store up to this batch."""
    spark = elems.sparkSession
    known = read(spark, path, PATHS, batch)
    core, stripped = aspath.core_path(F.col(column), F.col(peer_asn))
    rows = elems.where(F.col(column).isNotNull()).select(core.alias("core"), stripped.alias("stripped")).distinct()
    rows = rows.withColumn("hash", aspath.path_hash(F.col("core"))).withColumn("core_text", aspath.path_text(F.col("core")))
    new = rows.join(known.select("hash", "core_text", "stripped"), ["hash", "core_text", "stripped"], "left_anti")
    start = known.groupBy("hash").agg((F.max("idx") + 1).alias("_start"))
    placed = rank_within(new, ["hash"], ["core_text", "stripped"], "_place").join(start, "hash", "left")
    _append(placed.withColumn("idx", F.coalesce("_start", F.lit(0)) + F.col("_place")).select("hash", "idx", "core", "core_text", "stripped"), path, batch)
    return read(spark, path, PATHS, batch + 1)


def with_peers(elems: DataFrame, store: DataFrame) -> DataFrame:
    """`elems` with `peer_id`; null for a peer that is not in the store."""
    old = store.select(F.col("collector").alias("_collector"), F.col("peer_ip").alias("_peer_ip"), "peer_id")
    met = F.col("collector").eqNullSafe(F.col("_collector")) & F.col("peer_ip").eqNullSafe(F.col("_peer_ip"))
    return elems.join(old, met, "left").drop("_collector", "_peer_ip")
