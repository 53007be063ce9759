"""The trie as an order: places, subtree ends and depths of prefixes, and walks that stop at the nearest entries.

Prefixes nest or are apart, so in the order of their networks, shorter ones first, the entries below one follow it without a gap.  A subtree is
then a range of places: counting or fetching what lies below costs no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ip
from .prefixes import ancestors, exact, key, lengths, min_covering
from .shared import checkpointed


def _unsigned(c: Column) -> Column:
    """Signed longs in the order of their bits."""
    return c.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def last_address(prefix: Column) -> tuple[Column, Column]:
    """(hi, lo) of the last address."""
    ones = F.lit(-1).cast("long")
    hi, lo = ip.mask(prefix["ver"], ones, ones, prefix["len"])
    low = F.when(prefix["ver"] == 4, F.bitwise_not(lo).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.bitwise_not(lo))
    return F.when(prefix["ver"] == 4, prefix["hi"]).otherwise(prefix["hi"].bitwiseOR(F.bitwise_not(hi))), prefix["lo"].bitwiseOR(low)


def places(table: DataFrame) -> DataFrame:
    """(prefix, place, until, depth) of the distinct prefixes: place from 0 in trie order within its version, the place after its last entry below, entries above.

    Each prefix opens at its first and closes at its last address.  The borders are range-partitioned in order; a border's running counts are those
    of its range plus the carries of the ranges before, so no task sorts all of them.
    """
    own = table.select("prefix").where("prefix is not null").distinct()
    p = F.col("prefix")
    hi, lo = last_address(p)
    opened = F.struct(_unsigned(p["hi"]).alias("hi"), _unsigned(p["lo"]).alias("lo"), F.lit(0).alias("closes"), p["len"].alias("rank"))
    closed = F.struct(_unsigned(hi).alias("hi"), _unsigned(lo).alias("lo"), F.lit(1).alias("closes"), (-p["len"]).alias("rank"))
    borders = own.select(p["ver"].alias("ver"), "prefix", F.explode(F.array(opened, closed)).alias("at"))
    order = ["ver", "at"]
    placed = checkpointed(borders.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    opens, step = F.when(F.col("at.closes") == 0, 1).otherwise(0), F.when(F.col("at.closes") == 0, 1).otherwise(-1)
    totals = placed.groupBy("ver", "_part").agg(F.sum(opens).alias("_o"), F.sum(step).alias("_d"))  # a row a version and range
    before = Window.partitionBy("ver").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select("ver", "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}c") for c in ("_o", "_d")])
    running = Window.partitionBy("_part", "ver").orderBy("at")
    counted = placed.withColumn("_o", F.sum(opens).over(running)).withColumn("_d", F.sum(step).over(running)).join(carries, ["ver", "_part"])
    counted = counted.select("prefix", "at.closes", (F.col("_o") + F.col("_oc")).alias("o"), (F.col("_d") + F.col("_dc")).alias("d"))
    first = F.col("closes") == 0
    return counted.groupBy("prefix").agg(F.max(F.when(first, F.col("o") - 1)).alias("place"), F.max(F.when(~first, F.col("o"))).alias("until"), F.max(F.when(first, F.col("d") - 1)).alias("depth"))


def walk_nearest(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """`by` columns, `prefix` and `relation` (exact, parent, child) of walks that end in each direction at the first entry: the nearest entry above, and the topmost ones below.

    An entry is topmost below a row exactly if the row is one of its ancestors no shorter than the entry's own nearest entry above, so entries are exploded between
    these two lengths only, and no pair is made that is not a result.
    """
    entry = table.select("prefix").where("prefix is not null").distinct()
    same = exact(rows, entry).select(*by, "prefix", F.lit("exact").alias("relation"))
    up = min_covering(rows, entry, by).select(*by, F.col("cover.prefix").alias("prefix"), F.lit("parent").alias("relation"))
    above = min_covering(entry, entry, ["prefix"]).select(key(F.col("prefix")).alias("_k"), F.col("cover.prefix.len").alias("_least"))
    known = entry.withColumn("_k", key(F.col("prefix"))).join(above, "_k", "left").select("prefix", F.coalesce("_least", F.lit(0)).alias("_least"))
    lists = ancestors(known, lengths(rows), strict=True).where(F.col("ancestor.len") >= F.col("_least")).select("prefix", key(F.col("ancestor")).alias("_k"))
    down = rows.select(*by, key(F.col("prefix")).alias("_k")).join(lists, "_k").select(*by, "prefix", F.lit("child").alias("relation"))
    return same.unionByName(up).unionByName(down)
