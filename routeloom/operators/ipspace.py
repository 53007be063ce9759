"""Counting address space: unions of intervals, unique addresses, overlaps.

A union of intervals is gaps and islands over the sorted starts.  So that no task sorts them all, intervals are
first cut at the borders of blocks, islands are found within a block, and islands that touch across a border are counted
apart, as the sum is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ip

BLOCK_BITS = 20


def cut_v4(intervals: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(lo, hi) cut at multiples of 2**bits, with `block` and whether the interval goes on in the next one."""
    first, last = F.shiftright("lo", bits), F.shiftright("hi", bits)
    rows = intervals.select(*intervals.columns, F.explode(F.sequence(first, last)).alias("block"))
    start = F.shiftleft(F.col("block"), bits)
    top = start + (1 << bits) - 1
    return rows.withColumn("lo", F.greatest("lo", start)).withColumn("goes_on", F.col("hi") > top).withColumn("hi", F.least("hi", top))


def union_v4(intervals: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(block, lo, hi, goes_on): the union of (lo, hi), both inclusive, in disjoint pieces within blocks; intervals that only touch stay apart."""
    rows = cut_v4(intervals.select("lo", "hi").distinct(), bits)
    order = Window.partitionBy("block").orderBy("lo", F.col("hi").desc())
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("_new", F.when(before >= F.col("lo"), 0).otherwise(1))
    numbered = flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy("block", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("goes_on").alias("goes_on"))
    return pieces.drop("_island")


def rejoin(pieces: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Pieces that were cut at a border put together again.  Only pieces that reach a border are ordered in one window; they
    are at most two a block, 2**(32 - bits) blocks."""
    low, high = F.shiftleft(F.col("block"), bits), F.shiftleft(F.col("block"), bits) + (1 << bits) - 1
    inner = pieces.where((F.col("lo") > low) & (F.col("hi") < high)).select("lo", "hi")
    edge = pieces.where((F.col("lo") == low) | (F.col("hi") == high))
    order = Window.partitionBy(F.lit(0)).orderBy("lo")
    joined = edge.withColumn("_new", F.when(F.lag("goes_on").over(order) & (F.col("lo") == low), 0).otherwise(1))
    joined = joined.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return inner.union(joined.groupBy("_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island"))


def unique_v4(intervals: DataFrame) -> DataFrame:
    """(n_addresses): addresses in the union."""
    return union_v4(intervals).agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0)).cast("long").alias("n_addresses"))


def prefix_intervals(prefixes: DataFrame, column: str = "prefix") -> DataFrame:
    lo, hi = ip.v4_range(F.col(column))
    return prefixes.where(F.col(column)["ver"] == 4).select(lo.alias("lo"), hi.alias("hi"))


def overlap(rows: DataFrame, counted: DataFrame, by: list[str], bits: int = BLOCK_BITS) -> DataFrame:
    """Addresses of each row's (lo, hi) that `counted` has, and whether the row lies wholly in them: `by`, n_overlap, covered.

    Both sides are cut into blocks.  In a block the pieces of the union and the borders of the rows are laid on one line; what the
    union has up to a border is a running sum, so a busy block costs a sort, not every pair.
    """
    left = cut_v4(rows.select(*by, "lo", "hi", (F.col("hi") - F.col("lo") + 1).alias("_size")), bits)
    borders = left.select(*by, "_size", "block", F.explode(F.array(F.struct(F.col("hi").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("lo") - 1).alias("at"), F.lit(-1).alias("sign")))).alias("b"))
    borders = borders.select(*by, "_size", "block", "b.at", "b.sign")
    earlier = Window.partitionBy("block").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1).over(earlier), F.lit(0))
    pieces = union_v4(counted, bits).select("block", F.col("lo").alias("at"), F.lit(0).alias("kind"), F.struct(before.alias("before"), "lo", "hi").alias("piece"))
    points = borders.select("block", "at").distinct().select("block", "at", F.lit(1).alias("kind"), F.lit(None).cast(pieces.schema["piece"].dataType).alias("piece"))
    last = F.last("piece", ignorenulls=True).over(Window.partitionBy("block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    line = pieces.union(points).withColumn("last", last).where("kind = 1")
    upto = F.coalesce(F.col("last.before") + F.least("at", "last.hi") - F.col("last.lo") + 1, F.lit(0))
    met = borders.join(line.select("block", "at", upto.alias("upto")), ["block", "at"])
    part: Column = F.col("sign") * F.col("upto")
    total = met.groupBy(*by, "_size").agg(F.sum(part).cast("long").alias("n_overlap"))
    return total.select(*by, "n_overlap", (F.col("n_overlap") == F.col("_size")).alias("covered"))
