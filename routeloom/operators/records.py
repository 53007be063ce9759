"""Record-level operators: dump positions, source statuses, time order, explosion into elems."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed


def dump_position(messages: DataFrame, source: str = "resource_id", seq: str = "seq", kept: str = "kept") -> DataFrame:
    """Kept messages with `dump_pos`: E for the last kept one if nothing was filtered after it, B for the first one read if kept, else M.

    The three borders of a source are aggregates, so a long source costs no sort and no single task.
    """
    ends = messages.groupBy(source).agg(F.min(seq).alias("_first"), F.max(seq).alias("_last"))
    at = F.when(F.col(seq) == F.col("_last"), "E").when(F.col(seq) == F.col("_first"), "B").otherwise("M")
    return messages.where(F.col(kept)).join(ends, source).withColumn("dump_pos", at).drop("_first", "_last")


def source_status(resources: DataFrame, messages: DataFrame) -> DataFrame:
    """(resource_id, n_read, n_valid, status) of every resource: E nothing read, F nothing kept, else V."""
    read = messages.groupBy("resource_id").agg(F.count("*").alias("n_read"), F.count_if("kept").alias("n_valid"))
    n = lambda c: F.coalesce(c, F.lit(0))
    status = F.when(n("n_read") == 0, "E").when(n("n_valid") == 0, "F").otherwise("V")
    return resources.select("resource_id").join(read, "resource_id", "left").select("resource_id", n("n_read").alias("n_read"), n("n_valid").alias("n_valid"), status.alias("status"))


def merge_order(by_micros: bool = False) -> list[Column]:
    """Sort keys of the merged stream: second, ribs before updates, resource, place in the resource.  Only sinks need the order."""
    micros = [F.col("time_usec")] if by_micros else []
    return [F.col("time_sec"), *micros, F.when(F.col("rec_type") == "R", 0).otherwise(1), F.col("resource_id"), F.col("seq")]


def in_order(records: DataFrame, by_micros: bool = False) -> DataFrame:
    return records.orderBy(*merge_order(by_micros))


def rank_in_order(records: DataFrame, by: list[str]) -> DataFrame:
    """Place in the merged stream within each group of `by`, from 1.

    Rows are range-partitioned by group and order, so a large group is sorted by many tasks; a row's place is the number of
    its group's rows in earlier ranges plus its place in its own.
    """
    order = merge_order()
    placed = checkpointed(records.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    named = counts.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], F.col("_part").alias("_range"), "_before")
    same = F.col("_part") == F.col("_range")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{k}"))
    place = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    return placed.withColumn("_place", place).join(named, same).withColumn("place", F.col("_place") + F.col("_before")).select(*records.columns, "place")


def explode_elems(records: DataFrame, withdrawn4: str, withdrawn6: str, announced4: str, announced6: str) -> DataFrame:
    """One row a route in the fixed order of an update, with `elem_idx`, `elem_type` and `route`."""
    tagged = [F.transform(c, _tag("W")) for c in (withdrawn4, withdrawn6)] + [F.transform(c, _tag("A")) for c in (announced4, announced6)]
    rows = records.select("*", F.posexplode(F.concat(*tagged)).alias("elem_idx", "_e"))
    return rows.select(*records.columns, "elem_idx", F.col("_e.elem_type").alias("elem_type"), F.col("_e.route").alias("route"))


def _tag(kind: str):
    return lambda r: F.struct(F.lit(kind).alias("elem_type"), r.alias("route"))


def kept_ribs(resources: DataFrame, period: int, time: str = "initial_time", by: tuple[str, ...] = ("project", "collector")) -> DataFrame:
    """(by, time) of the dumps that the period filter keeps: the first, then each at least `period` after the last kept.

    The choice depends on the choice before, so a collector's distinct times, eight bytes each, are walked in one task: from a kept time the search goes
    straight to the first one late enough, so the steps are those that are kept.
    """
    times = resources.where(F.col(time).isNotNull()).select(*by, F.col(time).cast("long").alias(time)).distinct()
    kinds = dict(times.dtypes)

    def walk(group: pa.Table) -> pa.Table:
        found = np.sort(group[time].to_numpy())
        at, kept = 0, []
        while at < len(found):
            kept.append(at)
            at = max(at + 1, int(np.searchsorted(found, found[at] + period)))
        keys = [pa.repeat(group[c][0], len(kept)) for c in by]
        return pa.table([*keys, pa.array(found[kept])], names=[*by, time])

    return times.groupBy(*by).applyInArrow(walk, ", ".join(f"`{c}` {kinds[c]}" for c in [*by, time]))


def limit(records: DataFrame, n: int) -> DataFrame:
    """The first n records of the merged stream."""
    return in_order(records).limit(n)
