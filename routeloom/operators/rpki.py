"""Route origin validation as a containment as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefixes import covering


def snapshots_for(times: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(t, snapshot) for each distinct `t`: the latest snapshot time at or before it.

    Both sides are laid on one line and the last snapshot is carried forward within days; days without an own
    snapshot at their start take the latest of the days before, found on the table of days.
    """
    day = 86400
    points = snapshots.select(F.col("snapshot").alias("t"), F.col("snapshot").alias("s")).distinct()
    by_day = points.groupBy(F.floor(F.col("t") / day).alias("d")).agg(F.sort_array(F.collect_set("s")).alias("own"))
    span = times.select(F.floor(F.col("t") / day).alias("d")).distinct()
    line = by_day.select("d", F.array_max("own").alias("latest")).unionByName(span.select("d", F.lit(None).cast("long").alias("latest"))).groupBy("d").agg(F.max("latest").alias("latest"))
    carried = line.withColumn("before", F.max("latest").over(Window.partitionBy(F.lit(0)).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)))
    rows = times.select("t").distinct().withColumn("d", F.floor(F.col("t") / day)).join(carried.select("d", "before"), "d").join(by_day, "d", "left")
    latest = F.coalesce(F.array_max(F.filter(F.coalesce("own", F.array().cast("array<bigint>")), lambda s: s <= F.col("t"))), F.col("before"))
    return rows.select("t", latest.cast("long").alias("snapshot"))


def validate(routes: DataFrame, roas: DataFrame, by: list[str]) -> DataFrame:
    """`by` columns, `status` and `roas` (asn,prefix-length-max; ordered).

    `routes` has prefix, origin_asn and t; `roas` has snapshot, asn, prefix, max_length.  valid: a covering entry has the
    origin and allows the length; invalid: only other covering entries; notfound: none; null without a plain origin.
    """
    asof = snapshots_for(routes.select("t"), roas.select("snapshot"))
    timed = routes.join(asof, "t")
    met = covering(timed.where(F.col("origin_asn").isNotNull()), roas, on=("snapshot",))
    valid = (F.col("cover.asn") == F.col("origin_asn")) & (F.col("prefix.len") <= F.col("cover.max_length"))
    found = met.groupBy(*by).agg(F.bool_or(valid).alias("_valid"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(",", F.col("cover.asn").cast("string"), F.concat_ws("-", F.col("cover.prefix.len").cast("string"), F.col("cover.max_length").cast("string"))))), ";").alias("roas"))
    status = F.when(F.col("origin_asn").isNull(), F.lit(None)).when(F.col("_valid"), "valid").when(F.col("_valid").isNotNull(), "invalid").otherwise("notfound")
    return routes.select(*by, "origin_asn").join(found, by, "left").select(*by, status.alias("status"), F.coalesce("roas", F.lit("")).alias("roas"))
