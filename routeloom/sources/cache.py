"""A cache of decoded elems by resource: what was decoded once is read as Parquet, and its dump file is not opened again.

Elems of the missing resources are written, unfiltered, to a folder of their own, by day of the resource; only then is a row for each of these resources added to the
list of what is there.  A run that fails before that leaves a folder that no one reads; resources that two runs decode at the same time count
once, by the first folder name.  A resource without elems is listed too.  Times, prefixes and peers of a filter reach the Parquet scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import filters as flt
from ..types import resource_id
from . import dumps

LISTED = "resource_id string, batch string"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(resource_id, batch) of the resources that are there."""
    try:
        rows = spark.read.schema(LISTED).parquet(f"{folder}/listed")
    except AnalysisException:
        rows = spark.createDataFrame([], LISTED)
    return rows.groupBy("resource_id").agg(F.min("batch").alias("batch"))


def fill(resources: DataFrame, folder: str) -> int:
    """Decodes the resources that the cache lacks; how many these were."""
    spark = resources.sparkSession
    missing = resources.withColumn("resource_id", resource_id()).join(listed(spark, folder), "resource_id", "left_anti")
    n = missing.count()
    if n:
        batch = uuid.uuid4().hex
        elems = dumps.elems(missing.drop("resource_id"))
        day = F.date_format(F.timestamp_seconds("dump_time"), "yyyy-MM-dd")
        elems.withColumn("batch", F.lit(batch)).withColumn("day", day).write.mode("append").partitionBy("batch", "day").parquet(f"{folder}/elems")
        missing.select("resource_id", F.lit(batch).alias("batch")).distinct().coalesce(1).write.mode("append").parquet(f"{folder}/listed")
    return n


def cached_elems(resources: DataFrame, folder: str, filters: flt.Filters | None = None) -> DataFrame:
    """`dumps.elems` of the resources through the cache at `folder`."""
    f = filters or flt.Filters()
    spark = resources.sparkSession
    chosen = resources.where(flt.all_of(flt.resource_conditions(f)))
    fill(chosen, folder)
    wanted = listed(spark, folder).join(chosen.select(resource_id().alias("resource_id")).distinct(), "resource_id")
    try:
        rows = spark.read.parquet(f"{folder}/elems")
    except AnalysisException:  # no resource had any
        return dumps.elems(chosen.limit(0), f)
    return flt.apply(rows.join(wanted, ["resource_id", "batch"], "left_semi").drop("batch", "day"), f)
