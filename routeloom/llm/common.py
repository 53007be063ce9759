"""Reading tables and keeping intermediate results in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), a fresh local one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], weight: str, share: int = 1000) -> DataFrame:
    """Inner join of `rows` with `side`, which has one row for each of its keys and in `weight` how many of `rows` have that key.

    Keys of more than a `share`-th of these rows, of which there can be no more than `share`, are broadcast, so no task
    gathers one of them; all others meet by a shuffle.  `side` is read three times and its rows are to be small.
    """
    least = (side.agg(F.sum(weight)).first()[0] or 0) / share
    hot = F.broadcast(side.where(F.col(weight) > least))
    rest = rows.join(hot.select(*keys), list(keys), "left_anti").join(side.where(F.col(weight) <= least), list(keys))
    return rows.join(hot, list(keys)).unionByName(rest)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def span_labels(spans: Column, kinds: Sequence[str]) -> Column:
    """Array of (start, kind, end), kind an index into `kinds`, as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_counts(spans: Column, kinds: Sequence[str]) -> list[Column]:
    """n_<kind> for each of `kinds`."""
    own = F.transform(spans, lambda s: s["kind"])
    return [F.aggregate(own, F.lit(0).cast("long"), _count(k)).alias(f"n_{kind}") for k, kind in enumerate(kinds)]


def _count(k: int):
    return lambda acc, x: acc + F.when(x == k, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
