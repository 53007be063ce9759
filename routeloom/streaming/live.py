"""Live mode: catalogs that grow, endless feeds, windows with late data, and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import filters as flt
from ..operators import stores
from ..sources import catalog, datasource, dumps, rislive

LATE = "120 seconds"


def follow_lines(spark: SparkSession, path: str) -> DataFrame:
    """A growing file of JSON lines as a stream."""
    spark.dataSource.register(datasource.Routes)
    return spark.readStream.format("routes").option("format", "lines").option("path", path).load()


def follow_kafka(spark: SparkSession, resource) -> DataFrame:
    """A message topic as a stream of `value`; needs the connector on the class path."""
    attrs = resource["attrs"]
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", resource["url"]).option("subscribe", attrs["topic"]).option("startingOffsets", attrs["offset"])
    return (reader.option("kafka.group.id", attrs["group"]) if attrs.get("group") else reader).load()


def follow_catalog(spark: SparkSession, folder: str, f: flt.Filters) -> DataFrame:
    """CSV catalogs dropped into a folder as a stream of resources."""
    rows = spark.readStream.schema(catalog.CSV).csv(folder)
    conditions = flt.resource_conditions(f)
    if f.begin is not None:
        conditions.append(F.col("initial_time") >= f.begin - catalog.CSV_SLACK)
    if f.end is not None:
        conditions.append(F.col("initial_time") <= f.end)
    return rows.where(flt.all_of(conditions))


def live_elems(lines: DataFrame, f: flt.Filters | None = None, project: str = "ris-live") -> DataFrame:
    """Elems of a stream of JSON lines."""
    return flt.apply(dumps.dress(rislive.records_to_elems(rislive.lines_to_records(lines, project))), f or flt.Filters())


def with_time(elems: DataFrame, late: str = LATE) -> DataFrame:
    """`ts` with a watermark of the slack that catalogs allow late files."""
    return elems.withColumn("ts", F.timestamp_micros(F.col("time_sec") * 1_000_000 + F.col("time_usec"))).withWatermark("ts", late)


def window_counts(elems: DataFrame, width: str = "5 minutes", slide: str | None = None, by: tuple[str, ...] = ("elem_type",)) -> DataFrame:
    """Elems by window and `by`; works alike on a table and, with `with_time`, on a stream."""
    window = F.window("ts", width, slide or width)
    return elems.groupBy(window, *by).count().select(F.col("window.start").alias("start"), *by, F.col("count").alias("n"))


def sessions(elems: DataFrame, gap: str = "10 minutes", by: tuple[str, ...] = ("peer_ip",)) -> DataFrame:
    return elems.groupBy(F.session_window("ts", gap).alias("s"), *by).count().select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *by, F.col("count").alias("n"))


def merged(records: DataFrame, width: str = "60 seconds", by: tuple[str, ...] = ("collector",)) -> DataFrame:
    """Records of live feeds in the merged order: `slice` and, from 1, the `place` in it, beside their columns.

    Rows wait in the state of their slice of time until the watermark (`with_time`) has passed it, so feeds that run ahead wait for those behind, and each
    slice comes out once, in order.  A slice of a group of `by` is sorted at once; that bounds the state by rate and width.  Works alike on a table.
    """
    row = F.struct("time_sec", F.when(F.col("rec_type") == "R", 0).otherwise(1).alias("_kind"), "resource_id", "seq", F.struct(*records.columns).alias("_row"))
    slices = records.groupBy(F.window("ts", width).alias("_w"), *by).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    placed = slices.select(F.col("_w.start").alias("slice"), F.posexplode("_rows").alias("_at", "_r"))
    return placed.select("slice", (F.col("_at") + 1).alias("place"), "_r._row.*")


#: What makes a record of one feed the record of another.
SAME = ("collector", "peer_ip", "time_sec", "time_usec", "digest")


def hand_over(backlog: DataFrame, feed: DataFrame, folder: str, overlap: int = 900) -> DataFrame:
    """The rows of a live feed that the backlog does not hold: no gap and no repeat where both overlap, nor where the feed repeats itself.

    Both have the columns `SAME`, the feed also `ts` with a watermark.  The backlog is taken to be whole up to `overlap` seconds before a collector's last row.
    The keys of that tail are written to `folder` once, so a restarted query sees the same tail; the state holds keys within the watermark only.
    """
    spark = feed.sparkSession
    last = backlog.groupBy(F.col("collector").alias("_collector")).agg((F.max("time_sec") - overlap).alias("_from"))
    tail = backlog.join(last, F.col("collector").eqNullSafe(F.col("_collector"))).where("time_sec >= _from").select(*SAME, "_from").distinct()
    tail.write.mode("ignore").parquet(folder)
    tail = spark.read.schema(tail.schema).parquet(folder)
    begins = F.broadcast(tail.select(F.col("collector").alias("_collector"), "_from").distinct())  # a row a collector
    late = feed.join(begins, F.col("collector").eqNullSafe(F.col("_collector")), "left").where("_from is null or time_sec >= _from").drop("_from", "_collector")
    old = tail.select(*[F.col(c).alias(f"_{c}") for c in SAME])
    met = flt.all_of([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SAME])
    new = late.join(old, met, "left_anti")
    return new.dropDuplicatesWithinWatermark(list(SAME)) if new.isStreaming else new.dropDuplicates(list(SAME))


def follow_file(spark: SparkSession, path: str, form: str = "mrt") -> DataFrame:
    """Messages of files (comma-separated) that are written anew from time to time: a file is read again when its first 1,024 bytes change."""
    spark.dataSource.register(datasource.Routes)
    return spark.readStream.format("routes").option("format", form).option("path", path).load()


PEER_STATE = "collector string, peer_ip string, state int, changes bigint, since bigint"


def _track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, changes, since = state.get if state.exists else (0, 0, 0)
    for batch in batches:
        for sec, new in sorted(zip(batch["time_sec"], batch["new_state"], strict=True)):
            if new != now:
                now, changes, since = int(new), changes + 1, int(sec)
    state.update((now, changes, since))
    yield pd.DataFrame([(*key, now, changes, since)], columns=["collector", "peer_ip", "state", "changes", "since"])


def peer_states(elems: DataFrame) -> DataFrame:
    """The session state of each peer as its state elems come in."""
    rows = elems.where("elem_type = 'S'").select("collector", "peer_ip", "time_sec", "new_state")
    return rows.groupBy("collector", "peer_ip").applyInPandasWithState(_track, PEER_STATE, "state int, changes bigint, since bigint", "update", GroupStateTimeout.NoTimeout)


def _keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, period: int) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    for batch in batches:
        kept = []
        for t in sorted(batch["initial_time"]):
            if last is None or t >= last + period:
                last = int(t)
                kept.append((*key, last))
        yield pd.DataFrame(kept, columns=["project", "collector", "initial_time"])
    if last is not None:
        state.update((last,))


def live_rib_period(resources: DataFrame, period: int) -> DataFrame:
    """Dumps of a catalog stream that the period filter keeps."""
    keep = lambda key, batches, state: _keep(key, batches, state, period)
    return resources.where("record_type = 'ribs'").groupBy("project", "collector").applyInPandasWithState(keep, "project string, collector string, initial_time bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def grow_stores(elems: DataFrame, peers: str, paths: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Adds the peers and paths of a stream of elems to stores; a batch that is repeated after a failure gives the same ids."""

    def add(rows: DataFrame, batch: int) -> None:
        rows = rows.withColumn("seen", F.struct("time_sec", "time_usec")).persist()
        stores.add_peers(rows, peers, batch)
        stores.add_paths(rows.where("path is not null"), paths, batch)
        rows.unpersist()

    writer = elems.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start(elems: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write a stream to Parquet: by `every`, or all that is there and stop."""
    writer = elems.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
