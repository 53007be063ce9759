"""Dump files to records and elems.

Files are read in bounded memory, large ones by several tasks (`files`); messages beyond the filters are counted, not kept.
Framing yields one row a message; the messages are then dealt out anew, so one large file is decoded by
many tasks.  The peer table of a dump is joined on (resource, index).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import aspath, community, ip, render
from ..operators import filters as flt
from ..operators.records import dump_position
from ..operators.shared import checkpointed
from ..types import ELEM, resource_id
from . import files, wire
from .files import MESSAGE


def frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """MESSAGE rows of whole plain files (resource_id, format, content)."""
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for rid, form, data in zip(batch["resource_id"], batch["format"], batch["content"], strict=True):
            for row in files.selected(iter(files.Messages(iter([(bytes(data), True)]), form)), 0):
                rows.append((rid, *row))
                if len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)


def _addressed(spark: SparkSession, resources: DataFrame) -> DataFrame:
    """`resources` with addresses that have no scheme put into the session's default store."""
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS") if hasattr(spark, "_jsc") else None
    if not default or default.startswith("file:"):
        return resources
    return resources.withColumn("url", F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.concat(F.lit(default.rstrip("/")), F.col("url"))))


def messages(resources: DataFrame, filters: flt.Filters | None = None, early_stop: bool = False, ranges: dict[str, int] | None = None) -> DataFrame:
    """The messages of the resources' files that can pass the record filters, and the first and last of each range without a body, with their resource's columns.

    `skipped` counts the messages that were left out before a row.  A missing file has none; one that can't be read has one of status S.
    """
    f = filters or flt.Filters()
    named = resources.withColumn("resource_id", resource_id())
    opened = _addressed(resources.sparkSession, named.select("resource_id", "format", "url"))
    found = files.read_messages(opened, f.begin, f.end, f.router, early_stop, ranges)
    return found.join(named.drop("attrs"), "resource_id")


def records(resources: DataFrame, filters: flt.Filters | None = None, early_stop: bool = False, check: bool = False, framed: DataFrame | None = None) -> DataFrame:
    """Records that pass the record filters, with status and dump position; an unreadable or empty source gives one record.

    With `early_stop` a dump, taken as sorted, ends at its first message beyond the interval, which gives one record of status O.
    With `check` messages are decoded on trial, and those that do not decode have status R.
    """
    f = filters or flt.Filters()
    chosen = resources.where(flt.all_of(flt.resource_conditions(f)))
    all_messages = (framed if framed is not None else messages(chosen, f, early_stop)).where(~((F.col("kind") == wire.TABLE_DUMP_V2) & (F.col("subtype") == wire.PEER_TABLE)))
    if early_stop and f.end is not None:  # a sorted dump ends at the first message beyond the interval
        beyond = all_messages.where(F.col("time_sec") > f.end).groupBy("resource_id").agg(F.min("seq").alias("_stop"))
        reached = all_messages.join(beyond, "resource_id", "left").where(F.col("_stop").isNull() | (F.col("seq") <= F.col("_stop")))
        all_messages = reached.withColumn("status", F.when(F.col("seq") == F.col("_stop"), "O").otherwise(F.col("status"))).drop("_stop")
    kept = flt.all_of(flt.record_conditions(f))
    marked = all_messages.withColumn("kept", F.coalesce(kept, F.lit(False)) | F.col("status").isin("S", "O"))
    rec_type = F.when(F.col("record_type") == "ribs", "R").otherwise("U")
    good = dump_position(marked, "resource_id", "seq", "kept").withColumn("rec_type", rec_type).withColumn("dump_time", F.coalesce("initial_time", F.lit(0)))
    columns = ["resource_id", "seq", "rec_type", "status", "time_sec", "time_usec", "project", "collector", "router", "router_ip", "dump_pos", "dump_time", "kind", "subtype", "body"]
    named = chosen.withColumn("resource_id", resource_id())
    totals = marked.groupBy("resource_id").agg(F.count_if("kept").alias("n_kept"))
    none = named.join(totals, "resource_id", "left").where(F.coalesce("n_kept", F.lit(0)) == 0)
    meta = none.select(
        "resource_id", F.lit(0).cast("long").alias("seq"), rec_type.alias("rec_type"), F.when(F.col("n_kept").isNull(), "E").otherwise("F").alias("status"), F.coalesce("initial_time", F.lit(0)).alias("time_sec"),
        F.lit(0).alias("time_usec"), "project", "collector", F.lit(None).cast("string").alias("router"), F.lit(None).cast("string").alias("router_ip"), F.lit("E").alias("dump_pos"),
        F.coalesce("initial_time", F.lit(0)).alias("dump_time"), F.lit(0).alias("kind"), F.lit(0).alias("subtype"), F.lit(None).cast("binary").alias("body"),
    )
    good = good.select(*columns)
    return (good.mapInPandas(_tried, good.schema) if check else good).unionByName(meta)


def _tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["status"] = ["R" if s == "V" and not _decodes(k, t, bytes(b)) else s for s, k, t, b in zip(batch["status"], batch["kind"], batch["subtype"], batch["body"], strict=True)]
        yield batch


def _decodes(kind: int, subtype: int, body: bytes) -> bool:
    try:
        wire.decode(kind, subtype, body)
    except wire.WireError:
        return False
    return True


NAMES = ["resource_id", "seq", "elem_idx", "elem_type", "orig_sec", "orig_usec", "peer_index", "peer_ip", "peer_asn", "prefix", "nexthop", "as_path", "as4_path", "communities", "origin", "med", "local_pref", "atomic", "agg_asn", "agg_ip", "old_state", "new_state"]


def _path(value) -> list[dict] | None:
    return None if value is None else [{"type": t, "asns": a} for t, a in value]


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for rid, seq, kind, subtype, body in zip(batch["resource_id"], batch["seq"], batch["kind"], batch["subtype"], batch["body"], strict=True):
            try:
                found = wire.decode(kind, subtype, bytes(body))
            except wire.WireError:
                found = [{"elem_type": "corrupt"}]
            for k, e in enumerate(found):
                communities = e.get("communities")
                e |= {"resource_id": rid, "seq": seq, "elem_idx": k, "as_path": _path(e.get("as_path")), "as4_path": _path(e.get("as4_path"))}
                e["communities"] = None if communities is None else [{"asn": a, "value": v} for a, v in communities]
                rows.append([e.get(n) for n in NAMES])
        frame = pd.DataFrame(rows, columns=NAMES, dtype=object)
        yield frame


def peers(framed: DataFrame) -> DataFrame:
    """(resource_id, peer_index, ip, asn) of the peer tables among messages; a table that can't be read gives none."""
    tables = framed.where((F.col("kind") == wire.TABLE_DUMP_V2) & (F.col("subtype") == wire.PEER_TABLE)).select("resource_id", "body")

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(rid, *row) for rid, body in zip(batch["resource_id"], batch["body"], strict=True) for row in _peer_rows(bytes(body))]
            yield pd.DataFrame(rows, columns=["resource_id", "peer_index", "ip", "asn"])

    return tables.mapInPandas(explode, "resource_id string, peer_index int, ip string, asn bigint")


def _peer_rows(body: bytes) -> list[tuple[int, str, int]]:
    try:
        return wire.peer_table(body)
    except (wire.WireError, IndexError, ValueError, OSError, struct.error):
        return []


def decode(found: DataFrame, partitions: int | None = None) -> DataFrame:
    """Raw elems of records; messages that do not decode have elem_type `corrupt`."""
    valid = found.where("status = 'V' and body is not null").select("resource_id", "seq", "kind", "subtype", "body")
    dealt = valid.repartition(partitions, "resource_id", "seq") if partitions else valid.repartition("resource_id", "seq")
    return dealt.mapInPandas(_decode, ELEM)


def elems(resources: DataFrame, filters: flt.Filters | None = None, counts: Counts | None = None) -> DataFrame:
    """Elems with the columns of their record that pass every filter.

    `prefix` is (ver, hi, lo, len); `path` has the segments, four-octet tail merged in; the text columns are as rendered.
    Routes whose peer index is in no table are left out.  `counts` counts what is read, left out and corrupt on the way.
    """
    f = filters or flt.Filters()
    chosen = resources.where(flt.all_of(flt.resource_conditions(f)))
    framed = checkpointed(_observed(messages(chosen, f), counts))  # what the record filters leave out is not written
    found = records(chosen, f, framed=framed).withColumn("_status", F.col("status"))
    raw = decode(found)
    if counts is not None:
        raw = checkpointed(raw.observe(counts.decoded, F.count_if(F.expr("elem_type <> 'corrupt'")).alias("n_elems"), F.count_if(F.expr("elem_type = 'corrupt'")).alias("n_corrupt")))
    raw = raw.where("elem_type <> 'corrupt'")
    index = peers(framed)
    joined = raw.join(index, ["resource_id", "peer_index"], "left").where("peer_index is null or ip is not null")
    joined = joined.withColumn("peer_ip", F.coalesce("peer_ip", "ip")).withColumn("peer_asn", F.coalesce("peer_asn", "asn")).drop("ip", "asn")
    whole = joined.join(found.drop("kind", "subtype", "body", "_status"), ["resource_id", "seq"])
    return flt.apply(dress(whole), f)


def counters(framed: DataFrame) -> DataFrame:
    """(resource_id, n_read, n_skipped, n_unsupported, n_broken) of messages: those read, of them left out by the filters, of kinds without elems, and whether the source broke off."""
    return framed.groupBy("resource_id").agg(
        (F.count_if(F.expr("status <> 'S'")) + F.sum("skipped")).alias("n_read"), (F.count_if(F.expr("body is null and status <> 'S'")) + F.sum("skipped")).alias("n_skipped"),
        F.count_if(F.expr("status = 'U' and body is not null")).alias("n_unsupported"), F.count_if(F.expr("status = 'S'")).alias("n_broken"),
    )


class Counts:
    """Counts of a run, taken by the jobs that do the work: give it to `elems`, and ask when these are done."""

    def __init__(self) -> None:
        self.framed, self.decoded = Observation(), Observation()

    def get(self) -> dict[str, int]:
        """n_read, n_skipped, n_unsupported and n_broken of messages, n_elems and n_corrupt of what they decode to."""
        return {k: v or 0 for o in (self.framed, self.decoded) for k, v in o.get.items()}


def _observed(framed: DataFrame, counts: Counts | None) -> DataFrame:
    if counts is None:
        return framed
    left_out = F.sum(F.col("skipped") + F.when(F.col("body").isNull() & (F.col("status") != "S"), 1).otherwise(0))
    read = F.sum(F.col("skipped") + F.when(F.col("status") != "S", 1).otherwise(0))
    return framed.observe(counts.framed, read.alias("n_read"), left_out.alias("n_skipped"), F.count_if(F.expr("status = 'U' and body is not null")).alias("n_unsupported"), F.count_if(F.expr("status = 'S'")).alias("n_broken"))


def dress(raw: DataFrame) -> DataFrame:
    """Merged paths, parsed prefixes and the rendered text columns."""
    path = aspath.merge_as4(F.col("as_path"), F.col("as4_path"))
    rows = raw.withColumn("path", path).withColumn("prefix_text", F.col("prefix")).withColumn("prefix", ip.parse_prefix(F.col("prefix")))
    rows = rows.withColumn("as_path_text", aspath.path_text(F.col("path"))).withColumn("as_path", F.col("as_path_text")).drop("as4_path")
    return rows.withColumn("origin_text", render.origin_text(F.col("path"))).withColumn("communities_text", community.communities_text(F.col("communities")))
