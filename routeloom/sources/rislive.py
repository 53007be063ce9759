"""Live JSON lines: an envelope with a raw message in hex.

The envelope is read with from_json in permissive mode; only the raw message goes through the decoder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..types import ELEM
from . import wire
from .dumps import NAMES, _path

ENVELOPE = "type string, data struct<timestamp:string,peer:string,peer_asn:string,id:string,raw:string,host:string,type:string,state:string>, _bad string"
#: Session states by their names on the feed.
STATES = {"down": 1, "connected": 2, "up": 6}


def lines_to_records(lines: DataFrame, project: str = "ris-live", line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of text lines (batch or stream): V, U for kinds without routes, R for lines that are no message.  dump_pos is always B."""
    parsed = F.from_json(F.col(line), ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("_m", parsed).withColumn("_d", F.col("_m.data"))
    sec, usec = times.seconds_and_micros(F.col("_d.timestamp"))
    broken = F.col("_m._bad").isNotNull() | F.col("_m.type").isNull() | ~F.col("_m.type").isin("ris_message", "ris_error")
    routed = F.col("_d.type").isin("UPDATE", "RIS_PEER_STATE")
    status = F.when(broken, "R").when(F.col("_m.type") == "ris_error", "V").when(routed, "V").otherwise("U")
    message = F.col("_m.type") == "ris_message"
    return rows.select(
        *keep, F.lit("U").alias("rec_type"), status.alias("status"), sec.alias("time_sec"), usec.alias("time_usec"), F.lit(project).alias("project"), F.col("_d.host").alias("collector"),
        F.lit(None).cast("string").alias("router"), F.lit(None).cast("string").alias("router_ip"), F.lit("B").alias("dump_pos"), F.lit(0).cast("long").alias("dump_time"),
        F.when(message, F.col("_d.type")).alias("message_type"), F.col("_d.peer").alias("peer_ip"), F.col("_d.peer_asn").cast("long").alias("peer_asn"),
        F.when(message & (F.col("_d.type") == "UPDATE"), F.unhex("_d.raw")).alias("body"), F.col("_d.state").alias("state"),
    )


RECORD_COLUMNS = ("rec_type", "status", "time_sec", "time_usec", "project", "collector", "router", "router_ip", "dump_pos", "dump_time")


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keep = list(RECORD_COLUMNS)
    for batch in batches:
        rows = []
        for row in batch.to_dict("records"):
            base = {"orig_sec": row["time_sec"], "orig_usec": row["time_usec"], "peer_ip": row["peer_ip"], "peer_asn": row["peer_asn"]}
            if row["message_type"] == "RIS_PEER_STATE":
                found = [{**base, "elem_type": "S", "old_state": 0, "new_state": STATES.get(row["state"], 0)}]
            else:
                try:
                    found = wire.update(bytes(row["body"]), 4, base)
                except (wire.WireError, ValueError):
                    found = []
            for k, e in enumerate(found):
                communities = e.get("communities")
                e |= {"elem_idx": k, "as_path": _path(e.get("as_path")), "as4_path": _path(e.get("as4_path"))}
                e["communities"] = None if communities is None else [{"asn": a, "value": v} for a, v in communities]
                rows.append([row[c] for c in keep] + [e.get(n) for n in NAMES[2:]])
        yield pd.DataFrame(rows, columns=keep + NAMES[2:], dtype=object)


def records_to_elems(records: DataFrame) -> DataFrame:
    """Raw elems with the record's columns; give them to `dumps.dress`."""
    routed = records.where("status = 'V' and message_type is not null and (message_type = 'RIS_PEER_STATE' or body is not null)")
    head = "rec_type string, status string, time_sec bigint, time_usec int, project string, collector string, router string, router_ip string, dump_pos string, dump_time bigint, "
    return routed.mapInPandas(_decode, head + ELEM.split("seq bigint, ")[1])
