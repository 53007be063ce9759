"""Schemas of resources, records and elems, and the codes of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS = "struct<ver:int,hi:bigint,lo:bigint>"
PREFIX = "struct<ver:int,hi:bigint,lo:bigint,len:int>"
AS_PATH = "array<struct<type:int,asns:array<bigint>>>"
COMMUNITIES = "array<struct<asn:int,value:int>>"

RESOURCE = "transport string, format string, url string, initial_time bigint, duration bigint, project string, collector string, record_type string, attrs map<string,string>"
RECORD = (
    "resource_id string, seq bigint, rec_type string, status string, time_sec bigint, time_usec int, project string, collector string, "
    "router string, router_ip string, dump_pos string, dump_time bigint, kind int, subtype int, body binary"
)
ELEM = (
    f"resource_id string, seq bigint, elem_idx int, elem_type string, orig_sec bigint, orig_usec int, peer_index int, peer_ip string, peer_asn bigint, prefix string, nexthop string, "
    f"as_path {AS_PATH}, as4_path {AS_PATH}, communities {COMMUNITIES}, origin int, med bigint, local_pref bigint, atomic boolean, agg_asn bigint, agg_ip string, old_state int, new_state int"
)

#: Fixed values of the data model.
SEGMENT = {"asn": 1, "set": 2, "confed_seq": 3, "confed_set": 4}
PEER_STATES = ["", "IDLE", "CONNECT", "ACTIVE", "OPENSENT", "OPENCONFIRM", "ESTABLISHED", "CLEARING", "DELETED"]
ORIGINS = ["IGP", "EGP", "INCOMPLETE"]
ELEM_TYPES = {"ribs": "R", "announcements": "A", "withdrawals": "W", "peerstates": "S"}
RECORD_TYPES = {"ribs": "R", "updates": "U"}
STATUSES = {"valid": "V", "filtered": "F", "empty": "E", "outside": "O", "corrupted_source": "S", "corrupted_record": "R", "unsupported": "U"}
WELL_KNOWN_COMMUNITIES = {0xFFFFFF01: "NO_EXPORT", 0xFFFFFF02: "NO_ADVERTISE", 0xFFFFFF03: "NO_EXPORT_SUBCONFED"}


def named(codes: list[str], column: Column) -> Column:
    """The name of a code that counts from 0; empty where it has none."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, codes)), column.cast("int") + 1), F.lit(""))


def resource_id(project: str = "project", collector: str = "collector", record_type: str = "record_type", time: str = "initial_time", duration: str = "duration") -> Column:
    return F.concat_ws(".", project, collector, record_type, F.col(time).cast("string"), F.coalesce(F.col(duration), F.lit(0)).cast("string"))
