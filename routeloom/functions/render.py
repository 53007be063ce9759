"""Text of records and elems, and its reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ORIGINS, PEER_STATES, named
from . import aspath
from .times import time_text


def _joined(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def record_line() -> Column:
    """type|pos|sec.usec|project|collector|router|router-ip|status|dump-time"""
    return _joined(F.col("rec_type"), F.col("dump_pos"), time_text(F.col("time_sec"), F.col("time_usec")), F.col("project"), F.col("collector"), F.col("router"), F.col("router_ip"), F.col("status"), _text("dump_time"))


def origin_text(path: Column) -> Column:
    return aspath.segment_text(aspath.origin_segment(path))


def elem_line(last_field: Column | None = None) -> Column:
    """rectype|elemtype|sec.usec|project|collector|router|router-ip|peer-asn|peer-ip|prefix|nexthop|as-path|origin|communities|old|new

    Prefix, next hop, path, origin and communities are text columns; peer states count from 0.  Fields that a kind lacks are empty.
    """
    kind = F.col("elem_type")
    route, state = kind.isin("R", "A"), kind == "S"
    new = F.when(state, named(PEER_STATES, F.col("new_state")))
    return _joined(
        F.col("rec_type"), kind, time_text(F.col("time_sec"), F.col("time_usec")), F.col("project"), F.col("collector"), F.col("router"), F.col("router_ip"),
        _text("peer_asn"), F.col("peer_ip"), F.when(~state, F.col("prefix_text")), F.when(route, F.col("nexthop")), F.when(route, F.col("as_path_text")), F.when(route, F.col("origin_text")),
        F.when(route, F.col("communities_text")), F.when(state, named(PEER_STATES, F.col("old_state"))), new if last_field is None else F.coalesce(last_field, new),
    )


def dump_line() -> Column:
    """The one-line dump form: TABLE_DUMP2 for ribs, BGP4MP for updates; absent preferences are 0."""
    kind = F.col("elem_type")
    head = [F.when(kind == "R", "TABLE_DUMP2").otherwise("BGP4MP"), _text("time_sec"), F.when(kind == "R", "B").when(kind == "S", "STATE").otherwise(kind), F.col("peer_ip"), _text("peer_asn")]
    number = lambda c: F.coalesce(_text(c), F.lit("0"))
    aggregator = F.concat_ws(" ", _text("agg_asn"), F.col("agg_ip"))
    route = _joined(*head, F.col("prefix_text"), F.col("as_path_text"), named(ORIGINS, F.col("origin")), F.col("nexthop"), number("local_pref"), number("med"), F.col("communities_text"), F.when(F.col("atomic"), "AG").otherwise("NAG"), aggregator, F.lit(""))
    return F.when(kind == "S", _joined(*head, number("old_state"), number("new_state"))).when(kind == "W", _joined(*head, F.col("prefix_text"))).otherwise(route)


FIELDS = ("rec_type", "elem_type", "time", "project", "collector", "router", "router_ip", "peer_asn", "peer_ip", "prefix_text", "nexthop", "as_path_text", "origin_text", "communities_text", "old_name", "new_name")


def parse_elem_line(line: Column) -> list[Column]:
    """The fields of an elem line; empty ones are null."""
    parts = F.split(line, r"\|", -1)
    return [F.nullif(F.try_element_at(parts, F.lit(k + 1)), F.lit("")).alias(name) for k, name in enumerate(FIELDS)]
