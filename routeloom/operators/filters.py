"""The filter language: a string of clauses, parsed to an immutable `Filters`, turned into columns.

Kinds are joined by AND, values of a kind by OR; path patterns all have to hold.  Conjuncts are split by the
relation they restrict (resources, records, elems), so that each reaches the earliest scan that has its columns.
"""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aspath, community, ip
from ..types import ELEM_TYPES, SEGMENT

#: The words of the language.
TERMS = {
    "project": "project", "proj": "project", "collector": "collector", "coll": "collector", "router": "router", "rout": "router",
    "type": "type", "resourcetype": "resourcetype", "restype": "resourcetype", "peer": "peer", "origin": "origin", "orig": "origin",
    "prefix": "prefix", "pref": "prefix", "community": "community", "comm": "community", "aspath": "aspath", "path": "aspath",
    "extcommunity": "extcommunity", "extc": "extcommunity", "ipversion": "ipversion", "elemtype": "elemtype",
}
SPECIFICITY = ("any", "more", "less", "exact")
FEW_PREFIXES = 16
FEW_VALUES = 200


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Filters:
    project: tuple[str, ...] = ()
    collector: tuple[str, ...] = ()
    router: tuple[str, ...] = ()
    type: tuple[str, ...] = ()
    resourcetype: tuple[str, ...] = ()
    peer: tuple[int, ...] = ()
    not_peer: tuple[int, ...] = ()
    origin: tuple[int, ...] = ()
    prefix: tuple[tuple[str, str], ...] = ()
    community: tuple[str, ...] = ()
    aspath: tuple[str, ...] = ()
    ipversion: int | None = None
    elemtype: tuple[str, ...] = ()
    begin: int | None = None
    end: int | None = None
    rib_period: int | None = field(default=None)

    def add(self, kind: str, value: str, specificity: str = "more") -> Filters:
        """One more value, checked."""
        if kind in ("peer", "not_peer", "origin"):
            if not value.isdigit() or int(value) >= 1 << 32:
                raise FilterError(f"bad AS number: {value}")
            return replace(self, **{kind: (*getattr(self, kind), int(value))})
        if kind == "ipversion":
            if value not in ("4", "6"):
                raise FilterError(f"bad IP version: {value}")
            return replace(self, ipversion=int(value))
        if kind == "prefix":
            try:
                net = ipaddress.ip_network(value, strict=False)
            except ValueError as e:
                raise FilterError(f"bad prefix: {value}") from e
            return replace(self, prefix=(*self.prefix, (specificity, str(net))))
        if kind == "community":
            try:
                community.parse_pattern(value)
            except ValueError as e:
                raise FilterError(str(e)) from e
        elif kind == "aspath":
            aspath.translate_pattern(value)
        elif kind == "extcommunity":
            raise FilterError("extended communities are not supported")
        known = {"type": ("ribs", "updates"), "resourcetype": ("stream", "batch"), "elemtype": tuple(ELEM_TYPES)}.get(kind)
        if known and value not in known:
            raise FilterError(f"bad {kind}: {value}")
        if kind not in self.__dataclass_fields__:
            raise FilterError(f"unknown kind: {kind}")
        return replace(self, **{kind: (*getattr(self, kind), value)})

    def between(self, begin: int, end: int | None) -> Filters:
        """Times, both inclusive; no end, or 0, is forever.  The last call counts."""
        if end and begin > end:
            raise FilterError("interval ends before it begins")
        return replace(self, begin=begin, end=end or None)


def _tokens(text: str) -> list[tuple[str, bool]]:
    """Words and whether they were quoted; only spaces part words, and a closing quote ends one."""
    out, at = [], 0
    while at < len(text):
        if text[at] == " ":
            at += 1
        elif text[at] == '"':
            close = text.find('"', at + 1)
            if close < 0 or text[close + 1 : close + 2] not in ("", " "):
                raise FilterError("unbalanced quote")
            out.append((text[at + 1 : close], True))
            at = close + 1
        else:
            stop = text.find(" ", at)
            stop = len(text) if stop < 0 else stop
            out.append((text[at:stop], False))
            at = stop
    return out


def parse(text: str, start: Filters | None = None) -> Filters:
    """`term value... and term value...`; each term once, `aspath` as often as needed with one value each."""
    filters, words, seen, at = start or Filters(), _tokens(text), set(), 0
    if not words:
        raise FilterError("empty filter")
    while True:
        if at >= len(words) or words[at][0] not in TERMS or words[at][1]:
            raise FilterError(f"term expected: {words[at][0] if at < len(words) else 'end'}")
        kind = TERMS[words[at][0]]
        if kind in seen and kind != "aspath":
            raise FilterError(f"repeated term: {kind}")
        seen.add(kind)
        at, values, specificity = at + 1, 0, "more"
        while at < len(words) and (words[at][1] or words[at][0] != "and"):
            word, quoted = words[at]
            if word == "or" and not quoted:
                raise FilterError("'or' is not part of the language")
            if kind == "prefix" and word in SPECIFICITY and not quoted:
                specificity = word
                if at + 1 >= len(words) or words[at + 1][0] == "and":
                    raise FilterError("prefix expected")
            else:
                if kind == "aspath" and values:
                    raise FilterError("aspath takes one value")
                filters, values = filters.add(kind, word, specificity), values + 1
            at += 1
        if not values:
            raise FilterError(f"{kind} needs a value")
        if at >= len(words):
            return filters
        at += 1


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def resource_conditions(f: Filters) -> list[Column]:
    found = [F.col(c).isin(*v) for c, v in (("project", f.project), ("collector", f.collector), ("record_type", f.type)) if v]
    if len(set(f.resourcetype)) == 1:
        found.append(F.col("duration").isNull() if f.resourcetype[0] == "stream" else F.col("duration").isNotNull())
    return found


def record_conditions(f: Filters, time: str = "time_sec") -> list[Column]:
    found = [F.col(c).isin(*v) for c, v in (("project", f.project), ("collector", f.collector), ("router", f.router)) if v]
    if f.begin is not None:
        found.append(F.col(time) >= f.begin)
    if f.end is not None:
        found.append(F.col(time) <= f.end)
    return found


def _bits(text: str) -> tuple[int, int, int, int]:
    """(ver, hi, lo, len) of a prefix, as the columns have them."""
    net = ipaddress.ip_network(text)
    value = int(net.network_address)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hi, lo = (0, value) if net.version == 4 else (signed(value >> 64), signed(value & ((1 << 64) - 1)))
    return net.version, hi, lo, net.prefixlen


def prefix_condition(prefix: Column, wanted: tuple[tuple[str, str], ...]) -> Column:
    """An OR of comparisons on the network and the length; `prefix` is (ver, hi, lo, len)."""
    met = F.lit(False)
    for specificity, text in wanted:
        ver, hi, lo, length = _bits(text)
        f = F.struct(F.lit(ver).alias("ver"), F.lit(hi).cast("long").alias("hi"), F.lit(lo).cast("long").alias("lo"), F.lit(length).alias("len"))
        if specificity == "exact":
            one = (prefix["ver"] == ver) & (prefix["len"] == length) & (prefix["hi"] == hi) & (prefix["lo"] == lo)
        elif specificity == "more":
            one = ip.contains(f, prefix)
        elif specificity == "less":
            one = ip.contains(prefix, f)
        else:
            one = ip.contains(f, prefix) | ip.contains(prefix, f)
        met = met | one
    return F.coalesce(met, F.lit(False))


def elem_conditions(f: Filters, few_prefixes: int = FEW_PREFIXES, few_values: int = FEW_VALUES) -> list[Column]:
    """Conjuncts in the order cheap to dear; long lists are left to `apply`, which joins them."""
    kind = F.col("elem_type")
    found = []
    if f.elemtype:
        found.append(kind.isin(*(ELEM_TYPES[x] for x in f.elemtype)))
    if 0 < len(f.peer) <= few_values:
        found.append(F.col("peer_asn").isin(*f.peer))
    if 0 < len(f.not_peer) <= few_values:
        found.append(F.coalesce(~F.col("peer_asn").isin(*f.not_peer), F.lit(True)))
    if 0 < len(f.origin) <= few_values:
        last = aspath.origin_segment(F.col("path"))
        found.append(kind.isin("R", "A") & (last["type"] == SEGMENT["asn"]) & last["asns"][0].isin(*f.origin))
    if f.ipversion:
        found.append((kind != "S") & (F.col("prefix")["ver"] == f.ipversion))
    if f.prefix and len(f.prefix) <= few_prefixes:
        found.append((kind != "S") & prefix_condition(F.col("prefix"), f.prefix))
    for pattern in f.aspath:
        found.append(kind.isin("R", "A") & aspath.matches(F.coalesce(F.col("as_path"), F.lit("")), pattern))
    if 0 < len(f.community) <= few_values:
        found.append(kind.isin("R", "A") & reduce(lambda a, b: a | b, (community.match(F.col("communities"), p) for p in f.community)))
    return found


def apply(elems: DataFrame, f: Filters, few_prefixes: int = FEW_PREFIXES, few_values: int = FEW_VALUES) -> DataFrame:
    """Elems (with the columns of their record) that pass every filter."""
    from . import valuesets
    from .prefixes import matching

    found = elems.where(all_of([*record_conditions(f), *elem_conditions(f, few_prefixes, few_values)]))
    spark = elems.sparkSession
    for values, keep in ((f.peer, valuesets.keep_peers), (f.not_peer, valuesets.drop_peers), (f.origin, valuesets.keep_origins)):
        if len(values) > few_values:
            found = keep(found, spark.createDataFrame([(v,) for v in values], "value bigint"))
    if len(f.community) > few_values:
        found = valuesets.keep_communities(found, spark.createDataFrame([community.parse_pattern(c) for c in f.community], "asn int, value int"))
    if len(f.prefix) > few_prefixes:
        wanted = spark.createDataFrame([(s, (*_bits(text),)) for s, text in f.prefix], "specificity string, prefix struct<ver:int,hi:bigint,lo:bigint,len:int>")
        found = matching(found.where("elem_type <> 'S'"), wanted)
    return found
