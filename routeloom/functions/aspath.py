"""AS paths as arrays of segments (type, asns); a sequence is one segment for each hop."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import AS_PATH, SEGMENT

#: How each segment type is written.
BRACKETS = {2: ("{", ",", "}"), 3: ("(", " ", ")"), 4: ("[", ",", "]")}
OTHER = ("<", " ", ">")


def segment_text(segment: Column) -> Column:
    asns = F.transform(segment["asns"], lambda a: a.cast("string"))
    text = F.when(segment["type"] == SEGMENT["asn"], asns[0])
    for kind, (left, between, right) in BRACKETS.items():
        text = text.when(segment["type"] == kind, F.concat(F.lit(left), F.array_join(asns, between), F.lit(right)))
    left, between, right = OTHER
    return text.otherwise(F.concat(F.lit(left), F.array_join(asns, between), F.lit(right)))


def path_text(path: Column) -> Column:
    return F.array_join(F.transform(path, segment_text), " ")


def parse_path(text: Column) -> Column:
    """The rendered form back to segments; null stays null."""
    tokens = F.regexp_extract_all(text, F.lit(r"[0-9]+|\{[^}]*\}|\([^)]*\)|\[[^\]]*\]|<[^>]*>"), F.lit(0))

    def segment(token: Column) -> Column:
        first = F.substring(token, 1, 1)
        kind = F.when(first == "{", 2).when(first == "(", 3).when(first == "[", 4).when(first == "<", 9).otherwise(1)
        asns = F.transform(F.regexp_extract_all(token, F.lit("[0-9]+"), F.lit(0)), lambda a: a.cast("long"))
        return F.struct(kind.alias("type"), asns.alias("asns"))

    return F.transform(tokens, segment).cast(AS_PATH)


def append(path: Column, kind: int, asns: Column) -> Column:
    """`path` with one more segment; a sequence adds a segment for each of its hops."""
    one = F.transform(asns, lambda a: F.struct(F.lit(1).alias("type"), F.array(a).alias("asns"))) if kind == 1 else F.array(F.struct(F.lit(kind).alias("type"), asns.alias("asns")))
    return F.concat(path, one.cast(AS_PATH))


def path_length(path: Column) -> Column:
    return F.size(path)


def origin_segment(path: Column) -> Column:
    return F.try_element_at(path, F.lit(-1))


def origin_asn(path: Column) -> Column:
    """The last hop if it is a plain AS number."""
    last = origin_segment(path)
    return F.when(last["type"] == SEGMENT["asn"], last["asns"][0])


def core_path(path: Column, peer_asn: Column) -> tuple[Column, Column]:
    """The path without a leading peer hop, and whether it was taken off."""
    first = F.try_element_at(path, F.lit(1))
    strip = F.coalesce((F.size(path) > 1) & (first["type"] == SEGMENT["asn"]) & (first["asns"][0] == peer_asn), F.lit(False))
    return F.when(strip, F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(1)))).otherwise(path), strip


def full_path(core: Column, stripped: Column, peer_asn: Column) -> Column:
    hop = F.array(F.struct(F.lit(1).alias("type"), F.array(peer_asn).alias("asns"))).cast(AS_PATH)
    return F.when(stripped, F.concat(hop, core)).otherwise(core)


def mix32(value: Column) -> Column:
    """A 32-bit integer mix on non-negative longs; every step is cut to 32 bits."""
    cut = lambda x: x.bitwiseAND(0xFFFFFFFF)
    x = cut(value)
    for shift, factor in ((16, 0x45D9F3B), (16, 0x45D9F3B)):
        x = cut(x.bitwiseXOR(F.shiftrightunsigned(x, shift)) * F.lit(factor).cast("long"))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def path_hash(path: Column) -> Column:
    """A 32-bit hash of the first hop and the origin; 0 for an empty path, a set counts as its first member."""
    first, last = F.try_element_at(path, F.lit(1))["asns"][0], origin_segment(path)["asns"][0]
    word = F.shiftleft(first.bitwiseAND(0xFFFF), 8).bitwiseOR(last.bitwiseAND(0xFFFF))
    return F.when(F.size(path) > 0, mix32(word)).when(path.isNotNull(), F.lit(0).cast("long"))


def hop_count(path: Column) -> Column:
    """Hops for merging: a hop or a set is one, confederation segments none."""
    return F.aggregate(path, F.lit(0), lambda n, s: n + F.when(s["type"] <= 2, 1).otherwise(0))


def merge_as4(path: Column, as4: Column) -> Column:
    """The path of a two-octet speaker with its four-octet tail: leading hops until as many as `as4` has are left, then `as4`."""
    keep = hop_count(path) - hop_count(as4)
    reach = lambda acc, s: F.struct(
        (acc["n"] + F.when(s["type"] <= 2, 1).otherwise(0)).alias("n"), F.when(acc["n"] < keep, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out")
    )
    head = F.aggregate(path, F.struct(F.lit(0).alias("n"), F.array().cast(AS_PATH).alias("out")), reach, lambda acc: acc["out"])
    return F.when(as4.isNull() | (path.isNotNull() & (keep < 0)), path).when(path.isNull(), as4).otherwise(F.concat(head, as4))


#: Fixed value: the longest translation that is taken.
LONGEST = 241
BOUNDARY = "(^|$|[ {},_])"


class PathPatternError(ValueError):
    pass


def translate_pattern(pattern: str) -> tuple[bool, str]:
    """(negated, Java pattern) of a router-style path pattern.

    An underscore is a boundary and opens a group, so later back references count on; braces stand for themselves.
    """
    negated, out, groups, at = pattern.startswith("!"), [], [], 0
    body = pattern[1:] if negated else pattern
    while at < len(body):
        c = body[at]
        if c == "_":
            groups.append(False)
            out.append(BOUNDARY)
        elif c in "{}":
            out.append("\\" + c)
        elif c == "\\" and at + 1 < len(body):
            at += 1
            if body[at].isdigit():
                own = [k for k, mine in enumerate(groups, 1) if mine]
                n = int(body[at])
                out.append(f"\\{own[n - 1]}" if 0 < n <= len(own) else f"\\{n}")
            else:
                out.append("\\" + body[at])
        else:
            if c == "(":
                groups.append(True)
            out.append(c)
        at += 1
    text = "".join(out)
    if len(text) > LONGEST:
        raise PathPatternError(f"path pattern is too long: {pattern}")
    if re.search(r"\(\?|&&", text):
        raise PathPatternError(f"path pattern has syntax of another dialect: {pattern}")
    return negated, text


def matches(text: Column, pattern: str) -> Column:
    negated, java = translate_pattern(pattern)
    return ~text.rlike(java) if negated else text.rlike(java)
