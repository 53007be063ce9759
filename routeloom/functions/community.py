"""Communities as arrays of (asn, value), in their order, repeats kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import COMMUNITIES


def communities_text(communities: Column) -> Column:
    return F.array_join(F.transform(communities, lambda c: F.concat_ws(":", c["asn"].cast("string"), c["value"].cast("string"))), " ")


def parse_communities(text: Column) -> Column:
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(F.split(w, ":")[0].cast("int").alias("asn"), F.split(w, ":")[1].cast("int").alias("value"))).cast(COMMUNITIES)


def parse_pattern(pattern: str) -> tuple[int | None, int | None]:
    """`asn:value`, either of them possibly `*`, which comes back as None."""
    asn, colon, value = pattern.partition(":")
    if not colon or not all(x == "*" or (x.isascii() and x.isdigit() and int(x) <= 65535) for x in (asn, value)):
        raise ValueError(f"bad community: {pattern}")
    return (None if asn == "*" else int(asn)), (None if value == "*" else int(value))


def match(communities: Column, pattern: str) -> Column:
    asn, value = parse_pattern(pattern)

    def fits(c: Column) -> Column:
        met = F.lit(True)
        if asn is not None:
            met = met & (c["asn"] == asn)
        return met if value is None else met & (c["value"] == value)

    return F.coalesce(F.exists(communities, fits), F.lit(False))


def set_hash(communities: Column) -> Column:
    """A 32-bit hash of the communities in their order."""
    word = lambda c: F.shiftleft(c["asn"].cast("long"), 16).bitwiseOR(c["value"].cast("long"))
    return F.aggregate(communities, F.lit(0).cast("long"), lambda h, c: (F.shiftleft(h, 5) - h + word(c)).bitwiseAND(0xFFFFFFFF))
