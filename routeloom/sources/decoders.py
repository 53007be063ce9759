"""The decoder as SQL table functions.

    SELECT * FROM decode_messages(TABLE(SELECT resource_id, seq, kind, subtype, body FROM messages))
    SELECT m.seq, d.* FROM messages m, LATERAL decode_message(m.kind, m.subtype, m.body) d

The first takes whole Arrow batches and is the one for tables; the second, for a few rows beside other columns, goes by rows, as Spark allows no Arrow function after LATERAL.  A message that does not decode gives one row of elem_type `corrupt`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..types import ELEM
from . import wire

_PATH = pa.list_(pa.struct([("type", pa.int32()), ("asns", pa.list_(pa.int64()))]))
_COMMUNITIES = pa.list_(pa.struct([("asn", pa.int32()), ("value", pa.int32())]))
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_NESTED = {"as_path": _PATH, "as4_path": _PATH, "communities": _COMMUNITIES}


def _schema() -> pa.Schema:
    fields, depth, start = [], 0, 0
    for k, c in enumerate(ELEM + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = ELEM[start:k].split(maxsplit=1)
            fields.append((name, _NESTED.get(name) or _TYPES[kind]))
            start = k + 1
    return pa.schema(fields)


SCHEMA = _schema()
ALONE = ELEM.split("seq bigint, ")[1]


def elem_rows(kind: int, subtype: int, body: bytes | None) -> Iterator[dict]:
    """The elems of a message as values of their columns."""
    try:
        found = wire.decode(kind, subtype, body) if body is not None else []
    except wire.WireError:
        found = [{"elem_type": "corrupt"}]
    for k, e in enumerate(found):
        for name in ("as_path", "as4_path"):
            if e.get(name) is not None:
                e[name] = [{"type": t, "asns": a} for t, a in e[name]]
        if e.get("communities") is not None:
            e["communities"] = [{"asn": a, "value": v} for a, v in e["communities"]]
        yield {**e, "elem_idx": k}


@arrow_udtf(returnType=ELEM)
class DecodeMessages:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        columns = [batch.column(c).to_pylist() for c in ("resource_id", "seq", "kind", "subtype", "body")]
        rows = [{**e, "resource_id": rid, "seq": seq} for rid, seq, *message in zip(*columns, strict=True) for e in elem_rows(*message)]
        yield pa.Table.from_pylist(rows, schema=SCHEMA)


@udtf(returnType=ALONE, useArrow=False)
class DecodeMessage:
    def eval(self, kind: int, subtype: int, body: bytes) -> Iterator[tuple]:
        for e in elem_rows(kind, subtype, body):
            yield tuple(e.get(c) for c in SCHEMA.names[2:])


def register(spark: SparkSession) -> None:
    """Makes both functions known to the session's SQL."""
    spark.udtf.register("decode_messages", DecodeMessages)
    spark.udtf.register("decode_message", DecodeMessage)
