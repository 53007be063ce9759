"""Benchmark decontamination by size-partitioned MinHash containment.

Items fall into partitions by the power of two of their shingle count.  A partition fixes the length of
the MinHash sketch (the smallest shingle hashes of an item): one more than the shingles that the largest
item of the partition may lack at the threshold.  A document that holds an item to that degree therefore
shares at least one sketch value, however long it is, so candidates lose nothing; each candidate is then
settled on the shingles themselves.

Defined results: a null or wordless text is contained in nothing and contains nothing; a null id is kept as
null; a repeated document row repeats its pairs, a repeated item row
counts once; empty tables give no pairs.  Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .shingles import U, row_slices, shingle_hashes, shingle_set, word_hashes

BROADCAST_BYTES = 32 << 20
SKETCHES = "item_id long, words string, n long, part int, sketch array<long>"


def needed(n: int, threshold: float) -> int:
    return ceil(n * threshold - 1e-9)


def sketch_length(part: int, threshold: float) -> int:
    """Sketch values for items of 2**part to 2**(part + 1) - 1 shingles."""
    largest = (2 << part) - 1
    return largest - needed(largest, threshold) + 1


def _sketch(batches: Iterator[pa.RecordBatch], threshold: float, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in row_slices(batch["text"]):
            lowered = pc.utf8_lower(batch["text"].slice(a, b - a))
            hashes, at = shingle_hashes(*word_hashes(lowered), n)
            rows = []
            for k, (i, words) in enumerate(zip(batch["item_id"].slice(a, b - a).to_pylist(), lowered.to_pylist(), strict=True)):
                own = np.unique(hashes[at[k] : at[k + 1]])
                if len(own):
                    part = len(own).bit_length() - 1
                    rows.append((i, words, len(shingle_set(words, n)), part, own[: sketch_length(part, threshold)].view(np.int64)))
            if rows:
                types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["item_id", "words", "n", "part", "sketch"])


def item_sketches(items: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    return items.select(F.col("item_id").cast("long"), text_of().alias("text")).distinct().mapInArrow(lambda it: _sketch(it, threshold, n), SKETCHES)


def _pairs(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _pair_schema(key: pa.DataType) -> pa.Schema:
    return pa.schema([("key", key), ("item_id", pa.int64()), ("overlap", pa.int64()), ("item_shingles", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch], items, threshold: float, n: int) -> Iterator[pa.RecordBatch]:
    table = items.value
    values = np.concatenate([np.asarray(r.sketch, np.int64).view(U) for r in table]) if table else np.zeros(0, U)
    owner = np.repeat(np.arange(len(table)), [len(r.sketch) for r in table])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    screen = np.zeros(1 << 20, bool)
    screen[(values & U(0xFFFFF)).astype(np.int64)] = True
    sets: dict[int, set] = {}
    for batch in batches:
        rows = []
        for a, b in row_slices(batch["text"]):
            lowered = pc.utf8_lower(batch["text"].slice(a, b - a))
            hashes, at = shingle_hashes(*word_hashes(lowered), n)
            at_hit = np.flatnonzero(screen[(hashes & U(0xFFFFF)).astype(np.int64)])
            low, high = np.searchsorted(values, hashes[at_hit]), np.searchsorted(values, hashes[at_hit], side="right")
            found: dict[int, set[int]] = {}
            for p, i, j in zip(at_hit[high > low], low[high > low], high[high > low], strict=True):
                found.setdefault(int(np.searchsorted(at, p, side="right")) - 1, set()).update(owner[i:j].tolist())
            for k, candidates in found.items():
                own = shingle_set(lowered[k].as_py(), n)
                for c in sorted(candidates):
                    if c not in sets:
                        sets[c] = shingle_set(table[c].words, n)
                    if (overlap := len(sets[c] & own)) >= needed(len(sets[c]), threshold):
                        rows.append((batch["key"][a + k].as_py(), table[c].item_id, overlap, len(sets[c])))
        if rows:
            yield _pairs(rows, _pair_schema(batch.schema.field("key").type))


def _hashes(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in row_slices(batch["text"]):
            hashes, at = shingle_hashes(*word_hashes(pc.utf8_lower(batch["text"].slice(a, b - a))), n)
            keys = batch["key"].slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), np.diff(at))))
            yield pa.RecordBatch.from_arrays([keys, pa.array(hashes.view(np.int64))], ["key", "hash"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, item, words in zip(*(batch[c].to_pylist() for c in ("key", "text", "item_id", "words")), strict=True):
            wanted = shingle_set(words, n)
            if (overlap := len(wanted & shingle_set(pc.utf8_lower(pa.scalar(text)).as_py(), n))) >= needed(len(wanted), threshold):
                rows.append((key, item, overlap, len(wanted)))
        if rows:
            yield _pairs(rows, _pair_schema(pa.string()))


def _contained(docs: DataFrame, items: DataFrame, threshold: float, n: int, broadcast_bytes: int) -> DataFrame:
    """Pairs of the rows (key, text) of `docs`.

    The item table goes to every task only while its measured size is within `broadcast_bytes`; a larger one is
    met by joins on sketch values, then on content digests.
    """
    sketches = item_sketches(items, threshold, n)
    kind = dict(docs.dtypes)["key"]
    if (sketches.agg(F.sum(F.octet_length("words") + 8 * F.size("sketch") + 64)).first()[0] or 0) <= broadcast_bytes:
        held = docs.sparkSession.sparkContext.broadcast(sketches.collect())
        return docs.mapInArrow(lambda it: _search(it, held, threshold, n), f"key {kind}, item_id long, overlap long, item_shingles long")
    keyed = docs.select(F.col("key").alias("row"), "text", F.sha2("text", 256).alias("key"))
    texts = keyed.dropDuplicates(["key"]).select("key", "text")
    values = sketches.select(F.explode("sketch").alias("hash"), "item_id", "words")
    hits = texts.mapInArrow(lambda it: _hashes(it, n), "key string, hash long").join(values, "hash").select("key", "item_id", "words").distinct()
    pairs = hits.join(texts, "key").mapInArrow(lambda it: _verify(it, threshold, n), "key string, item_id long, overlap long, item_shingles long")
    return keyed.select("row", "key").join(pairs, "key").drop("key").withColumnRenamed("row", "key")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, overlap, item_shingles) for every item whose shingles a document holds to `threshold`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), text_of().alias("text"))
    return _contained(rows, items, threshold, n, broadcast_bytes).withColumnRenamed("key", "doc_id")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of `docs` whose text holds no item to `threshold`; texts, not ids, decide."""
    rows = docs.select(F.sha2(text_of(), 256).alias("key"), text_of().alias("text"))
    held = _contained(rows, items, threshold, n, broadcast_bytes).select("key").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(text_of(), 256).alias("key"))
    return whole.join(held, "key", "left_anti").select("row.*")
