"""Removal of byte strings that occur more than once, by suffix arrays.

A byte goes if some string of `length` bytes over it also starts elsewhere, in its text or in another.

Routing.  Every window of `length` bytes belongs to one anchor: the `gram`-byte string in it with the least hash,
the last of equals.  Equal windows have equal anchors, so all occurrences of a repeated window lie in stretches
(consecutive windows of one anchor occurrence) with the same anchor, and anchors that occur once need no more work.
Stretches of one anchor with the same bytes are one variant; where an anchor has but one variant, occurring
several times, its windows all repeat.  The other variants go to shards by anchor.

Shards.  A shard builds the suffix array of its variants (Larsson-Sadakane), takes common prefixes (Kasai), and
marks the windows that share `length` bytes with a neighbour.  An anchor with more bytes than a shard holds is spread over several;
its windows that are left single in their shard are then merged across shards by binary search in sorted runs of digests.

Defined results: a null text is empty; equal texts of `length` bytes or more go altogether; shorter texts stay whole; a null
id is kept; an empty table gives no rows.  Only the named columns are read.

Hot keys: an anchor, stretch or text with more than a thousandth of the rows is met by broadcast, not in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stash, text_of
from .shingles import _BYTE, U, flat_bytes, mix, powers, row_slices
from .suffixes import LIMIT, common_prefixes, suffix_array

LENGTH = 400
GRAM = 100
SHARD_BYTES = 1 << 20
PIECE = 1 << 22
PLACE_BITS = 24
LOW = U((1 << PLACE_BITS) - 1)


def stretches(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor hash, first and last window start, within the row) of the stretches of each row of `raw`."""
    w, grams = length - gram + 1, len(raw) - gram + 1
    windows = len(raw) - length + 1
    if windows <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * down[:grams])
    order = np.full(-(-grams // w) * w, ~U(0))
    order[:grams] = hashes & ~LOW | (LOW - np.arange(grams, dtype=U))
    blocks = order.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    owner = (LOW - (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & LOW)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:windows]
    start = np.flatnonzero(np.arange(windows) + length <= at[1:][row])
    cut = np.ones(len(start), bool)
    cut[1:] = (owner[start[1:]] != owner[start[:-1]]) | (row[start[1:]] != row[start[:-1]])
    first = start[cut]
    last = start[np.append(np.flatnonzero(cut)[1:] - 1, len(start) - 1)] if len(start) else start
    return row[first], hashes[owner[first]], first - at[row[first]], last - at[row[first]]


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in row_slices(batch["text"]):
            raw, at = flat_bytes(batch["text"].slice(a, b - a))
            rows, anchors, firsts, lasts = [], [], [], []
            pieces = [(raw, at, 0)] if len(raw) <= PIECE else [(raw[k : k + PIECE + length - 1], np.array([0, min(PIECE + length - 1, len(raw) - k)]), k) for k in range(0, len(raw), PIECE)]
            for part, offsets, base in pieces:
                row, anchor, first, last = stretches(part, offsets, length, gram)
                rows.append(row)
                anchors.append(anchor)
                firsts.append(first + base)
                lasts.append(last + base)
            offsets = np.searchsorted(np.concatenate(rows), np.arange(b - a + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x).view(np.int64))) for x in (anchors, firsts, lasts)]
            yield pa.RecordBatch.from_arrays([batch["content"].slice(a, b - a), *lists], ["content", "anchors", "firsts", "lasts"])


def _fingerprints(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "anchor", "first", "last", "body"]
    for batch in (whole.slice(a, b - a) for whole in batches for a, b in row_slices(whole["text"])):
        rows: list[tuple] = []
        for i, text, found in zip(*(batch[c].to_pylist() for c in ("id", "text", "found")), strict=True):
            raw = text.encode()
            for x in found:
                body = raw[x["first"] : x["last"] + length]
                rows.append((i, x["anchor"], x["first"], x["last"], hashlib.blake2b(body, digest_size=16).digest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names)


def _bodies(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(a, b - a) for whole in batches for a, b in row_slices(whole["text"])):
        rows: list[tuple] = []
        for text, wanted in zip(batch["text"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
            raw = text.encode()
            rows += [(x["vid"], x["shard"], x["anchor"], x["spread"], raw[x["first"] : x["last"] + length]) for x in wanted]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], ["vid", "shard", "anchor", "spread", "bytes"])


def repeated_windows(strings: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each string its window starts that occur elsewhere in `strings`, and one start of each class that does not or that stands for its class."""
    size = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    base = np.cumsum(size) - size
    owner, end = np.repeat(np.arange(len(strings)), size), np.repeat(base + size, size)
    sa = suffix_array(data, owner, end)
    shared = common_prefixes(data, end, sa, length) >= length
    shared[0] = False
    after = np.append(shared[1:], False)
    full = end[sa] - sa >= length
    marks = np.zeros((2, len(data)), bool)
    marks[0, sa[(shared | after) & full]] = True
    marks[1, sa[~shared & full]] = True
    return tuple([np.flatnonzero(m[b : b + n]) for b, n in zip(base, size, strict=True)] for m in marks)


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


_RUN = pa.list_(pa.struct([("digest", pa.binary()), ("vid", pa.int64()), ("at", pa.int32())]))
_FOUND = pa.schema([("vid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("bucket", pa.string()), ("run", _RUN)])
FOUND = "vid long, lo int, hi int, bucket string, run array<struct<digest:binary,vid:bigint,at:int>>"


def _shard(table: pa.Table, length: int) -> pa.Table:
    """Repeated windows as ranges; of a spread anchor also a window of each class, in a sorted run of digests for each bucket.

    The anchor has as many buckets as shards, so a bucket is about as large as a shard.
    """
    rows = sorted(zip(table["anchor"].to_pylist(), table["vid"].to_pylist(), table["spread"].to_pylist(), table["bytes"].to_pylist(), strict=True))
    found: list[tuple] = []
    runs: dict[str, list[dict]] = {}
    start = 0
    while start < len(rows):
        stop, total = start, 0
        while stop < len(rows) and (total + len(rows[stop][3]) <= LIMIT or stop == start):
            total += len(rows[stop][3])
            stop += 1
        if stop < len(rows) and not rows[start][2]:  # an anchor that is not spread stays together
            back = stop
            while back > start and rows[back][0] == rows[back - 1][0]:
                back -= 1
            stop = back if back > start else stop
        part = rows[start:stop]
        repeated, single = repeated_windows([r[3] for r in part], length)
        for (anchor, vid, spread, body), again, one in zip(part, repeated, single, strict=True):
            found += [(vid, lo, hi, None, None) for lo, hi in _runs(again)]
            for s in one.tolist() if spread else ():
                digest = hashlib.blake2b(body[s : s + length], digest_size=16).digest()
                runs.setdefault(f"{anchor}-{int.from_bytes(digest[:4], 'big') % spread}", []).append({"digest": digest, "vid": vid, "at": s})
        start = stop
    found += [(None, None, None, bucket, sorted(run, key=lambda x: x["digest"])) for bucket, run in runs.items()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [()] * 5, _FOUND, strict=True)], schema=_FOUND)


def _merge(table: pa.Table) -> pa.Table:
    """The windows of a bucket whose digest is in another run too, found by binary search in the merged runs."""
    rows = [x for run in table["run"].to_pylist() for x in run]
    digests = np.array([x["digest"] for x in rows], dtype="S16")
    merged = np.sort(digests, kind="stable")
    again = np.searchsorted(merged, digests, "right") - np.searchsorted(merged, digests, "left") > 1
    found: dict[int, list[int]] = {}
    for i in np.flatnonzero(again):
        found.setdefault(rows[i]["vid"], []).append(rows[i]["at"])
    out = [(vid, lo, hi) for vid, starts in found.items() for lo, hi in _runs(np.sort(np.array(starts)))]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 3, list(_FOUND)[:3], strict=True)], schema=pa.schema(list(_FOUND)[:3]))


def _strip(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(a, b - a) for whole in batches for a, b in row_slices(whole["text"])):
        rows: list[tuple] = []
        for i, text, ranges in zip(*(batch[c].to_pylist() for c in ("id", "text", "ranges")), strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, [r["lo"] for r in ranges], 1)
            np.add.at(edge, [r["hi"] + length for r in ranges], -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            rows.append((i, int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], ["id", "n_removed", "n_spans", "kept_sha256"])


def strip_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, has_repeat) of every row."""
    named = docs.select("doc_id", text_of().alias("text"))
    hashed = named.select("doc_id", "text", F.sha2("text", 256).alias("content"))
    sketched = hashed.select("content", "text").where(F.octet_length("text") >= length).mapInArrow(lambda it: _anchors(it, length, gram), "content string, anchors array<long>, firsts array<long>, lasts array<long>")
    distinct = sketched.groupBy("content").agg(F.min(F.struct("anchors", "firsts", "lasts")).alias("s"), F.count("*").alias("copies"))
    texts = stash(distinct.select(F.monotonically_increasing_id().alias("id"), "content", "copies", "s.*"), "anchors")

    # Anchors that occur twice among distinct texts, and the texts that have them.
    placed = texts.select("id", F.explode(F.arrays_zip("anchors", "firsts", "lasts")).alias("x")).select("id", F.col("x.anchors").alias("anchor"), F.col("x.firsts").alias("first"), F.col("x.lasts").alias("last"))
    twice = stash(placed.groupBy("anchor").agg(F.count("*").alias("places")).where("places > 1"), "twice")
    found = hot_join(placed, twice, ["anchor"], "places").groupBy("id").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("found"))
    wanted = texts.select("id", "content").join(found, "id")
    bodies = hashed.select("content", "text").dropDuplicates(["content"]).join(wanted, "content")
    bodies = stash(bodies.select("id", "text", "found"), "bodies")
    occurrences = stash(bodies.mapInArrow(lambda it: _fingerprints(it, length), "id long, anchor long, first long, last long, body binary"), "stretches")

    # Variants of an anchor; those of anchors with several go to shards.
    variants = occurrences.groupBy("anchor", "body").agg(F.count("*").alias("n"), F.min(F.struct("id", "first", "last")).alias("where"))
    size = F.col("where.last") - F.col("where.first") + length
    variants = stash(variants.select(F.monotonically_increasing_id().alias("vid"), "anchor", "body", "n", "where", size.alias("size")), "variants")
    load = stash(variants.groupBy("anchor").agg(F.sum("size").alias("load"), F.count("*").alias("kinds")).where("kinds > 1"), "loads")
    several = hot_join(variants, load, ["anchor"], "kinds")
    total = several.where(F.col("load") <= shard_bytes).agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-2 * total // shard_bytes))
    spread = F.when(F.col("load") > shard_bytes, F.ceil(2 * F.col("load") / shard_bytes)).otherwise(0).cast("long")
    shard = F.when(spread > 0, F.concat_ws("-", F.lit("spread"), "anchor", F.pmod(F.xxhash64("vid"), spread))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("string"))
    asked = several.select(F.col("where.id").alias("id"), F.struct("vid", shard.alias("shard"), "anchor", spread.alias("spread"), "where.first", "where.last").alias("x"))
    asked = asked.groupBy("id").agg(F.collect_list("x").alias("wanted"))
    pieces = bodies.select("id", "text").join(asked, "id").select("text", "wanted").mapInArrow(lambda it: _bodies(it, length), "vid long, shard string, anchor long, spread long, bytes binary")
    marked = stash(pieces.groupBy("shard").applyInArrow(lambda t: _shard(t, length), FOUND), "windows")
    merged = marked.where("bucket is not null").groupBy("bucket").applyInArrow(_merge, "vid long, lo int, hi int")
    whole = variants.where("n > 1").select("vid", F.lit(0).alias("lo"), (F.col("size") - length).cast("int").alias("hi"))
    ranges = marked.where("bucket is null").select("vid", "lo", "hi").union(merged).union(whole)

    # Back to the texts.
    ranges = ranges.groupBy("vid").agg(F.collect_list(F.struct("lo", "hi")).alias("r")).join(variants.select("vid", "anchor", "body", "n"), "vid").select("anchor", "body", "n", "r")
    ranges = stash(ranges, "ranges")  # a stretch has at most length - gram + 1 windows, which bounds a row
    shifted = F.transform("r", lambda x: F.struct((x["lo"] + F.col("first")).alias("lo"), (x["hi"] + F.col("first")).alias("hi")))
    covered = hot_join(occurrences, ranges, ["anchor", "body"], "n").select("id", shifted.alias("r")).groupBy("id").agg(F.flatten(F.collect_list("r")).alias("ranges"))
    stripped = bodies.select("id", "text").join(covered, "id").mapInArrow(lambda it: _strip(it, length), "id long, n_removed long, n_spans long, kept_sha256 string")
    known = stash(texts.select("id", "content", "copies").join(stripped, "id", "left").drop("id"), "known")
    rows = hashed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    short = rows.where(F.col("n_bytes") < length)  # has no window, so the many null and empty texts meet nowhere
    rows = hot_join(rows.where(F.col("n_bytes") >= length), known, ["content"], "copies").unionByName(short, allowMissingColumns=True)
    gone = F.col("copies") > 1
    removed = F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    return rows.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "content")).alias("kept_sha256"),
        (F.col("n_bytes") - removed).alias("n_kept"),
        (removed > 0).alias("has_repeat"),
    )
