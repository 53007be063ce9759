"""Near-duplicate classes by Order MinHash.

Sketch.  Words are shingled by `n`; each shingle is labelled with its occurrence number in the text.  A band
hashes the labelled shingles anew, takes the `sample` least, and keeps them in text order; two texts collide
in a band where they agree on those shingles and on their order.

Check.  The similarity of two texts is L / (m + n - L) for their m and n shingles and the L shingles of the best
order-preserving alignment.  Only a band around the diagonal can reach the threshold, and only that is aligned.

Classes.  A bucket's text with the most company in its buckets is its representative.  Each text is first aligned with one
representative only, so these links are fewer than texts, and what they join need not meet again.  Buckets that still
hold several components go on: those of up to SMALL texts give their pairs of different components, which are aligned once each.
In larger ones, the texts outside the bucket's main component meet the texts of that component, once for all buckets,
and each other.  Both is worked off in cells of a bounded number of shingles and texts, which count shared shingles,
align those pairs that share enough and return links that join what is similar, fewer than they have texts.
No pair is left out by a cap.  Classes are the connected components of the links.

Long texts: alignment takes the matches within the band, about as many as shingles where these seldom repeat, and falls back
to the full band where they repeat much.

Defined results: equal texts are one text throughout; a text of 1 to n-1 words has one shingle; a text without words (null,
empty) is alone, in the class of its own id; a class is named by its least id, null if all are null; an empty table
gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, text_of
from .components import components
from .shingles import U, mix, row_slices, shingle_hashes, word_hashes

BANDS = 20
SAMPLE = 3
SMALL = 8
CELL_SHINGLES = 1 << 20
CELL_TEXTS = 1024
LAST = U(0xFFFFFFFFFFFFFFFF)


def occurrence_labels(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, number of earlier equal shingles of the same text)."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h)) - start
    return mix(hashes + rank.astype(U) * U(0xA24BAED4963EE407))


def order_sketches(hashes: np.ndarray, at: np.ndarray, bands: int = BANDS, sample: int = SAMPLE) -> np.ndarray:
    """A key for each text with shingles (rows) and band (columns)."""
    count = np.diff(at)
    count = count[count > 0]
    if not len(count):
        return np.zeros((0, bands), U)
    starts, owner = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
    labelled = occurrence_labels(hashes, owner)
    keys = np.empty((len(count), bands), U)
    for band in range(bands):
        seed = mix(np.array([band + 1], U) * U(0x9FB21C651E98DF25))[0]
        values = mix(labelled ^ seed)
        places = np.full((len(count), sample), len(hashes), np.int64)
        for k in range(sample):
            least = np.minimum.reduceat(values, starts)
            where = np.flatnonzero((values == least[owner]) & (values != LAST))
            places[owner[where], k] = where
            values[where] = LAST
        places.sort(axis=1)
        chosen = np.append(hashes, U(0))[places]
        key = np.full(len(count), seed, U)
        for k in range(sample):
            key = mix(key + chosen[:, k])
        keys[:, band] = key
    return keys


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether L / (len(a) + len(b) - L) reaches the threshold, L the longest common subsequence."""
    need = ceil((len(a) + len(b)) * threshold / (1 + threshold) - 1e-9)
    short = min(len(a), len(b))
    if need > short:
        return False
    same = a[:short] == b[:short]
    head = short if same.all() else int(same.argmin())
    a, b, need, short = a[head:], b[head:], need - head, short - head
    same = a[len(a) - short :] == b[len(b) - short :]
    tail = short if same.all() else int(same[::-1].argmin())
    a, b, need = a[: len(a) - tail], b[: len(b) - tail], need - tail
    if need <= 0:
        return True
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[i], cb[j]).sum() < need:
        return False
    once = (ca[i] == 1) & (cb[j] == 1)
    if once.sum() >= need:  # shingles that occur once in both: if they stand in the same order, they are an alignment
        at_a, at_b = np.argsort(a, kind="stable")[(np.cumsum(ca) - ca)[i[once]]], np.argsort(b, kind="stable")[(np.cumsum(cb) - cb)[j[once]]]
        if (np.diff(at_b[np.argsort(at_a)]) > 0).all():
            return True
    left, right = len(a) - need, len(b) - need  # no path may leave out more
    codes = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    ca, cb = codes[: len(a)], codes[len(a) :]
    return banded_length(ca, cb, left, right) >= need


def banded_length(a: np.ndarray, b: np.ndarray, left: int, right: int) -> int:
    """The longest common subsequence of two code lists with matches (i, j) in the band -left <= j - i <= right only."""
    at, reach = np.arange(len(a)), len(b) + 1
    order = np.argsort(b, kind="stable")
    places = b[order] * reach + order
    first = np.searchsorted(places, a * reach + np.maximum(at - left, 0))
    size = np.maximum(np.searchsorted(places, a * reach + np.minimum(at + right, len(b)), "right") - first, 0)
    width = left + right + 1
    if size.sum() * 16 <= len(a) * width:  # few matches: the longest rising sequence of their places in b
        ends: list[int] = []
        last = (first + size - 1).tolist()
        for stop, n in zip(last, size.tolist(), strict=True):
            for j in order[stop - n + 1 : stop + 1][::-1].tolist():
                k = bisect_left(ends, j)
                ends[k : k + 1] = [j]
        return len(ends)
    padded = np.concatenate([np.full(left, -1), b, np.full(right + len(a), -1)])
    row, up = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for i in range(len(a)):
        up[:-1] = row[1:]
        up[-1] = row[-1]
        np.maximum(up, row + (padded[i : i + width] == a[i]), out=up)
        np.maximum.accumulate(up, out=row)
    return int(row[len(b) - len(a) + left])


def _sketch(batches: Iterator[pa.RecordBatch], n: int, bands: int, sample: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in row_slices(batch["text"]):
            hashes, at = shingle_hashes(*word_hashes(pc.utf8_lower(batch["text"].slice(a, b - a))), n)
            count = np.diff(at)
            keys = order_sketches(hashes, at, bands, sample)
            offsets = np.concatenate([[0], np.cumsum(np.where(count > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["content"].slice(a, b - a), pa.array(count, pa.int64()), lists], ["doc_id", "content", "n", "keys"])


def _hash_lists(column: pa.Array, n: int) -> list[np.ndarray]:
    hashes, at = shingle_hashes(*word_hashes(pc.utf8_lower(column)), n)
    return [hashes[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _check(batches: Iterator[pa.RecordBatch], threshold: float, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in row_slices(batch["text_a"]):
            part = batch.slice(i, j - i)
            left, right = _hash_lists(part["text_a"], n), _hash_lists(part["text_b"], n)
            passed = [aligned(x, y, threshold) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([part["a"], part["b"], pa.array(passed)], ["a", "b", "linked"])


def content_of(column: str = "text") -> Column:
    return F.unhex(F.sha2(text_of(column), 256))


def joining_links(lists: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links (i, j) between the shingle lists whose components are those of all links between them.

    Components are grown from a text outwards; a text is compared with those that no component has yet.
    """
    count = np.array([len(x) for x in lists])
    at, owner = np.concatenate([[0], np.cumsum(count)]), np.repeat(np.arange(len(lists)), count)
    codes = np.unique(occurrence_labels(np.concatenate(lists), owner), return_inverse=True)[1]
    free, found = np.ones(len(lists), bool), []

    def index() -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(free[owner])
        own = own[np.argsort(codes[own], kind="stable")]
        return owner[own], np.concatenate([[0], np.cumsum(np.bincount(codes[own], minlength=codes.max() + 1))])

    postings, ends = index()
    indexed = len(lists)
    central = np.add.reduceat(np.diff(ends)[codes], at[:-1])
    for root in np.argsort(-central, kind="stable"):
        if not free[root]:
            continue
        free[root], queue = False, [root]
        while queue and (left := int(free.sum())):
            if left * 2 <= indexed:
                (postings, ends), indexed = index(), left
            x = queue.pop()
            c = codes[at[x] : at[x + 1]]
            size = ends[c + 1] - ends[c]
            places = np.repeat(ends[c] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            shared = np.bincount(postings[places], minlength=len(lists))
            need = np.ceil((count + count[x]) * threshold / (1 + threshold) - 1e-9)
            near = np.flatnonzero(free & (shared >= need))
            for y in near[np.argsort(-shared[near], kind="stable")]:
                if aligned(lists[x], lists[y], threshold):
                    found.append((x, y))
                    free[y] = False
                    queue.append(y)
    return found


def _join_cell(cell: pa.Table, threshold: float) -> pa.Table:
    ids = cell["id"].to_numpy()
    found = joining_links([np.frombuffer(x.as_buffer(), U) for x in cell["hashes"]], threshold)
    a, b = (ids[[x[k] for x in found]] if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def hub_matches(minors: list[np.ndarray], mains: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """For each of `minors` that is similar to any of `mains` one such link (i, j)."""
    lists = minors + mains
    count = np.array([len(x) for x in lists])
    at, owner = np.concatenate([[0], np.cumsum(count)]), np.repeat(np.arange(len(lists)), count)
    codes = np.unique(occurrence_labels(np.concatenate(lists), owner), return_inverse=True)[1]
    own = np.flatnonzero(owner >= len(minors))
    own = own[np.argsort(codes[own], kind="stable")]
    postings, ends = owner[own] - len(minors), np.concatenate([[0], np.cumsum(np.bincount(codes[own], minlength=codes.max() + 1))])
    found = []
    for x in range(len(minors)):
        c = codes[at[x] : at[x + 1]]
        size = ends[c + 1] - ends[c]
        places = np.repeat(ends[c] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        shared = np.bincount(postings[places], minlength=len(mains))
        need = np.ceil((count[len(minors) :] + count[x]) * threshold / (1 + threshold) - 1e-9)
        near = np.flatnonzero(shared >= need)
        for y in near[np.argsort(-shared[near], kind="stable")]:
            if aligned(minors[x], mains[y], threshold):
                found.append((x, int(y)))
                break
    return found


def _join_hub(cell: pa.Table, threshold: float) -> pa.Table:
    minor = cell["minor"].to_numpy(zero_copy_only=False)
    sides = [(own["id"].to_numpy(), [np.frombuffer(x.as_buffer(), U) for x in own["hashes"]]) for own in (cell.filter(pa.array(minor)), cell.filter(pa.array(~minor)))]
    (left, minors), (right, mains) = sides
    found = hub_matches(minors, mains, threshold) if minors and mains else []
    a, b = left[[x for x, _ in found]], right[[y for _, y in found]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _pack(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in row_slices(batch["text"]):
            part = batch.slice(i, j - i)
            packed = [x.tobytes() for x in _hash_lists(part["text"], n)]
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(packed, pa.binary())], ["id", "hashes"])


def aligned_pairs(pairs: DataFrame, bodies: DataFrame, threshold: float, n: int) -> DataFrame:
    """The similar ones of distinct pairs (a, b)."""
    right = pairs.join(bodies.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(bodies.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    checked = both.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _check(it, threshold, n), "a long, b long, linked boolean")
    return checked.where("linked").select("a", "b")


def star_pairs(buckets: DataFrame, threshold: float) -> DataFrame:
    """At most one pair (a, b) for each text: with the representative, among those of its buckets, that has the most company."""
    central = buckets.groupBy("id").agg(F.sum("texts").alias("central"))
    rank = F.struct("central", "tie")
    ranked = buckets.join(central, "id").select("key", "id", "n", rank.alias("rank"))
    best = ranked.groupBy("key").agg(F.max(F.struct("rank", F.col("id").alias("rep"), F.col("n").alias("nb"))).alias("best"))
    chosen = ranked.join(best, "key").groupBy("id").agg(F.max("best").alias("best"), F.first("n").alias("n"))
    near = F.least("n", "best.nb") >= threshold * F.greatest("n", "best.nb")
    return chosen.where((F.col("id") != F.col("best.rep")) & near).select(F.least("id", "best.rep").alias("a"), F.greatest("id", "best.rep").alias("b")).distinct()


def bucket_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of different components in buckets (key, id, n, part) of a bounded number of members, of near enough sizes."""
    other = members.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("part").alias("other"))
    near = F.least("n", "nb") >= threshold * F.greatest("n", "nb")
    return members.join(other, "key").where((F.col("id") < F.col("b")) & (F.col("part") != F.col("other")) & near).select(F.col("id").alias("a"), "b").distinct()


def hub_links(minors: DataFrame, parts: DataFrame, bodies: DataFrame, threshold: float, n: int) -> DataFrame:
    """Links (a, b) of texts (hub, id, n) with texts of the component `hub` among parts (part, id, n), in cells of bounded size."""
    minors = minors.distinct()
    wide = minors.groupBy("hub").agg(F.count("*").alias("m"), F.max("n").alias("most"))
    mains = parts.join(wide.select(F.col("hub").alias("part")), "part").select(F.col("part").alias("hub"), "id")
    sizes = wide.join(mains.groupBy("hub").agg(F.count("*").alias("g")), "hub")
    texts = F.greatest(F.lit(8.0), F.least(F.lit(float(CELL_TEXTS)), CELL_SHINGLES / F.col("most")))
    blocks = sizes.select("hub", F.ceil(F.col("m") / texts).cast("int").alias("mb"), F.ceil(F.col("g") / texts).cast("int").alias("gb"))

    def block(of: str):
        return F.pmod(F.xxhash64("id"), F.col(of)).cast("int")

    def each(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    left = minors.join(blocks, "hub").select("hub", "id", F.lit(True).alias("minor"), block("mb").alias("i"), each("gb").alias("j"))
    right = mains.join(blocks, "hub").select("hub", "id", F.lit(False).alias("minor"), each("mb").alias("i"), block("gb").alias("j"))
    cells = stash(left.union(right), "hubcells")
    packed = bodies.join(cells.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(lambda it: _pack(it, n), "id long, hashes binary")
    return cells.join(packed, "id").groupBy("hub", "i", "j").applyInArrow(lambda cell: _join_hub(cell, threshold), "a long, b long").distinct()


def cell_links(members: DataFrame, bodies: DataFrame, threshold: float, n: int) -> DataFrame:
    """Links (a, b) that join what is similar in buckets (key, id, n) of any size, worked off in cells of bounded size."""
    step = max(log(1 / threshold), 0.01)
    size_class = F.floor(F.log("n") / step + 1e-9).cast("int")
    # a class meets itself and the one above; where no member is of the upper class, the lower has met already
    whole = (F.col("texts") <= CELL_TEXTS) & (F.col("texts") * F.col("most") <= CELL_SHINGLES)  # one cell without classes
    counted = members.join(members.groupBy("key").agg(F.count("*").alias("texts"), F.max("n").alias("most")).where("texts > 1"), "key")
    classed = counted.select("key", "id", F.when(whole, -1).otherwise(size_class).alias("c"))
    placed = classed.select("key", "id", F.explode(F.when(F.col("c") < 0, F.array("c")).otherwise(F.array("c", F.col("c") + 1))).alias("g"), "c")
    sizes = placed.groupBy("key", "g").agg(F.count("*").alias("texts"), F.max(F.col("c") == F.col("g")).alias("own")).where("own and texts > 1")
    block_texts = F.greatest(F.lit(8.0), F.least(F.lit(float(CELL_TEXTS)), CELL_SHINGLES / F.exp((F.col("g") + 1) * step)))
    blocks = sizes.select("key", "g", F.when(F.col("g") < 0, 1).otherwise(F.ceil(F.col("texts") / block_texts)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (F.col("blocks") == 1) | (j != F.col("block")))
    pairs = F.transform(others, lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    cells = stash(placed.join(blocks, ["key", "g"]).withColumn("block", block).select("id", "key", "g", F.explode(pairs).alias("pair")), "cells")
    packed = bodies.select("id", "text").join(cells.select("id").distinct(), "id", "left_semi").mapInArrow(lambda it: _pack(it, n), "id long, hashes binary")
    return cells.join(packed, "id").groupBy("key", "g", "pair").applyInArrow(lambda cell: _join_cell(cell, threshold), "a long, b long").distinct()


def classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, bands: int = BANDS, sample: int = SAMPLE) -> DataFrame:
    """(content, least_id, class_key, class_id) of each distinct text with words: the class by a key of this run and by its least document id."""
    named = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), content_of().alias("content"))
    sketched = named.mapInArrow(lambda it: _sketch(it, n, bands, sample), "doc_id long, content binary, n long, keys array<long>").where("n > 0")
    distinct = sketched.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("keys").alias("keys"))
    texts = stash(distinct.withColumn("id", F.monotonically_increasing_id()), "sketches")
    members = texts.select("id", "n", F.xxhash64("content").alias("tie"), F.explode("keys").alias("key"))
    shared = stash(members.join(members.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1"), "key"), "buckets")
    wanted = texts.select("id", "content").join(shared.select("id").distinct(), "id")
    bodies = stash(named.select("content", "text").join(wanted, "content").groupBy("id").agg(F.min("text").alias("text")), "bodies")
    star = stash(aligned_pairs(star_pairs(shared, threshold), bodies, threshold, n), "star")
    roots = components(star)
    parts = stash(shared.groupBy("id").agg(F.first("n").alias("n")).join(roots, "id", "left").select("id", "n", F.coalesce("root", "id").alias("part")), "parts")
    placed = shared.join(parts.select("id", "part"), "id")
    mains = placed.groupBy("key", "part").agg(F.count("*").alias("own"), F.min("tie").alias("tie")).groupBy("key").agg(F.count("*").alias("several"), F.max(F.struct("own", "tie", "part")).alias("main"))
    mixed = stash(placed.join(mains.where("several > 1").select("key", F.col("main.part").alias("hub")), "key"), "mixed")
    # each kind of link is a query of its own: as one, its plan is made anew at each of some forty stages and fills the driver
    pairs = stash(bucket_pairs(mixed.where(F.col("texts") <= SMALL), threshold), "pairs")
    small = stash(aligned_pairs(pairs, bodies, threshold, n), "smalllinks")
    minors = mixed.where((F.col("texts") > SMALL) & (F.col("part") != F.col("hub")))
    large = stash(cell_links(minors.select("key", "id", "n"), bodies, threshold, n), "celllinks").union(stash(hub_links(minors.select("hub", "id", "n"), parts, bodies, threshold, n), "hublinks"))
    of = lambda end: parts.select(F.col("id").alias(end), F.col("part").alias(f"part_{end}"))
    between = small.union(large).join(of("a"), "a").join(of("b"), "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).where("a <> b")
    links = stash(between.distinct(), "links")  # of whole components, whose own links are known
    placed = parts.select("id", "part")
    if not links.isEmpty():
        placed = placed.join(components(links).select(F.col("id").alias("part"), "root"), "part", "left").select("id", F.coalesce("root", "part").alias("part"))
    grouped = texts.join(placed, "id", "left").select("content", "doc_id", F.coalesce("part", "id").alias("class_key"))
    grouped = stash(grouped, "classes")
    names = grouped.groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    return grouped.select("content", F.col("doc_id").alias("least_id"), "class_key").join(names, "class_key").select("content", "least_id", "class_key", "class_id")


def label(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id) of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), content_of().alias("content"))
    found = classes(docs, **options)
    return rows.join(found, "content", "left").select("doc_id", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, one for each class: that of the least id, then the least content; texts without words all stay."""
    wordy = text_of().rlike("[0-9A-Za-z]|[^\\x00-\\x7F]")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    # whole rows move once, by content and after equal texts were merged; the choice within a class moves ids and digests
    best = docs.where(wordy).select(row.alias("row"), rank.alias("rank"), content_of().alias("class_content")).groupBy("class_content").agg(F.min_by("row", "rank").alias("row"))
    first = F.struct(F.col("least_id").isNull(), "least_id", "content")
    chosen = classes(docs, **options).groupBy("class_key").agg(F.min_by("content", first).alias("class_content"))
    return best.join(chosen.select("class_content"), "class_content", "left_semi").select("row.*").unionByName(docs.where(~wordy))
