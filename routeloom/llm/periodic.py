"""Periodic runs of words: block convolution, then extension of the seeds.

A run is a stretch of words with smallest period q (words q apart are identical), at least `max(12, 2 * q)` words long, that no
neighbouring word extends keeping that period.

Scale k has blocks of 4 * 2**k words, one every 3 * 2**k words, and looks for periods from 7 * 2**k - 1 (scale 0: 1) up to
7 * 2**(k + 1) - 2.  A run of such a period has that many words (scale 0: at least six) that recur one period later, so it
holds a whole block that recurs at that distance.  A block's distance to every place of the window of these distances is the
sum of squared differences of word numbers, computed for all places at once by a number-theoretic transform: the sum is
smaller than the product of the primes used, so it is zero exactly where it is zero modulo each of them.  Blocks whose rarest word
does not recur in reach are left out first, and blocks deep inside a run of a period no longer than a block, which can
only show its multiples.

A zero gives a seed (place, distance).  Seeds of one distance in neighbouring blocks are one; the stretch around it is
found by bisection on prefix sums of powers and then compared word by word.  The same stretch at a multiple of its period is dropped.

Documents are worked on by the slice, a number of its own between any two, so tasks hold a slice at a time; one long text stands alone.
Texts never leave their task, so a hot key can't arise.

Defined results: a null or empty text, or one without a run, has no runs and keeps all words; repeated rows and a null id are kept;
of equally long runs the one with the smallest start, then period, is the longest.  Only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .shingles import mix, powers, row_slices

WORD = re.compile("[^\x20\x09-\x0d]+")
LEAST = 12
SLICE = 1 << 18
CELLS = 1 << 18
#: Primes c * 2**e + 1 below 2**31 with a primitive root each, by falling e.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3), (754974721, 11), (998244353, 3))
U = np.uint64


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    return x - x // U(p) * U(p)


def _roots(order: int, root: int, p: int) -> np.ndarray:
    """The first order / 2 powers of an element of that order."""
    out = np.ones(1, U)
    step = pow(root, (p - 1) // order, p)
    while len(out) < order // 2:
        out = np.concatenate([out, _mod(out * U(pow(step, len(out), p)), p)])
    return out


def _sum(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    t = a + b
    return np.minimum(t, t - U(p))  # below p the difference wraps round


def forward(x: np.ndarray, root: int, p: int) -> np.ndarray:
    """Transforms of the columns, in bit-reversed order."""
    n, width = x.shape
    half = n // 2
    while half:
        x = x.reshape(-1, 2, half, width)
        a, b = x[:, 0], x[:, 1]
        turn = _roots(2 * half, root, p)[:, None]
        x = np.stack([_sum(a, b, p), _mod(_sum(a, U(p) - b, p) * turn, p)], 1)
        half //= 2
    return x.reshape(n, width)


def backward(x: np.ndarray, root: int, p: int) -> np.ndarray:
    """The inverse of `forward`."""
    n, width = x.shape
    half = 1
    while half < n:
        x = x.reshape(-1, 2, half, width)
        a = x[:, 0]
        b = _mod(x[:, 1] * _roots(2 * half, pow(root, -1, p), p)[:, None], p)
        x = np.stack([_sum(a, b, p), _sum(a, U(p) - b, p)], 1)
        half *= 2
    return _mod(x.reshape(n, width) * U(pow(n, -1, p)), p)


def _residues(ids: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers modulo p and the running sums of their squares."""
    ids = _mod(ids, p)
    return ids, np.concatenate([np.zeros(1, U), np.cumsum(_mod(ids * ids, p), dtype=U)])


def _matches(ids: np.ndarray, squares: np.ndarray, starts: np.ndarray, length: int, near: int, far: int, prime: tuple[int, int]) -> np.ndarray:
    """For each block (column) and distance from `near` to `far` (row) whether the sum of squared differences is zero modulo the prime."""
    p, root = prime
    reach = far - near + length
    size = 1 << (reach - 1).bit_length()
    block = np.zeros((size, len(starts)), U)
    block[length - 1 :: -1] = ids[starts[None, :] + np.arange(length)[:, None]]
    window = np.zeros((size, len(starts)), U)
    window[:reach] = ids[starts[None, :] + (near + np.arange(reach))[:, None]]
    product = backward(_mod(forward(block, root, p) * forward(window, root, p), p), root, p)[length - 1 : reach]
    at = starts[None, :] + (near + np.arange(far - near + 1))[:, None]
    both = _mod(squares[at + length] - squares[at] + (squares[starts + length] - squares[starts])[None, :], p)  # of sums below n * p
    return both == _mod(product * U(2), p)


def occurrences(ids: np.ndarray, starts: np.ndarray, length: int, near: int, far: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of every block's exact recurrences from `near` to `far` words on; `ids` are below `bound` and reach that far."""
    size = 1 << (far - near + length - 1).bit_length()
    usable = [x for x in PRIMES if (x[0] - 1) % size == 0]
    needed, room = 0, 1
    while room <= bound * bound * length:
        room *= usable[needed][0]
        needed += 1
    primes = [(*_residues(ids, x[0]), x) for x in usable[:needed]]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    width = max(1, CELLS // size)
    for k in range(0, len(starts), width):
        some = starts[k : k + width]
        zero = np.ones((far - near + 1, len(some)), bool)
        for numbers, squares, prime in primes:
            some, zero = some[zero.any(0)], zero[:, zero.any(0)]
            if len(some):
                zero &= _matches(numbers, squares, some, length, near, far, prime)
        d, b = np.nonzero(zero)
        found.append((some[b], d + near))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _stretch(ids: np.ndarray, b: int, d: int, n: int) -> tuple[int, int]:
    """First and last word (exclusive) of the stretch of period d around a place where words d apart agree."""
    apart = np.flatnonzero(ids[: n - d] != ids[d:n])
    k = int(np.searchsorted(apart, b))
    return int(apart[k - 1]) + 1 if k else 0, (int(apart[k]) if k < len(apart) else n - d) + d


class _Prefixes:
    """Equality of stretches by prefix sums of powers, modulo 2**64."""

    def __init__(self, ids: np.ndarray, n: int) -> None:
        self.n, self.up = n, powers(n + 1)[0]
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(ids[:n]) * self.up[:n], dtype=U)])

    def same(self, a: np.ndarray, d: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (self.sums[a + m] - self.sums[a]) * self.up[d] == self.sums[a + d + m] - self.sums[a + d]

    def ends(self, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of the stretches of period d around b."""
        right, left = np.zeros_like(b), np.zeros_like(b)
        step = 1 << max(self.n - 1, 1).bit_length()
        while step:
            m = right + step
            ok = b + d + m <= self.n
            ok[ok] = self.same(b[ok], d[ok], m[ok])
            right = np.where(ok, m, right)
            m = left + step
            ok = m <= b
            ok[ok] = self.same(b[ok] - m[ok], d[ok], m[ok])
            left = np.where(ok, m, left)
            step //= 2
        return b - left, b + d + right


def runs_of(ids: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of word numbers from 1, none of which is longer than `longest`; by start, then period."""
    n, bound = len(ids), int(ids.max(initial=0)) + 2
    least = LEAST // 2
    order = np.argsort(ids, kind="stable")
    keys = ids[order].astype(np.int64) * (n + 1) + order
    often = np.bincount(ids.astype(np.int64), minlength=bound)
    known: dict[tuple[int, int], int] = {}
    prefixes = None
    scale = 0
    while (near := 1 if scale == 0 else 7 * 2**scale - 1) <= longest // 2:
        length, every, far = 4 << scale, 3 << scale, 7 * 2 ** (scale + 1) - 2
        starts = np.arange(0, max(n - length + 1, 0), every)
        scale += 1
        if known:  # blocks that with their window lie in one run of a short period
            inner = np.array(sorted((s, e) for (s, e), q in known.items() if q <= length), np.int64).reshape(-1, 2)
            if len(inner):
                k = np.searchsorted(inner[:, 0], starts, side="right") - 1
                starts = starts[(k < 0) | (np.maximum.accumulate(inner[:, 1])[k] < starts + far + length)]
        rare = []
        for k in range(0, len(starts), max(1, CELLS // length)):
            some = starts[k : k + max(1, CELLS // length)]
            rare.append(some + often[ids[some[:, None] + np.arange(length)].astype(np.int64)].argmin(1))
        rare = np.concatenate(rare) if rare else starts
        base = ids[rare].astype(np.int64) * (n + 1) + rare
        follows = np.searchsorted(keys, base + near)
        starts = starts[(follows < n) & (keys[np.minimum(follows, n - 1)] <= base + far)] if n else starts
        if not len(starts):
            continue
        padded = np.concatenate([ids, np.full(far + length, bound - 1, U)])
        b, d = occurrences(padded, starts, length, near, far, bound)
        if not len(b):
            continue
        by = np.lexsort((b, d))
        b, d = b[by], d[by]
        first = np.ones(len(b), bool)
        first[1:] = (d[1:] != d[:-1]) | (b[1:] != b[:-1] + every)
        b, d = b[first], d[first]
        prefixes = prefixes or _Prefixes(ids, n)
        s, e = prefixes.ends(b, d)
        for k in np.flatnonzero(e - s >= np.maximum(2 * least, 2 * d)):  # by rising distance
            place, q = (int(s[k]), int(e[k])), int(d[k])
            if place in known:
                continue
            if not np.array_equal(ids[place[0] : place[1] - q], ids[place[0] + q : place[1]]):  # the sums agreed by chance
                place = _stretch(ids, int(b[k]), q, n)
                if place in known or place[1] - place[0] < max(LEAST, 2 * q):
                    continue
            known[place] = q
    return np.array(sorted((s, e - s, q) for (s, e), q in known.items()), np.int64).reshape(-1, 3)


def texts_runs(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """The words and the runs of each text."""
    lists = [WORD.findall(t) for t in texts]
    numbers = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(lists)), 1)}
    parts, upper = [], len(numbers)
    for x in lists:
        upper += 1
        parts += [np.fromiter(map(numbers.__getitem__, x), U, len(x)), np.array([upper], U)]
    found = runs_of(np.concatenate(parts), max(map(len, lists)))
    ends = np.cumsum([len(x) + 1 for x in lists])
    cut = np.searchsorted(found[:, 0], np.concatenate([[0], ends]))
    for k, x in enumerate(lists):
        own = found[cut[k] : cut[k + 1]]
        yield x, own - [ends[k] - len(x) - 1, 0, 0]


def kept_words(words: list[str], runs: np.ndarray) -> list[str]:
    """The words that no run has after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in row_slices(batch["text"], SLICE):
            counts, runs, left = [], [], []
            for words, found in texts_runs(batch["text"].slice(a, b - a).to_pylist()):
                counts.append(len(words))
                runs.append(found)
                left.append(" ".join(kept_words(words, found)))
            flat = np.concatenate(runs)
            ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(ends), rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(counts, pa.int64()), lists, pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs by start, then period, and the text without the words that a run repeats."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_find, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in the texts whose id's checksum ends in 0, the words from a place on repeat a stretch of them, both set by the checksum.

    A null id leaves the text as it is.
    """
    words = F.regexp_extract_all(text_of(), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", text_of().alias("text"), F.crc32(F.col("doc_id").cast("string")).alias("_h"))
    rows = rows.withColumn("_words", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_words")).withColumn("_g", F.floor(F.col("_h") / 10))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    tail = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_words", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def summary(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of `find_runs`."""
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    length = -F.col("_first.least")
    return found.withColumn("_first", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_first.start").alias("start"), length.alias("length"), F.col("_first.period").alias("period"),
        F.floor(1000 * length / F.col("_first.period")).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
