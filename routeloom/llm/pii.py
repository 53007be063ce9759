"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of three families (addresses with an at sign or a word for it, dotted numbers and
colon groups, digit groups).  Boosted regression trees score each candidate on its format and its surroundings, and a span is
added where the score reaches the family's threshold, which is calibrated on held-out candidates.  The strict
kinds of BASE are exact rules; their spans always stand.  A value that fails the ranges or the checksum of its kind is never added, and equal ranges count once.

Training.  Labels are weak: a candidate counts as personal where a strict rule holds for it or within it, and the features leave
out what those rules check beyond the shape (checksums and ranges).  Candidates of a shape that the strict rules cannot judge
(a written-out at sign, grouped digits without a plus) are left out; for these, strict spans are rewritten in their own
surroundings, as the same address or number in such a shape (personal) and as look-alikes (not personal).  All texts are trained on, whole
(copies count once): two thirds of them, by digest, give the trees and the rest the thresholds.  Equal examples are one row with
its count; each level of a tree is a sum of gradients by feature and value over these rows, which Spark adds up, in whole
numbers, so reruns agree.  Only these sums come to the driver, and their size is fixed.

Defined results: a null text is empty and has no spans; equal texts get equal spans; without training candidates only the
strict kinds are found; a null id is kept; an empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_of
from .shingles import row_slices

KINDS = ("email", "ip", "card", "phone")
FAMILIES = ("at", "dotted", "digits")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PROPOSE = (  # no proposal is cut at a length; a run of signs is tried from its start only, so long runs cost their length
    re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)*+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++"),
    re.compile(r"(?<![0-9.])[0-9]++(?:[.:][0-9]++){2,}+|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::|[0-9A-Fa-f]{1,4})(?::?[0-9A-Fa-f]{1,4})*+(?![0-9A-Za-z:])"),
    re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"),
)
_SCREEN = re.compile(r"@|at[)\]]|\x20dot\x20|[0-9]")
CUES = ("mail", "contact", "call", "phone", "tel", "card", "account", "server", "host", "id", "no", "version")


def luhn(digits: str) -> bool:
    doubled = [d * 2 - 9 * (d > 4) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))]
    return sum(doubled) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost pattern local-part @ domain, found from the at sign, so long runs cost no more than their length."""
    free = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict kinds, leftmost and non-overlapping within a kind, in order of start and kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, family, end) of every proposal; proposals overlap freely across families."""
    return [(m.start(), k, m.end()) for k, p in enumerate(_PROPOSE) if k or "@" in text or "at" in text for m in p.finditer(text)]


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    start, family, end = span
    body = text[start:end]
    digits = digits_of(body)
    near = text[max(0, start - 24) : start].lower() + " " + text[end : end + 12].lower()
    groups = re.findall(r"[0-9]+", body)
    last = re.split(r"[.\]) ]", body)[-1]
    before, after = text[start - 1 : start], text[end : end + 1]
    return [
        family, len(body), len(digits), len(groups), max(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        body.count("."), body.count("-"), body.count(" "), body.count("("), float(body[:1] == "+"), float("@" in body), len(last), float(last.isalpha()),
        float(before.isalnum()), float(after.isalnum()), float(before in ("", " ", "\n")), float(after in ("", " ", "\n", ".", ",")),
        sum(c in near for c in CUES), sum(c.isdigit() for c in near), float(":" in body),
        len(_DOT.findall(body, m.end())) if not family and (m := _AT.search(body)) else -1,
        body.count(":"), float("::" in body), sum(c in "abcdefABCDEF" for c in body) if family == 1 else 0, float(body[:1] == "0"), float(body[:2] == "00"), min(map(len, groups), default=0),
    ]


LEVELS = 256  # values of a feature from 254 on are one
SCALE = 1 << 20
GRADES = 10_000  # of a score


def cells_of(rows: list[list[float]]) -> np.ndarray:
    """Features, whole numbers from -1 on, as one byte each."""
    return np.clip(np.array(rows, float) + 1, 0, LEVELS - 1).astype(np.uint8)


class Boosting:
    """Gradient-boosted trees of depth two for a logistic loss; splits are the best between any two values."""

    def __init__(self, rounds: int = 40, rate: float = 0.5) -> None:
        self.rounds, self.rate = rounds, rate
        self.bias, self.trees = 0.0, []

    @staticmethod
    def _split(sums: np.ndarray) -> tuple[int, int]:
        """The feature and the last value on the left; -1 if no split gains."""
        left, whole = np.cumsum(sums, axis=1)[:, :-1], sums[0].sum(axis=0)
        g, h = left[..., 0], left[..., 1]
        gain = g**2 / (h + 1) + (whole[0] - g) ** 2 / (whole[1] - h + 1) - whole[0] ** 2 / (whole[1] + 1)
        j, cell = divmod(int(gain.argmax()), LEVELS - 1)
        return (j, cell - 1) if gain[j, cell] > 1e-9 else (-1, 0)

    def fit(self, sums: Callable[[Boosting, tuple[int, int] | None], np.ndarray], rate: float) -> Boosting:
        """`sums` gives gradient_sums of all rows; `rate` of them are personal."""
        p = np.clip(rate, 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        for _ in range(self.rounds):
            root = self._split(sums(self, None)[0])
            if root[0] < 0:
                break
            sides = []
            for own in sums(self, root):
                k, inner = self._split(own)
                whole = own[0].sum(axis=0)
                low = own[k, : inner + 2].sum(axis=0) if k >= 0 else whole
                leaf = lambda x: float(self.rate * x[0] / (x[1] + 1))
                sides.append((k, float(inner), leaf(low), leaf(whole - low)))
            self.trees.append((root[0], float(root[1]), sides))
        return self

    def decision(self, x: np.ndarray, trees=None, start=None) -> np.ndarray:
        f = np.full(len(x), self.bias) if start is None else start
        for j, cut, sides in self.trees if trees is None else trees:
            left = x[:, j] <= cut
            for side, (k, inner, low, high) in zip((left, ~left), sides, strict=True):
                f = f + side * (np.where(x[:, k] <= inner, low, high) if k >= 0 else low)
        return f

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.decision(x)))


def gradient_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, model: Boosting, root: tuple[int, int] | None) -> np.ndarray:
    """First and second derivatives times SCALE, in whole numbers, by side of `root` (one without it), feature and cell."""
    p = model.probability(x.astype(float) - 1)
    side = np.zeros(len(x), np.int64) if root is None else (x[:, root[0]] > root[1] + 1).astype(np.int64)
    out = np.zeros((1 if root is None else 2, x.shape[1], LEVELS, 2))
    for k, v in enumerate((y - p, p * (1 - p))):
        v = np.rint(v * SCALE) * weight
        for j in range(x.shape[1]):
            out[:, j, :, k] = np.bincount(side * LEVELS + x[:, j], v, len(out) * LEVELS).reshape(-1, LEVELS)
    return out


_AT = re.compile(r"\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20")
_DOT = re.compile(r"\.|\(dot\)|\[dot\]|\x20dot\x20")
_GROUPED = re.compile(r"\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9][0-9\x20().-]*")


def ambiguous(text: str, span: tuple[int, int, int]) -> bool:
    """A shape that no strict rule judges: a written-out or spaced at sign before a dotted name, or grouped digits as of a phone."""
    start, family, end = span
    body = text[start:end]
    if family == 0:
        return bool(_DOT.search(body[_AT.search(body).end() :]))
    if family == 1:
        return body.count(":") > 1 and ("::" in body or any(c in "abcdefABCDEF" for c in body) or body.count(":") > 3)
    apart = not text[start - 1 : start].isalnum() and not text[end : end + 1].isalnum()
    return family == 2 and apart and 7 <= len(digits_of(body)) <= 15 and _GROUPED.fullmatch(body) is not None


def _labelled(good: tuple[str, ...], poor: tuple[str, ...], family: int) -> list[tuple[str, int, float]]:
    return [(x, family, 1.0) for x in good] + [(x, family, 0.0) for x in poor]


def rewritten(body: str, kind: int, turn: int) -> list[tuple[str, int, float]]:
    """(text, family, label): a strict span in shapes that the strict rules miss, and look-alikes; `turn` picks the part of a domain that look-alikes have."""
    if kind == 0:
        local, domain = body.rsplit("@", 1)
        parts = domain.split(".")
        good = (f"{local} (at) {' (dot) '.join(parts)}", f"{local} [at] {' [dot] '.join(parts)}", f"{local} @ {domain}", f"{local}(at){domain}", f"{local} (at) {domain}", f"{local}[at]{'[dot]'.join(parts)}", f"{local} at {' dot '.join(parts)}")
        short = ".".join(parts[-2:])  # a domain of two labels, as of a host of its own
        good += (f"{local} [at] {short}", f"{local} @ {short}", f"{local} (at) {' (dot) '.join(parts[-2:])}")
        name = parts[turn % len(parts)]  # any part of the domain, so that only the missing dot tells
        poor = (f"{local} (at) {name}", f"{local} [at] {name}", f"{local} @ {name}", f"{local}@{name}")
        return _labelled(good, poor, 0)
    if kind == 1:
        parts = body.split(".")
        n = [int(p[-3:]) for p in parts]
        good = (f"2001:db8:{n[0]:x}:{n[1]:x}::{n[2] * 256 + n[3]:x}", f"fe80::{n[0]:x}:{n[1]:x}:{n[2]:x}:{n[3]:x}", ":".join(f"{0x2001 + k * n[k % 4]:x}" for k in range(8)), f"2001:db8::{n[3]:x}")
        poor = (".".join(parts[:3]), ".".join([*parts, parts[0]]), ":".join(f"{k % 256:02x}" for k in (*n, n[0] ^ n[1], n[2] ^ n[3])), f"{n[0] % 24:02d}:{n[1] % 60:02d}:{n[2] % 60:02d}")
        return _labelled(good, poor, 1)
    if kind == 3:
        d = digits_of(body)[-10:].rjust(10, "2")
        a, b, c = d[:3], d[3:6], d[6:]
        year, month, day = 1900 + int(c) % 130, 1 + int(a) % 12, 1 + int(b) % 28
        good = (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}", f"0{d[:2]} {d[2:6]} {d[6:]}", f"0044 {d[:2]} {d[2:6]} {d[6:]}", f"0{d[0]} {d[1:3]} {d[3:5]} {d[5:7]} {d[7:9]}", f"0{d[:3]} {d[3:6]} {d[6:]}")
        poor = (f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{year}-{month:02d}-{day:02d} {day:02d}", f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", f"{a} {b} {c[:3]}", f"{c}-{year} {year + 1}", d, f"{year}-{year + 3}", f"{c} {a}{c[:1]} {c} {year}")
        return _labelled(good, poor, 2)
    return []


def weak_label(text: str, span: tuple[int, int, int], strict: list[tuple[int, int, int]]) -> float:
    return float(any(span[0] < e and s < span[2] for s, _, e in strict))


def examples(text: str, turn: int) -> list[tuple[list[float], float]]:
    """(features, label) of the candidates of a text and of its strict spans in other shapes."""
    found, strict = [], base_spans(text)
    for span in candidates(text):
        label = weak_label(text, span, strict)
        if label or not ambiguous(text, span):
            found.append((features(text, span), label))
    for start, kind, end in strict:
        before, after = text[max(0, start - 40) : start], text[end : end + 40]
        for body, family, label in rewritten(text[start:end], kind, turn):
            where, last = before + body + after, len(before) + len(body)
            found += [(features(where, span), label) for span in candidates(where) if span[1] == family and span[0] <= len(before) and span[2] >= last]
        turn += 1
    return found


def grades(x: np.ndarray, model: Boosting) -> np.ndarray:
    return np.floor(model.probability(x.astype(float) - 1) * GRADES).astype(np.int64)


def limit(grade: np.ndarray, n: np.ndarray, hits: np.ndarray, precision: float) -> float:
    """The least score, 0.5 at least, from which the candidates are personal to `precision`; over 1 if there is none."""
    order = np.argsort(-grade)
    fine = np.flatnonzero(np.cumsum(hits[order]) >= precision * np.cumsum(n[order]))
    return max(float(grade[order][fine[-1]]) / GRADES, 0.5) if len(fine) else 2.0


def _limits(family: np.ndarray, grade: np.ndarray, n: np.ndarray, hits: np.ndarray, precision: float) -> tuple[float, ...]:
    found = []
    for k in range(len(FAMILIES)):
        levels, where = np.unique(grade[family == k], return_inverse=True)  # equal scores pass or fail together
        found.append(limit(levels, np.bincount(where, n[family == k]), np.bincount(where, hits[family == k]), precision))
    return tuple(found)


def train(texts: list[str], precision: float = 0.95) -> tuple[Boosting, tuple[float, ...]] | None:
    """The trees, and for each family the least score whose held-out candidates are personal to `precision`, of texts at hand."""
    rows = [(row, label, k % 3 == 2) for k, text in enumerate(texts) for row, label in examples(text, k)]
    if len(rows) < 20:
        return None
    x, y, held = cells_of([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    if held.all() or len(set(y[~held])) < 2:
        return None
    model = Boosting().fit(lambda m, root: gradient_sums(x[~held], y[~held], np.ones((~held).sum()), m, root) / SCALE, y[~held].mean())
    return model, _limits(x[held, 0].astype(int) - 1, grades(x[held], model), np.ones(held.sum()), y[held], precision)


def possible(body: str, family: int) -> bool:
    """Whether a value passes the ranges and checksums of its kind: what fails them is never added."""
    if family == 1 and ":" in body:
        try:
            return bool(ipaddress.IPv6Address(body))
        except ValueError:
            return False
    if family == 1:
        return body.count(".") != 3 or all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in body.split("."))
    digits = digits_of(body)
    if family == 2 and body.count(".") == 3 and all(c.isdigit() or c == "." for c in body):
        return False  # four dotted numbers are an address or nothing
    if family == 2 and (body[:1] == "+" or (digits[:2] == "00" and " " in body)):
        return 9 <= len(digits) <= 15
    return family != 2 or not 12 <= len(digits) <= 19 or luhn(digits)


def added_spans(text: str, model: tuple[Boosting, tuple[float, ...]] | None, strict: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Accepted candidates that are not a strict span already, each range once, by the family that accepts it most clearly; their kinds follow those of KINDS."""
    known = {(s, e) for s, _, e in strict}
    found = [c for c in candidates(text) if (c[0], c[2]) not in known and possible(text[c[0] : c[2]], c[1])] if model else []
    if not found:
        return []
    score = model[0].probability(np.array([features(text, c) for c in found], float))
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for (s, k, e), p in zip(found, score, strict=True):
        if p >= model[1][k]:
            best[s, e] = max(best.get((s, e), (-1.0, 0)), (float(p - model[1][k]), -k))
    return [(s, len(KINDS) - k, e) for (s, e), (_, k) in sorted(best.items())]


SPANS = "doc_id long, text string, spans array<struct<start:int,kind:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _find(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for a, b in row_slices(batch["text"]):
            found = []
            for text in batch["text"].slice(a, b - a).to_pylist():
                strict = base_spans(text) if _SCREEN.search(text) else []
                spans = sorted(strict + added_spans(text, model, strict)) if strict or _SCREEN.search(text) else []
                found.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["text"].slice(a, b - a), pa.array(found, _SPAN)], ["doc_id", "text", "spans"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text with examples its digest, whether it is held out, and a byte string for each: the label and the features."""
    for batch in batches:
        for a, b in row_slices(batch["text"]):
            out: list[tuple] = []
            for text in batch["text"].slice(a, b - a).to_pylist():
                digest = hashlib.sha256(text.encode()).digest() if _SCREEN.search(text) else b""
                found = examples(text, digest[0]) if digest else []
                if found:
                    x = cells_of([row for row, _ in found])
                    out.append((digest, digest[1] % 3 == 2, [bytes([int(y)]) + r.tobytes() for r, (_, y) in zip(x, found, strict=True)]))
            kinds = [pa.binary(), pa.bool_(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], ["content", "held", "rows"])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(batch["row"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return raw[:, 1:], raw[:, 0].astype(float), batch["n"].to_numpy().astype(float)


def _sums(batches: Iterator[pa.RecordBatch], model: Boosting, root: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            own = gradient_sums(*_arrays(batch), model, root)
            total = own if total is None else total + own
    if total is not None:
        flat = total.reshape(-1, 2).astype(np.int64)
        cell = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[cell, 0]), pa.array(flat[cell, 1])], ["cell", "g", "h"])


def _graded(batches: Iterator[pa.RecordBatch], model: Boosting) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y, n = _arrays(batch)
            columns = (x[:, 0].astype(np.int64) - 1, grades(x, model), n.astype(np.int64), (y * n).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["family", "grade", "n", "hits"])


def fit(docs: DataFrame, precision: float = 0.95) -> tuple[Boosting, tuple[float, ...]] | None:
    """Train on all texts of `docs`: `train` with its sums added up by Spark."""
    found = docs.select(text_of().alias("text")).mapInArrow(_examples, "content binary, held boolean, rows array<binary>")
    once = found.groupBy("content").agg(F.min("held").alias("held"), F.min("rows").alias("rows")).select("held", F.explode("rows").alias("row"))
    rows = stash(once.groupBy("held", "row").agg(F.count("*").alias("n")), "examples")
    personal = F.col("n") * (F.substring("row", 1, 1) == F.lit(b"\x01")).cast("long")
    counts = {r.held: (r.n, r.y) for r in rows.groupBy("held").agg(F.sum("n").alias("n"), F.sum(personal).alias("y")).collect()}
    n, y = counts.get(False, (0, 0))
    if sum(x for x, _ in counts.values()) < 20 or not 0 < y < n:
        return None
    fitted, width = rows.where(~F.col("held")).select("row", "n"), len(features("1", (0, 2, 1)))

    def sums(model: Boosting, root: tuple[int, int] | None) -> np.ndarray:
        own = fitted.mapInArrow(lambda it: _sums(it, model, root), "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        out = np.zeros(((1 if root is None else 2) * width * LEVELS, 2))
        out[own["cell"].to_numpy()] = np.stack([own["g"].to_numpy(), own["h"].to_numpy()], axis=1)
        return out.reshape(-1, width, LEVELS, 2) / SCALE

    model = Boosting().fit(sums, y / n)
    held = rows.where("held").select("row", "n").mapInArrow(lambda it: _graded(it, model), "family long, grade long, n long, hits long")
    graded = held.groupBy("family", "grade").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow()
    return model, _limits(*(graded[c].to_numpy() for c in ("family", "grade", "n", "hits")), precision)


def find_pii(docs: DataFrame, model: tuple[Boosting, tuple[float, ...]] | None) -> DataFrame:
    """(doc_id, text, spans) of every row, spans in order of start and kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(lambda it: _find(it, shared), SPANS)
