"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's pattern is parsed once, on the driver, into a Boolean trigram query: a conjunction of
alternatives, each of which is the set of trigrams that cover a string that a match must hold (in lower case).
The index is a written table of postings (trigram, text digest), sorted by trigram, for the trigrams of all rules.  A rule reads
the posting lists of its trigrams and intersects them: the digests in all lists of a set, in any set of an alternative, in every
alternative.  Only these candidates run the rule's pattern.  A rule without a mandatory trigram runs on every text.

Spans count code points, end exclusive.  Matches of a rule are leftmost and non-overlapping; matches whose
measured group is shorter than the rule's `least` are dropped, without a retry.

Defined results: a null text is empty and has no spans; a null id is kept; equal texts give equal spans; an
empty table gives no rows.  Only the named columns are read.  Offsets are summed in chunks, so a long text with many
spans costs about its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, text_of

SEEN = 32
CHUNK = 512
PIECE = 4096


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the runs of [0-9a-f]+ that are long enough
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i)bearer\x20++[A-Za-z0-9._~+/-]{20,}"),
    Rule("url", r"://[^\x20\x09-\x0D/:@]++:[^\x20\x09-\x0D/@]++@"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{22,}"),
)
RULES = BASE + ADDED

Clauses = list[frozenset[str]]  # all of them; of each, any string


def _cross(left: set[str], right: set[str]) -> set[str]:
    return {a + b for a in left for b in right}


def _walk(items) -> tuple[set[str] | None, Clauses]:
    """The strings that the items match if they are few, and what any match must hold."""
    now, clauses, exact = {""}, [], True

    def cut() -> None:
        nonlocal now
        if now and min(map(len, now)) >= 3:
            clauses.append(frozenset(now))
        now = {""}

    for op, value in items:
        name, own, inner = str(op), None, []
        if name == "LITERAL":
            own = {chr(value).lower()}
        elif name == "IN":
            own = {chr(v).lower() for o, v in value if str(o) == "LITERAL"} if all(str(o) == "LITERAL" for o, _ in value) else None
        elif name == "SUBPATTERN":
            own, inner = _walk(value[-1])
        elif name == "BRANCH":
            each = [_walk(x) for x in value[1]]
            own = set().union(*(x for x, _ in each)) if all(x is not None for x, _ in each) else None
            if own is None and all(x is not None or c for x, c in each):
                inner = [frozenset().union(*(x if x is not None else max(c, key=lambda s: min(map(len, s))) for x, c in each))]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, sub = value
            few, inner = _walk(sub)
            inner = inner if low else []
            if few is not None and (low, int(high)) == (0, 1):
                own = few | {""}
            elif few is not None and low == high and low * max(map(len, few), default=0) <= 16:
                own = {""}
                for _ in range(low):
                    own = _cross(own, few)
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            own = {""}
        if own is not None and len(now) * len(own) <= SEEN:
            now = _cross(now, own)
        else:
            cut()
            exact = False
            clauses += [c for c in inner if min(map(len, c)) >= 3]
            if own is not None and len(own) <= SEEN:
                now = own
    if exact:
        return now, clauses
    cut()
    return None, clauses


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All of: any of: the trigrams that cover a string."""
    exact, clauses = _walk(regex_parser.parse(pattern))
    if exact is not None and min(map(len, exact), default=0) >= 3:
        clauses = [*clauses, frozenset(exact)]
    query = []
    for clause in clauses:
        sets = {frozenset(s[i : i + 3] for i in {*range(0, len(s) - 2, 3), len(s) - 3}) for s in clause}
        query.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))
    return query


def _digest() -> Column:
    return F.unhex(F.sha2(text_of(), 256))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index for these trigrams: each distinct (trigram, digest) once, in the order of the trigrams."""
    posted = docs.select(_digest().alias("digest"), F.lower(text_of()).alias("low")).select("digest", F.explode(_present("low", trigrams)).alias("trigram"))
    return stash(posted.distinct().sortWithinPartitions("trigram", "digest"), "postings")


def _present(low: str, trigrams: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(digest, rules): the rules whose query the posting lists satisfy.

    The queries are a table (rule, clause, choice, trigram), as large as the rules, that every task gets.
    """
    terms, needs = [], []
    for k, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        needs.append(len(query))
        terms += [(k, c, a, g, len(grams)) for c, clause in enumerate(query) for a, grams in enumerate(clause) for g in sorted(grams)]
    asked = index.sparkSession.createDataFrame(terms, "rule int, clause int, choice int, trigram string, need int")
    lists = index.join(F.broadcast(asked), "trigram")
    sets = lists.groupBy("digest", "rule", "clause", "choice").agg(F.count("*").alias("held"), F.first("need").alias("need")).where(F.col("held") == F.col("need"))
    clauses = F.element_at(F.array(*map(F.lit, needs)), F.col("rule") + 1)
    met = sets.groupBy("digest", "rule").agg(F.size(F.collect_set("clause")).alias("met")).where(F.col("met") == clauses)
    return met.groupBy("digest").agg(F.collect_set("rule").alias("rules"))


def _measured(rule: Rule, wanted: Column) -> Column:
    """Lengths of the matches of one rule in `text`: what stands before each, the match, and its measured group."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    measured = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    before = F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), 1, F.size(matches))
    none = F.array().cast("array<struct<before:int,match:int,measured:int>>")
    return F.when(wanted & text.rlike(rule.pattern), F.arrays_zip(before.alias("before"), matches.alias("match"), measured.alias("measured"))).otherwise(none)


def running(values: Column, step) -> Column:
    """Running results of `step` (sum or greatest, 0 first) over an int array, CHUNK values at a time."""

    def run(part: Column, keep_last: bool) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        each = lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(step(acc["at"], x) if keep_last else acc["at"])).alias("out"))
        return F.aggregate(part, start, each, lambda acc: acc["out"])

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: run(F.slice(values, c * CHUNK + 1, F.lit(CHUNK)), True))
    before = run(F.transform(chunks, lambda c: F.element_at(c, -1)), False)
    whole = F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(c, lambda x: step(b, x))))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<int>"))


def _added(a: Column, b: Column) -> Column:
    return a + b


def _spans(rules: tuple[Rule, ...]) -> Column:
    """All spans of a row from `found` and `ends`, which hold an array for each rule."""
    least = F.array(*[F.lit(r.least) for r in rules])

    def of(k: Column) -> Column:
        spans = F.zip_with(F.get("found", k), F.get("ends", k), lambda x, end: F.struct((end - x["match"]).alias("start"), k.alias("kind"), end.alias("end"), x["measured"].alias("measured")))
        return F.transform(F.filter(spans, lambda s: s["measured"] >= F.get(least, k)), lambda s: F.struct(s["start"], s["kind"], s["end"]))

    return F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(rules) - 1)), of)))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, `text` (null as empty) and `spans`: array of (start, kind, end), kind an index into `rules`."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({g for q in queries for clause in q for grams in clause for g in grams})
    kept = [f"keep_{c}" for c in keep]
    rows = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], text_of().alias("text"), _digest().alias("digest"))
    if trigrams:
        # texts too short for any trigram have no candidates: they are dealt out evenly instead of meeting at one digest
        spread = F.unhex(F.md5(F.concat_ws("|", F.rand(7).cast("string"))))
        rows = rows.withColumn("digest", F.when(F.length("text") < 3, spread).otherwise(F.col("digest")))
        rows = rows.join(candidates(postings(docs.select("text"), trigrams), rules), "digest", "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<int>"))
    wanted = [F.coalesce(F.array_contains("rules", k), F.lit(False)) if queries[k] else F.lit(True) for k in range(len(rules))]
    rows = rows.select(*kept, "text", F.array(*[_measured(rule, wanted[k]) for k, rule in enumerate(rules)]).alias("found"))
    rows = rows.select("*", F.transform("found", lambda own: F.transform(own, lambda x: x["before"] + x["match"])).alias("steps"))
    rows = rows.select(*kept, "text", "found", F.transform("steps", lambda own: running(own, _added)).alias("ends"))
    return rows.select(*[F.col(f"keep_{c}").alias(c) for c in keep], "text", _spans(rules).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with each run of overlapping spans replaced by `mark`; spans in order of their start.

    The text is cut into pieces first, so that a part of it is read from the piece it lies in.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def part(a: Column, b: Column) -> Column:
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        first, last = F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, j), F.lit(""))
        inner = F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        return F.when(i == j, F.substring(first, a % PIECE + 1, b - a)).otherwise(F.concat(F.substring(first, a % PIECE + 1, F.lit(PIECE)), inner, F.substring(last, F.lit(1), b % PIECE)))

    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    past = F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(spans))
    runs = F.filter(F.zip_with(spans, past, lambda s, p: F.struct(p.alias("lo"), s["start"].alias("hi"))), lambda r: r["hi"] >= r["lo"])
    head = F.array_join(F.transform(runs, lambda r: F.concat(part(r["lo"], r["hi"]), F.lit(mark))), "")
    return F.when(F.size(spans) > 0, F.concat(head, part(F.element_at(ends, -1), F.length(text)))).otherwise(text)
