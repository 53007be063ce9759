"""Periodic runs, archives and spelling variants against brute force, with odd rows and broken inputs."""

import glob
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import periodic, spelling, warc

SCHEMA = "doc_id long, text string, lang string, word string, n long, runs string, start long"
PAGES = "page_id long, url string, html string, digest string, payload string, kind string, status string"


def brute_runs(words):
    n, seen = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                seen.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def periodic_text(rng):
    n, kinds = rng.choice([0, 1, 11, 12, 13, 40, 150, 500]), rng.choice([1, 2, 3, 60])
    words = [str(rng.randrange(kinds)) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a = rng.randrange(n)
        p, m = rng.randint(1, max(1, (n - a) // 2)), rng.randint(1, n - a)
        for i in range(a, a + m):
            words[i] = words[a + (i - a) % p]
    return rng.choice([" ", "\t", "\n "]).join(words)


def test_runs_against_brute_force():
    rng = random.Random(3)
    found = 0
    for _ in range(200):
        texts = [periodic_text(rng) for _ in range(rng.randint(1, 4))]
        for text, (words, runs) in zip(texts, periodic.texts_runs(texts), strict=True):
            assert [tuple(r) for r in runs.tolist()] == brute_runs(text.split()) and words == text.split()
            found += len(runs)
    assert found > 200


@pytest.mark.parametrize("top", [50, 40_000, 1 << 30])  # as many primes as the sums need: one, two, three
def test_block_convolution_is_exact(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(1, top, 400).astype(np.uint64)
    ids[200:300] = ids[180:280]
    starts, length, near, far = np.arange(0, 300, 3), 4, 1, 40
    padded = np.concatenate([ids, np.full(far + length, top, np.uint64)])
    expected = {(s, d) for s in starts.tolist() for d in range(near, far + 1) if (padded[s : s + length] == padded[s + d : s + d + length]).all()}
    for cells in (1 << 18, 1 << 7):  # all blocks at once, and one at a time
        periodic.CELLS = cells
        assert set(zip(*(x.tolist() for x in periodic.occurrences(padded, starts, length, near, far, top + 1)), strict=True)) == expected
    periodic.CELLS = 1 << 18
    assert expected


def test_a_chance_agreement_of_sums_is_corrected(monkeypatch):
    real = periodic._Prefixes.same
    monkeypatch.setattr(periodic._Prefixes, "same", lambda self, a, d, m: real(self, a, d, m) | (m < 3))
    rng = random.Random(8)
    texts = [periodic_text(rng) for _ in range(60)]
    for text, (_, runs) in zip(texts, periodic.texts_runs(texts), strict=True):
        assert [tuple(r) for r in runs.tolist()] == brute_runs(text.split())


def test_long_periodic_texts_take_little_work():
    for words in (["a"] * 100_000, ["a", "b", "c"] * 30_000):
        ((_, runs),) = periodic.texts_runs([" ".join(words)])
        assert len(runs) == 1 and runs[0].tolist() == [0, len(words), len(set(words))]


def expected_runs(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p, old = 1 + (n - a) // (3 + g % 8), list(words)
            words = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    again = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in again)
    digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def test_runs_of_documents(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "   " * 30, "é " * 20, "a b " * 9, *(periodic_text(rng) for _ in range(60))]
    rows = [(k, t, "x", "w", 1, "r", 2) for k, t in enumerate(texts)]
    rows += [(None, "x y " * 8, None, None, None, None, None), (None, None, None, None, None, None, None), rows[6], rows[6]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = periodic.summary(periodic.find_runs(periodic.with_repeated_tails(docs)))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(str(expected_runs(r[0], r[1])) for r in rows)
    plain = {r.doc_id: r for r in periodic.find_runs(docs.where("doc_id = 6")).collect()}
    assert [tuple(x) for x in plain[6].runs] == [(0, 18, 2)] and plain[6].collapsed == "a b"
    assert periodic.find_runs(docs.limit(0)).count() == 0


def expected_pages(rows):
    groups = defaultdict(list)
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            groups[data].append(page_id)
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        first = min(groups[data]) if groups.get(data) else None
        later = first is not None and page_id != first
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", first if later else None, "ok"))
    return out


def page_rows():
    rng = random.Random(2)
    long = "".join(rng.choice("abcdeé \r\n") for _ in range(60_000))
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 4
    same = "<p>" + "x" * 120
    htmls = [None, "", "short", "short", same, same, same, long, long, tricky, "é" * 49, "é" * 50, "é" * 50]
    rows = [(k, f"http://example.com/{k} a\r\nX: y" if k % 3 else None, h, "d", "p", "k", "s") for k, h in enumerate(htmls)]
    return [*rows, (None, "u", same, *[None] * 4), (None, "u", "lone" * 40, *[None] * 4), (None, "u", "lone" * 40, *[None] * 4), rows[4], rows[5]]


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected_pages(rows)))
    assert warc.round_trip(pages.limit(0)).count() == 0


def parts_of(payload, segment=100):
    return [r + b"\r\n\r\n" for r in warc.records_of(7, "http://example.com/", payload, hashlib.sha256(payload).hexdigest(), None, False, segment)]


def read(spark, folder, *files):
    for k, data in enumerate(files):
        (folder / f"{k}.warc").write_bytes(data)
    return {r.record_id: r for r in warc.read_archives(spark, str(folder)).collect()}


def test_parts_meet_across_files_in_any_order(spark, tmp_path):
    payload = bytes(range(256)) * 5
    parts = parts_of(payload)
    random.Random(1).shuffle(parts)
    half = len(parts) // 2
    found = read(spark, tmp_path, b"".join(parts[:half]), gzip.compress(b"".join(parts[half:])) + gzip.compress(parts[0]))
    (row,) = found.values()
    assert row.status == "ok" and bytes(row.payload) == payload and row.page_id == 7 and row.target_uri == "http://example.com/"


def test_broken_archives_have_a_status(spark, tmp_path):
    payload = b"z" * 500
    whole = parts_of(payload, 1 << 20)[0]
    cases = {"lost": parts_of(payload)[:1] + parts_of(payload)[2:], "headless": None, "total": None, "framing": [whole.replace(b"1f4\r\n", b"1f5\r\n")], "digest": [whole.replace(b"zzz\r\n0", b"zzy\r\n0")]}
    parts = parts_of(payload)
    cases["lost"] = parts[:1] + parts[2:]
    cases["headless"] = parts[1:]
    cases["total"] = [re.sub(rb"Total-Length: \d+", b"Total-Length: 9", p) for p in parts]
    expected = {"lost": {"segments"}, "headless": {"segments"}, "total": {"length"}, "framing": {"framing"}, "digest": {"digest"}}
    for name, data in cases.items():
        (folder := tmp_path / name).mkdir()
        found = read(spark, folder, b"".join(data))
        assert {r.status for r in found.values()} == expected[name] and all(r.payload is None for r in found.values())
    (folder := tmp_path / "cut").mkdir()
    found = read(spark, folder, (whole + whole)[:-20], b"no archive at all", gzip.compress(whole)[:-30], b"")
    assert [r.status for r in found.values() if r.record_id] == ["ok"] and bytes(next(r for r in found.values() if r.record_id).payload) == payload
    assert warc.read_archives(spark, str(folder)).where("status = 'cut'").count() == 3
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nhel")
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def test_large_records_are_cut_and_archives_are_gzip(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "y" * (50_000 + k), None, None, None, None) for k in range(3)], PAGES)
    warc.write_archives(pages, str(tmp_path / "w"), records_a_file=2)
    files = glob.glob(str(tmp_path / "w" / "*.gz"))
    text = b"".join(gzip.open(f).read() for f in files)
    assert len(files) > 3 and text.count(b"WARC-Type: continuation") == 9 and text.count(b"WARC-Type: response") == 3


UPPER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def expected_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others and words[b := min(others, key=lambda v: (-words[v], v))] >= 10 * words[w]:
            form[w] = b

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), words[form[w]] if w in form else -1) for w, n in words.items())


def spelled(rng):
    bases = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(12)] + ["ÀÿÉbcde", "x" * 40, "straßen", "STRAßEN"]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(40):
            w = list(rng.choice(bases[: rng.choice([2, 16])]))
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice("abcé×")], [w[i], rng.choice("abe")]])
            words.append("".join(w))
        texts.append(rng.choice([" ", ", ", "1"]).join(words))
    return texts


def test_spelling_against_brute_force(spark):
    rows = [(k, t, "x", "w", 1, "r", 2) for k, t in enumerate([None, "", "short", *spelled(random.Random(6))])]
    rows += [(None, rows[5][1], *[None] * 5), rows[6], (900, "Wörterbuch " * 3000, *[None] * 5), (901, "wörterbuhc wörterbuh wörterbuh", *[None] * 5)]
    rows += [(902, "verlaufen " * 300 + "verlaufem " * 20 + "verlaupem " * 2, *[None] * 5)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    words = spelling.vocabulary(docs)
    expected = expected_words(rows)
    assert {r.word: r.n for r in words.collect()} == expected
    variants = expected_variants(expected)
    assert any(v[1] for v in variants) and any(v[1] and v[1] != v[2] for v in variants)
    for crowd in (2000, 0, 1):  # all through the reduced alphabet, all beside it, both
        got = spelling.group_variants(words, crowd=crowd).collect()
        assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got) == variants
    assert spelling.group_variants(spelling.vocabulary(docs.limit(0))).count() == 0


def test_neighbourhoods_meet_exactly_once(spark):
    rng = random.Random(9)
    forms = sorted({"".join(rng.choice("012345") for _ in range(rng.randint(1, 5))) for _ in range(150)})
    keys = {r.f: r.k for r in spark.createDataFrame([(f,) for f in forms], "f string").select("f", spelling.neighbourhood(F.col("f")).alias("k")).collect()}
    for a in forms:
        assert len(set(keys[a])) == len(keys[a])
        for b in forms:
            assert (b in keys[a]) + (a in keys[b]) == (2 if a == b else int(one_edit(a, b)))


def test_chains_of_forms_lead_to_the_last(spark):
    rows = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("zzzzzzz", 5)]
    got = {r.word: r for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert {w: r.root for w, r in got.items()} == {**dict.fromkeys(["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb"], "aaaabbb"), "zzzzzzz": "zzzzzzz"}
    assert got["aaaaaaa"].form == "aaaaaab" and got["aaaaaab"].n_near == 2 and got["zzzzzzz"].form is None
