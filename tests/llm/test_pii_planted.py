"""Added spans of personal data on planted texts: recall by form, precision, and what is never added."""

import os
import random

import pytest

from routeloom.llm import pii

SMALL = "/root/testdata/sf0.1"
WORDS = "the of and to in for with that this from report meeting total value house garden river music paper letter".split()


def filler(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def planted(rng):
    """(body, whether it is personal) of forms that the strict rules miss, with values of their own."""
    name, host = rng.choice(["jane.doe", "max", "li_wei", "a.b"]), rng.choice(["example", "mail-host", "uni"])
    top = rng.choice(["com", "org", "net"])
    d = "".join(rng.choice("123456789") for _ in range(12))
    h = [f"{rng.randrange(1, 65536):x}" for _ in range(8)]
    good = [f"{name} (at) {host} (dot) {top}", f"{name} [at] {host}.{top}", f"{name} at {host} dot {top}", f"{name} @ {host}.{top}", f"({d[:3]}) {d[3:6]}-{d[6:10]}", f"{d[:3]}-{d[3:6]}-{d[6:10]}", f"020 {d[:4]} {d[4:8]}", f"0044 20 {d[:4]} {d[4:8]}", f"2001:db8::{h[0]}", ":".join(h), f"fe80::{h[0]}:{h[1]}:{h[2]}:{h[3]}"]
    poor = [f"{rng.randrange(1900, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}", f"version {rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(20)}", f"192.168.{rng.randrange(256)}.{rng.randrange(256, 999)}", f"{name} @ {host}", f"meet at {host}", ":".join(f"{rng.randrange(256):02x}" for _ in range(6)), d[:9], f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", f"{rng.randrange(1900, 2030)}-{rng.randrange(1900, 2030)}"]
    return [(x, True) for x in good] + [(x, False) for x in poor]


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("needs the tables")
    return pii.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_recall_and_precision_of_added_spans(model):
    rng = random.Random(12)
    found, asked, wrong, added = {}, {}, 0, 0
    for _ in range(40):
        for k, (body, personal) in enumerate(planted(rng)):
            text = f"{filler(rng)} {body} {filler(rng)}"
            start, strict = text.index(body), pii.base_spans(text)
            spans = pii.added_spans(text, model, strict)
            hit = any(s <= start + 1 and e >= start + len(body) - 1 for s, _, e in spans + strict)
            added += len(spans)
            if personal:
                asked[k] = asked.get(k, 0) + 1
                found[k] = found.get(k, 0) + hit
            else:
                wrong += len(spans)
    recall, precision = sum(found.values()) / sum(asked.values()), 1 - wrong / max(added, 1)
    print(f"recall {recall:.3f}, precision {precision:.3f}, by form {[round(found[k] / asked[k], 2) for k in sorted(asked)]}")
    assert recall >= 0.8 and precision >= 0.9


def test_failures_are_never_added_and_ranges_count_once(model):
    rng = random.Random(2)
    for body in ("192.168.1.256", "300.1.1.1", "4111 1111 1111 1112", "12345:1::1::2", "1:2:3:4:5:6:7:8:9", "gggg::1"):
        for _ in range(10):
            text = f"{filler(rng)} {body} {filler(rng)}"
            start = text.index(body)
            spans = pii.added_spans(text, model, pii.base_spans(text))
            assert not any((s, e) == (start, start + len(body)) for s, _, e in spans), body
            assert len({(s, e) for s, _, e in spans}) == len(spans)
