"""License scans: candidates against all windows, the choice by compression, and planted declarations."""

import random

import zstandard

from routeloom.llm import license_forms, licenses

SCAN = licenses.scanner(0.1)


def declared(text):
    return [f.license for f in SCAN.scan(licenses.words(text))]


def some_notices(rng, n):
    return [(name, notice) for name in sorted(licenses.templates()) for notice in rng.sample(licenses.templates()[name], min(n, len(licenses.templates()[name])))]


def garbled(rng, notice):
    """A notice with edits within the tolerance, at words that do not tell licenses apart."""
    out = list(notice)
    for _ in range(int(0.1 * len(notice))):
        k = rng.randrange(len(out))
        if out[k] not in license_forms.NAMES and not out[k].strip("v").isdigit():
            out[k : k + 1] = rng.choice([[], [out[k], "zzz"]])
    return out


def test_candidates_miss_no_window():
    """The pieces find every notice that an alignment at every word and for every template finds."""
    rng = random.Random(4)
    pool = some_notices(rng, 3)
    for _ in range(12):
        chosen = rng.sample(pool, 12)
        text = []
        for name, notice in chosen[:3]:
            text += rng.choices(["zz", "license", "the", "under", "2", "gnu"], k=rng.randint(0, 6)) + garbled(rng, notice)
        blocks = SCAN.blocks(text)
        quick = {m[:3] for start, end, hits in blocks for h in hits if (m := SCAN.confirmed(text, *h))}
        for name, notice in chosen:
            limit = int(0.1 * len(notice))
            for i in range(len(text)):
                found = licenses.extend(notice, text[i : i + len(notice) + limit], limit)
                if found and not license_forms.other_license(notice, found[1], found[2]) and not license_forms.refused(notice, i, i + found[0], text):
                    assert any(n == name and a < i + found[0] and i < b for a, b, n in quick), (name, notice, text)


def test_the_license_of_a_block_is_the_confirmed_one_that_saves_most():
    """Every template compresses the block anew; of those whose wording is confirmed there, the scan takes the first by bytes saved."""
    rng = random.Random(5)
    plain = zstandard.ZstdCompressor(level=SCAN.level, write_content_size=False)
    checked = 0
    for name, notice in rng.sample(some_notices(rng, 2), 60):
        text = ["zz", *notice, "yy"]
        blocks = SCAN.blocks(text)
        if len(blocks) != 1 or notice[0] in license_forms.JOINED:
            continue
        start, end, hits = blocks[0]
        confirmed = {}
        for h in hits:
            if h[2].notice[0] not in license_forms.JOINED and (m := SCAN.confirmed(text, *h)):
                confirmed.setdefault(m.name, set()).add(m)
        if any(m.kept >= license_forms.NOTE for own in confirmed.values() for m in own):
            confirmed = {n: {m for m in own if tuple(text[m.start : m.end]) not in license_forms.titles()} for n, own in confirmed.items()}
        confirmed = licenses._sound({n: licenses._apart(own) for n, own in confirmed.items() if own}) if any(confirmed.values()) else set()
        body = " ".join(text[start:end]).encode()
        saved = {}
        for other, notices in licenses.templates().items():
            raw = zstandard.ZstdCompressionDict(" ".join(w for n in notices for w in n).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=SCAN.level)
            saved[other] = len(plain.compress(body)) - len(zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False).compress(body))
        if confirmed:
            first = min(confirmed, key=lambda n: (-saved[n], n))
            assert first in {f.license for f in SCAN.scan(text)}
            checked += 1
    assert checked > 40


def test_the_choice_is_the_dictionaries(monkeypatch):
    """With the savings turned round, blocks whose wording several licenses share go to another one."""
    texts = [n for name, n in some_notices(random.Random(6), 6) if len(n) > 5]
    before = [[f.license for f in SCAN.scan(t)] for t in texts]
    real = licenses.Scanner.sizes
    monkeypatch.setattr(licenses.Scanner, "sizes", lambda self, block: (real(self, block)[0], {n: 2 * real(self, block)[0] - s for n, s in real(self, block)[1].items()}))
    after = [[f.license for f in SCAN.scan(t)] for t in texts]
    assert sum(x != y for x, y in zip(before, after, strict=True)) >= 5


def test_names_expressions_and_refusals():
    for text, expected in {
        "License: MIT": ["MIT"],
        "MIT License": ["MIT"],
        "Mozilla Public License Version 2.0": ["MPL-2.0"],
        "GNU Lesser General Public License, version 2.1.": ["LGPL-2.1"],
        "under GPLv2 or later": ["GPL-2.0"],
        "Licensed under the EUPL": ["EUPL"],
        "Dual licensed under MIT or Apache-2.0": ["MIT", "Apache-2.0"],
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
        "SPDX-License-Identifier: GPL-2.0-only AND BSD-3-Clause": ["GPL-2.0"],
        "This software is not licensed under the MIT License": [],
        "was never released under the GNU General Public License": [],
        "licensed under the Apache License version 3.0": [],
        "licensed under the GPL version 9": [],
        "released under LGPL 2.1": ["LGPL-2.1"],
        "he studied at Harvard or MIT and BSD": [],
        "a license plate, a driving license": [],
        "": [],
    }.items():
        found = declared(text)
        assert found == expected or (expected == ["GPL-2.0"] and found[:1] == expected), (text, found)


def planted(rng):
    """(text, the license it declares) for each license, in noise, across lines, with edits."""
    filler = "lorem ipsum the of license work software copy public version notice under terms rights code file".split()
    for name, notice in some_notices(rng, 4):
        if notice[0] in license_forms.JOINED:
            continue
        words = garbled(rng, notice) if len(notice) > 12 else notice
        lines, row = [], []
        for w in words:
            row.append(w)
            if rng.random() < 0.15:
                lines.append(" ".join(row))
                row = []
        body = "\n * ".join([*lines, " ".join(row)])
        yield f"{' '.join(rng.choices(filler, k=30))} zz\n * {body}\nzz {' '.join(rng.choices(filler, k=30))}", name


def test_planted_declarations():
    """Recall and wrong names on declarations of every license; a family may stand for one of its versions and the other way round."""
    rng, right, wrong, total = random.Random(11), 0, 0, 0
    family = lambda n: n.split("-")[0]
    for text, name in planted(rng):
        found = set(declared(text))
        total += 1
        right += any(f == name or name in (family(f), "GNU") or f in (family(name), "GNU") for f in found)
        wrong += sum(family(f) != family(name) and "GNU" not in (f, name) for f in found)
    print(f"planted {total}: found {right}, wrong names {wrong}")
    assert total > 150 and right >= 0.95 * total and wrong <= 0.02 * total
