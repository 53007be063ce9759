"""Templates of licenses: notices, the usual short forms of a declaration, and the paragraphs of whole license texts.

A family (GPL, CC-BY) stands for a license whose version is not said; paragraphs that several versions share go to it.
"""

from __future__ import annotations

import pkgutil
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import product

TEXTS = ("Apache-2.0", "Artistic-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")
GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License", "GFDL": "GNU Free Documentation License"}
VERSIONED = {
    **{k: (v, v.removeprefix("GNU "), k, f"GNU {k}") for k, v in GNU.items()},
    "Apache": ("Apache License", "Apache Software License", "Apache"),
    "MPL": ("Mozilla Public License", "MPL"),
    "EPL": ("Eclipse Public License", "EPL"),
    "EUPL": ("European Union Public Licence", "EUPL"),
    "Artistic": ("Artistic License",),
    "OFL": ("SIL Open Font License", "Open Font License", "OFL"),
    "BSL": ("Boost Software License",),
}
VERSIONS = {"GPL": "1.0 2.0 3.0", "LGPL": "2.0 2.1 3.0", "AGPL": "1.0 3.0", "GFDL": "1.1 1.2 1.3", "Apache": "1.0 1.1 2.0", "MPL": "1.0 1.1 2.0", "EPL": "1.0 2.0", "EUPL": "1.1 1.2", "Artistic": "1.0 2.0", "OFL": "1.0 1.1", "BSL": "1.0"}
PLAIN = {
    "MIT": ("MIT License", "MIT", "Expat License", "MIT X11 License", "MIT Expat License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD 3-Clause", "New BSD License", "Modified BSD License", "Revised BSD License", "three clause BSD license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD 2-Clause", "Simplified BSD License", "FreeBSD License", "two clause BSD license"),
    "BSD": ("BSD License", "BSD style License", "BSD"),
    "ISC": ("ISC License", "ISC"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License", "zlib libpng License"),
    "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0", "Creative Commons Zero", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
}
CREATIVE = {"BY": "Attribution", "SA": "ShareAlike|Share-Alike|Share Alike", "NC": "NonCommercial|Non-Commercial|NonCommercial Use", "ND": "NoDerivatives|NoDerivs|No-Derivatives|No Derivative Works"}
VERBS = ("licensed under", "released under", "distributed under", "available under", "published under", "provided under", "shared under", "covered by", "governed by", "subject to", "under the terms of", "subject to the terms of")
#: Words by which licenses differ: a notice that lacks one, or has one put in, is that of another license.
NAMES = frozenset("affero lesser library gnu non noncommercial commercial share sharealike alike noderivatives noderivs derivatives nc nd sa cc by zero mit bsd isc apache mozilla clause".split())
NOTE = 12
#: Words that join a second license to a first; such a notice counts only right after another.
JOINED = ("or", "and", "with")
NEGATED = re.compile(r"\b(not|never|neither|nor|cannot|(?:is|are|was|were)n t)( been| be| yet| currently)?( (licensed|released|distributed|available|published|provided|shared|covered|governed|subject)( (under|by|to)( the terms of)?)?)?( the| a)?( gnu)?$")


def other_license(notice: list[str], missing: list[str], inserted: list[str]) -> bool:
    """Whether the differing words are a name, or a number where the notice has numbers."""
    numbered = any(w.isdigit() for w in notice)
    return any(w in NAMES or numbered and w.strip("v").isdigit() for w in (*missing, *inserted))


@cache
def titles() -> frozenset[tuple[str, ...]]:
    """The names that declare by themselves, as words."""
    return frozenset(tuple(re.findall("[0-9a-z]+", form.lower().replace("licence", "license"))) for _, form in names())


def refused(notice: list[str], start: int, end: int, block: list[str]) -> bool:
    """Whether the words around say otherwise: a short form behind a negation, or before more of a version number than it has."""
    if len(notice) >= NOTE:
        return False
    if NEGATED.search(" ".join(block[max(0, start - 10) : start])):
        return True
    after = [w for w in block[end : end + 3] if w not in ("v", "version", "license")][:1] if not notice[-1].isdigit() else block[end : end + 1]
    return bool(after) and re.fullmatch("v?[0-9]{1,2}", after[0]) is not None


def names() -> Iterator[tuple[str, str]]:
    """(license, the way it is named)."""
    for family, forms in VERSIONED.items():
        for form in forms:
            yield family, form
        for version in VERSIONS[family].split():
            short = [version, version.removesuffix(".0")]
            for form, v in product(forms, dict.fromkeys(short)):
                for text in (f"{form} {v}", f"{form} v{v}", f"{form} v {v}", f"{form} version {v}", f"{form} {v} License", f"version {v} of the {form}"):
                    yield f"{family}-{version}", text
            yield f"{family}-{version}", f"{family}v{short[-1]}"
    for name, forms in PLAIN.items():
        yield from ((name, form) for form in forms)
    for parts in (("BY",), ("BY", "SA"), ("BY", "NC"), ("BY", "ND"), ("BY", "NC", "SA"), ("BY", "NC", "ND")):
        spelled = [" ".join(p) for p in product(*(CREATIVE[x].split("|") for x in parts))]
        spelled = [f"CC {' '.join(parts)}", f"Creative Commons {' '.join(parts)}", *(f"Creative Commons {s}" for s in spelled)]
        for form in spelled:
            yield f"CC-{'-'.join(parts)}", form
            yield f"CC-{'-'.join(parts)}", f"{form} License"
            for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
                for text in (f"{form} {v}", f"{form} {v} License", f"{form} {v} International", f"{form} {v} International License", f"{form} {v} Unported License", f"{form} License {v}", f"{form} version {v}"):
                    yield f"CC-{'-'.join(parts)}-{v}", text


def short_forms() -> Iterator[tuple[str, str]]:
    for name, form in names():
        titled = re.search(r"(?i)licen[sc]e", form)
        if titled:
            yield name, form
        if name.startswith("CC-") and name[-1] == "0":
            yield from ((name, lead + form) for lead in ("", "licensed under ", "licensed under a ", "licensed under the "))
            continue
        bare = not titled and not re.search(r"\d", form)
        for verb, article in product(VERBS, ("", "the ") if bare and len(form.split()) == 1 else ("", "the ", "a ")):
            yield name, f"{verb} {article}{form}"
        yield name, f"license {form}"
        if not bare:
            yield from ((name, f"under {article}{form}") for article in ("", "the "))
        yield from ((name, f"{joined} {form}") for joined in JOINED)
        if " " not in form or "-" in name:
            yield name, f"license identifier {form}"
            yield name, f"SPDX license identifier {name}"
            yield from ((name, f"{joined} {name}") for joined in JOINED)


def headers() -> Iterator[tuple[str, str]]:
    """The standard headers of the GNU licenses."""
    versions = [("GPL", "1", "1.0"), ("GPL", "2", "2.0"), ("GPL", "3", "3.0"), ("LGPL", "2", "2.0"), ("LGPL", "2.1", "2.1"), ("LGPL", "3", "3.0"), ("AGPL", "3", "3.0")]
    for subject, (family, v, version) in product(("program", "library", "software", "file"), versions):
        title = "GNU Library General Public License" if (family, v) == ("LGPL", "2") else GNU[family]
        head = f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation"
        yield f"{family}-{version}", f"{head}, either version {v} of the License"
        yield f"{family}-{version}", f"{head}, version {v} of the License"
        yield f"{family}-{version}", f"{head}, version {v}"
    for subject, family in product(("program", "library", "software", "file"), ("GPL", "LGPL", "AGPL")):
        yield family, f"This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {GNU[family]} for more details."


def paragraphs() -> Iterator[tuple[str, str]]:
    """Paragraphs of whole texts, without their numbering."""
    for name in TEXTS:
        for text in re.split(r"\n\s*\n", pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()):
            yield name, re.sub(r"^\W*(?:[0-9]+(?:\.[0-9]+)*|[a-zA-Z])[.)]\s", "", text)


def templates(notices: dict[str, tuple[str, ...]], words: Callable[[str], list[str]]) -> dict[str, list[list[str]]]:
    """The word lists of each license; one that several licenses share goes to their family, or to none."""
    owners: dict[tuple[str, ...], set[str]] = defaultdict(set)
    for name, text in paragraphs():
        if len(w := words(text)) >= NOTE:
            owners[tuple(w)].add(name)
    for notice, own in owners.items():
        families = {n.split("-")[0] for n in own}
        if len(own) > 1:
            owners[notice] = families if len(families) == 1 else {"GNU"} if families <= GNU.keys() else set()
    for source in (headers(), short_forms()):
        for name, text in source:
            owners.setdefault(tuple(words(text)), {name})
    for name, texts in notices.items():
        for text in texts:
            owners[tuple(words(text))] = {name}
    out: dict[str, list[list[str]]] = defaultdict(list)
    for notice, own in owners.items():
        for name in own:
            out[name].append(list(notice))
    return dict(out)
