"""The ordered license signatures.

A signature is written in words: ``a|b`` is either word, ``w?`` may be missing. ``regex`` turns it into a regular expression
over text in which every word stands between single spaces of its own (`` the  mit  license ``), so two matches that
follow each other never share a space, and no look-around is needed.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    order: int
    label: str
    tier: int
    weight: float
    keyword: str
    regex: str


# What the base labels are defined by.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

# Label and names; the first name of each is its identifier.
NAMES: list[tuple[str, tuple[str, ...]]] = [
    ("mit", ("mit", "expat", "massachusetts institute of technology")),
    ("apache-2", ("apache 2 0?", "apache license|licence version|v 2 0?", "apache software? license|licence 2 0?", "asl 2 0?")),
    ("apache-1.1", ("apache 1 1", "apache software license|licence version? 1 1")),
    ("apache-1", ("apache 1 0", "apache license|licence version? 1 0")),
    ("bsd-2-clause", ("bsd 2 clause", "bsd2", "freebsd", "simplified bsd", "two|2 clause bsd")),
    ("bsd-3-clause", ("bsd 3 clause", "bsd3", "new|modified|revised bsd", "three|3 clause bsd")),
    ("bsd-4-clause", ("bsd 4 clause", "original bsd", "four|4 clause bsd")),
    ("bsd-0", ("0bsd", "zero clause bsd")),
    ("gpl-1", ("gpl 1 0?", "gplv1", "gnu general public license|licence version|v 1")),
    ("gpl-2", ("gpl 2 0?", "gplv2", "gpl2", "gnu general public license|licence version|v 2", "gnu gpl version|v 2")),
    ("gpl-3", ("gpl 3 0?", "gplv3", "gpl3", "gnu general public license|licence version|v 3", "gnu gpl version|v 3")),
    ("lgpl-2", ("lgpl 2 0?", "lgplv2", "gnu library general public license|licence")),
    ("lgpl-2.1", ("lgpl 2 1", "gnu lesser general public license|licence version|v 2 1")),
    ("lgpl-3", ("lgpl 3 0?", "lgplv3", "gnu lesser general public license|licence version|v 3")),
    ("agpl-3", ("agpl 3 0?", "agplv3", "gnu? affero general public license|licence version|v 3")),
    ("gfdl", ("gfdl 1 1|2|3", "gnu free documentation license|licence")),
    ("mpl-1.1", ("mpl 1 1", "mozilla public license|licence version|v? 1 1")),
    ("mpl-2", ("mpl 2 0?", "mozilla public license|licence version|v? 2 0?")),
    ("epl-1", ("epl 1 0?", "eclipse public license|licence version|v? 1 0?")),
    ("epl-2", ("epl 2 0?", "eclipse public license|licence version|v? 2 0?")),
    ("cddl-1", ("cddl 1 0|1?", "common development and distribution license|licence")),
    ("cpl-1", ("cpl 1 0?", "common public license|licence version|v? 1 0?")),
    ("isc", ("isc", "internet systems consortium")),
    ("zlib", ("zlib", "zlib libpng")),
    ("unlicense", ("unlicense", "the unlicense")),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public")),
    ("bsl-1", ("bsl 1 0?", "boost software license|licence version|v? 1 0?")),
    ("busl-1.1", ("busl 1 1", "business source license|licence version|v? 1 1")),
    ("artistic-1", ("artistic 1 0?", "artistic license|licence version|v? 1 0?")),
    ("artistic-2", ("artistic 2 0?", "artistic license|licence version|v? 2 0?")),
    ("cc0", ("cc0 1? 0?", "creative commons zero", "cc zero")),
    ("cc-by", ("cc by 1|2|3|4? 0?", "creative commons attribution 1|2|3|4? 0?")),
    ("cc-by-sa", ("cc by sa 1|2|3|4? 0?", "creative commons attribution share alike", "creative commons attribution sharealike")),
    ("cc-by-nd", ("cc by nd 1|2|3|4? 0?", "creative commons attribution no derivatives", "creative commons attribution noderivs")),
    ("cc-by-nc", ("cc by nc 1|2|3|4? 0?", "creative commons attribution non commercial", "creative commons attribution noncommercial")),
    ("cc-by-nc-sa", ("cc by nc sa 1|2|3|4? 0?", "creative commons attribution noncommercial sharealike")),
    ("cc-by-nc-nd", ("cc by nc nd 1|2|3|4? 0?", "creative commons attribution noncommercial noderivatives|noderivs")),
    ("ofl-1.1", ("ofl 1 1", "sil open font license|licence", "open font license|licence")),
    ("eupl-1.1", ("eupl 1 1", "european union public license|licence version|v? 1 1")),
    ("eupl-1.2", ("eupl 1 2", "european union public license|licence version|v? 1 2")),
    ("psf-2", ("psf 2 0?", "python software foundation license|licence")),
    ("php-3", ("php 3 0|01?", "php license|licence version|v? 3 0|01?")),
    ("openssl", ("openssl", "openssl ssleay")),
    ("postgresql", ("postgresql", "postgresql global development group")),
    ("ncsa", ("ncsa", "university of illinois ncsa open source")),
    ("upl-1", ("upl 1 0?", "universal permissive license|licence")),
    ("ms-pl", ("ms pl", "microsoft public license|licence")),
    ("ms-rl", ("ms rl", "microsoft reciprocal license|licence")),
    ("osl-3", ("osl 3 0?", "open software license|licence version|v? 3 0?")),
    ("afl-3", ("afl 3 0?", "academic free license|licence version|v? 3 0?")),
    ("odbl", ("odbl 1? 0?", "open database license|licence")),
    ("odc-by", ("odc by", "open data commons attribution")),
    ("pddl", ("pddl", "public domain dedication and license|licence")),
    ("sspl-1", ("sspl 1? 0?", "server side public license|licence")),
    ("elastic-2", ("elastic 2 0?", "elastic license|licence 2 0?")),
]

# Signatures without a name in them: label, tier, weight, words.
TEXTS: list[tuple[str, int, float, str]] = [
    ("mit", 1, 0.99, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 1, 0.97, "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd-3-clause", 1, 0.97, "neither the name of"),
    ("bsd-4-clause", 1, 0.97, "all advertising materials mentioning features or use of this software"),
    ("zlib", 1, 0.97, "this software is provided as is without any express or implied warranty"),
    ("gpl", 2, 0.9, "gnu general public license|licence"),
    ("gpl", 3, 0.6, "gnu gpl"),
    ("lgpl", 2, 0.9, "gnu lesser general public license|licence"),
    ("agpl", 2, 0.9, "gnu? affero general public license|licence"),
    ("apache-2", 1, 0.98, "apache org licenses license 2 0"),
    ("mit", 1, 0.98, "opensource org licenses mit"),
    ("mpl-2", 1, 0.98, "mozilla org mpl 2 0"),
    ("gpl", 1, 0.9, "gnu org licenses gpl"),
    ("lgpl", 1, 0.9, "gnu org licenses lgpl"),
    ("cc-by", 1, 0.98, "creativecommons org licenses by 1|2|3|4 0|5"),
    ("cc-by-sa", 1, 0.98, "creativecommons org licenses by sa 1|2|3|4 0|5"),
    ("cc-by-nc", 1, 0.98, "creativecommons org licenses by nc 1|2|3|4 0|5"),
    ("cc-by-nd", 1, 0.98, "creativecommons org licenses by nd 1|2|3|4 0|5"),
    ("cc-by-nc-sa", 1, 0.98, "creativecommons org licenses by nc sa 1|2|3|4 0|5"),
    ("cc-by-nc-nd", 1, 0.98, "creativecommons org licenses by nc nd 1|2|3|4 0|5"),
    ("cc0", 1, 0.98, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", 2, 0.9, "released|dedicated|placed into|to|in the public domain"),
    ("public-domain", 3, 0.5, "in the public domain"),
    ("proprietary", 3, 0.5, "all rights reserved"),
    ("proprietary", 2, 0.8, "proprietary and confidential"),
    ("unlicense", 1, 0.98, "this is free and unencumbered software released into the public domain"),
]

# Around a name: tier, weight, words before and after it.
FRAMES = [
    (1, 0.99, "spdx license identifier {}"),
    (1, 0.95, "licensed|released|distributed|available|published|provided under the? terms? of? the? {} license|licence?"),
    (2, 0.85, "under the? {} license|licence?"),
    (3, 0.6, "{} license|licence"),
]

# Words that tell nothing about a license.
COMMON = {"the", "of", "in", "to", "under", "spdx", "identifier", "license", "public", "software", "open", "version", "general", "and"}


def regex(words: str) -> str:
    out = []
    for word in words.split():
        optional = word.endswith("?")
        core = word.rstrip("?")
        body = f" (?:{core}) " if "|" in core else f" {core} "
        out.append(f"(?:{body})?" if optional else body)
    return "".join(out)


def keyword(words: str) -> str:
    """The longest telling word every match contains, with its spaces."""
    sure = [w for w in words.split() if "|" not in w and not w.endswith("?")]
    return f" {max([w for w in sure if w not in COMMON] or sure, key=len)} "


def rules() -> list[Rule]:
    """All signatures in order. A bare name counts only if it has two words or more."""
    found: list[tuple[str, int, float, str]] = list(TEXTS)
    for label, names in NAMES:
        for name in names:
            found += [(label, tier, weight, frame.format(name)) for tier, weight, frame in FRAMES]
            if sum(not w.endswith("?") for w in name.split()) > 1:
                found.append((label, 3, 0.6, name))
    found.sort(key=lambda r: (r[1], -len(r[3].split())))
    return [Rule(i, label, tier, weight, keyword(words), regex(words)) for i, (label, tier, weight, words) in enumerate(found)]
