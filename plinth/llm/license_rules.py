"""Signature rules for licenses: patterns over lower-cased text, each with a keyword and a priority."""

from __future__ import annotations

from dataclasses import dataclass

#: What may stand between two words of a phrase.
GAP = r"[^0-9a-z\x{80}-\x{10ffff}]+"
EDGE_L, EDGE_R = r"(?<![0-9a-z\x{80}-\x{10ffff}])", r"(?![0-9a-z\x{80}-\x{10ffff}])"


@dataclass(frozen=True)
class Signature:
    """A rule: a text is matched against ``pattern`` only if it has ``keyword``; lower ``priority`` wins."""

    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


#: label; identifiers as written after an SPDX tag; titles; phrases of the license's own text; hosts and paths of its address.
FAMILIES = (
    ("agpl-3.0", ("agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"), ("gnu affero general public license", "affero general public license", "agpl v3", "agplv3"), ("remote network interaction",), ("gnu.org/licenses/agpl",)),
    ("gpl-3.0", ("gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"), ("gnu general public license version 3", "gnu gpl version 3", "gpl v3", "gplv3", "gnu gpl v3"), ("either version 3 of the license or at your option any later version",), ("gnu.org/licenses/gpl-3.0", "gnu.org/licenses/gpl.html")),
    ("gpl-2.0", ("gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"), ("gnu general public license version 2", "gnu gpl version 2", "gpl v2", "gplv2", "gnu gpl v2"), ("either version 2 of the license or at your option any later version",), ("gnu.org/licenses/gpl-2.0", "gnu.org/licenses/old-licenses/gpl-2.0")),
    ("gpl-1.0", ("gpl 1 0", "gpl 1 0 only", "gpl 1 0 or later"), ("gnu general public license version 1",), (), ("gnu.org/licenses/old-licenses/gpl-1.0",)),
    ("gpl", ("gpl",), ("gnu general public license", "gnu gpl"), ("free software you can redistribute it and or modify it under the terms of the gnu general public license",), ("gnu.org/copyleft/gpl",)),
    ("lgpl-3.0", ("lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"), ("gnu lesser general public license version 3", "lgpl v3", "lgplv3"), (), ("gnu.org/licenses/lgpl-3.0",)),
    ("lgpl-2.1", ("lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"), ("gnu lesser general public license version 2 1", "lgpl v2 1"), (), ("gnu.org/licenses/old-licenses/lgpl-2.1", "gnu.org/licenses/lgpl-2.1")),
    ("lgpl-2.0", ("lgpl 2 0", "lgpl 2 0 only", "lgpl 2 0 or later"), ("gnu library general public license", "gnu library general public license version 2"), (), ("gnu.org/licenses/old-licenses/lgpl-2.0",)),
    ("lgpl", ("lgpl",), ("gnu lesser general public license", "gnu lgpl"), (), ("gnu.org/copyleft/lesser", "gnu.org/licenses/lgpl")),
    ("gfdl", ("gfdl 1 1", "gfdl 1 2", "gfdl 1 3"), ("gnu free documentation license",), ("with no invariant sections no front cover texts and no back cover texts",), ("gnu.org/licenses/fdl",)),
    ("apache-2.0", ("apache 2 0",), ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"), ("unless required by applicable law or agreed to in writing software distributed under the license",), ("apache.org/licenses/license-2.0",)),
    ("apache-1.1", ("apache 1 1",), ("apache software license version 1 1", "apache license version 1 1"), (), ("apache.org/licenses/license-1.1",)),
    ("apache", (), ("apache license", "apache software license"), (), ("apache.org/licenses",)),
    ("mit", ("mit",), ("mit license", "expat license", "mit expat license"), ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",), ("opensource.org/licenses/mit", "mit-license.org")),
    ("mit-0", ("mit 0",), ("mit no attribution",), (), ("opensource.org/licenses/mit-0",)),
    ("x11", ("x11",), ("x11 license", "mit x11 license"), (), ()),
    ("bsd-2-clause", ("bsd 2 clause",), ("simplified bsd license", "freebsd license", "2 clause bsd license", "bsd 2 clause license"), (), ("opensource.org/licenses/bsd-2-clause",)),
    ("bsd-3-clause", ("bsd 3 clause",), ("new bsd license", "modified bsd license", "3 clause bsd license", "bsd 3 clause license", "revised bsd license"), ("neither the name of the copyright holder nor the names of its contributors",), ("opensource.org/licenses/bsd-3-clause",)),
    ("bsd-4-clause", ("bsd 4 clause",), ("original bsd license", "4 clause bsd license", "bsd 4 clause license"), ("all advertising materials mentioning features or use of this software must display",), ()),
    ("bsd", ("bsd",), ("bsd license", "bsd style license", "berkeley software distribution license"), ("redistribution and use in source and binary forms with or without modification are permitted",), ()),
    ("0bsd", ("0bsd",), ("zero clause bsd license", "bsd zero clause license"), (), ("opensource.org/licenses/0bsd",)),
    ("isc", ("isc",), ("isc license",), ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",), ("opensource.org/licenses/isc",)),
    ("mpl-2.0", ("mpl 2 0",), ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"), (), ("mozilla.org/mpl/2.0",)),
    ("mpl-1.1", ("mpl 1 1",), ("mozilla public license version 1 1",), (), ("mozilla.org/mpl/1.1",)),
    ("mpl", (), ("mozilla public license",), (), ("mozilla.org/mpl",)),
    ("epl-2.0", ("epl 2 0",), ("eclipse public license version 2 0", "eclipse public license 2 0"), (), ("eclipse.org/legal/epl-2.0", "eclipse.org/legal/epl-v20")),
    ("epl-1.0", ("epl 1 0",), ("eclipse public license version 1 0", "eclipse public license 1 0"), (), ("eclipse.org/legal/epl-v10",)),
    ("epl", (), ("eclipse public license",), (), ("eclipse.org/legal",)),
    ("cddl-1.0", ("cddl 1 0", "cddl 1 1"), ("common development and distribution license",), (), ("opensource.org/licenses/cddl",)),
    ("cpl-1.0", ("cpl 1 0",), ("common public license",), (), ("opensource.org/licenses/cpl",)),
    ("eupl", ("eupl 1 1", "eupl 1 2"), ("european union public licence", "european union public license"), (), ("joinup.ec.europa.eu/software/page/eupl",)),
    ("artistic-2.0", ("artistic 2 0",), ("artistic license 2 0", "artistic license version 2 0"), (), ("opensource.org/licenses/artistic-2.0",)),
    ("artistic", ("artistic 1 0",), ("artistic license",), (), ("opensource.org/licenses/artistic-license",)),
    ("boost-1.0", ("bsl 1 0",), ("boost software license",), (), ("boost.org/license_1_0",)),
    ("busl-1.1", ("busl 1 1",), ("business source license",), (), ("mariadb.com/bsl11",)),
    ("sspl-1.0", ("sspl 1 0",), ("server side public license",), (), ("mongodb.com/licensing/server-side-public-license",)),
    ("elastic-2.0", ("elastic 2 0",), ("elastic license 2 0", "elastic license"), (), ("elastic.co/licensing/elastic-license",)),
    ("zlib", ("zlib",), ("zlib license", "zlib libpng license"), ("altered source versions must be plainly marked as such",), ("opensource.org/licenses/zlib",)),
    ("libpng", ("libpng", "libpng 2 0"), ("libpng license", "png reference library license"), (), ("libpng.org/pub/png/src/libpng-license",)),
    ("unlicense", ("unlicense",), ("the unlicense", "unlicense license"), ("this is free and unencumbered software released into the public domain",), ("unlicense.org",)),
    ("wtfpl", ("wtfpl",), ("do what the fuck you want to public license", "wtfpl license"), (), ("wtfpl.net",)),
    ("postgresql", ("postgresql",), ("postgresql license", "postgresql licence"), (), ("opensource.org/licenses/postgresql",)),
    ("python-2.0", ("python 2 0", "psf 2 0"), ("python software foundation license", "psf license"), (), ("python.org/psf/license", "docs.python.org/license")),
    ("php-3.01", ("php 3 0", "php 3 01"), ("php license",), (), ("php.net/license",)),
    ("openssl", ("openssl",), ("openssl license", "ssleay license"), (), ("openssl.org/source/license",)),
    ("ofl-1.1", ("ofl 1 0", "ofl 1 1"), ("sil open font license", "open font license"), (), ("scripts.sil.org/ofl", "openfontlicense.org")),
    ("odbl-1.0", ("odbl 1 0",), ("open database license", "open data commons open database license"), (), ("opendatacommons.org/licenses/odbl",)),
    ("odc-by-1.0", ("odc by 1 0",), ("open data commons attribution license",), (), ("opendatacommons.org/licenses/by",)),
    ("pddl-1.0", ("pddl 1 0",), ("public domain dedication and license",), (), ("opendatacommons.org/licenses/pddl",)),
    ("cc0-1.0", ("cc0 1 0",), ("cc0 1 0 universal", "creative commons zero"), ("to the extent possible under law the author has dedicated all copyright",), ("creativecommons.org/publicdomain/zero",)),
    ("cc-by-nc-nd", ("cc by nc nd 3 0", "cc by nc nd 4 0"), ("cc by nc nd", "attribution noncommercial noderivatives", "attribution noncommercial noderivs"), (), ("creativecommons.org/licenses/by-nc-nd",)),
    ("cc-by-nc-sa", ("cc by nc sa 3 0", "cc by nc sa 4 0"), ("cc by nc sa", "attribution noncommercial sharealike"), (), ("creativecommons.org/licenses/by-nc-sa",)),
    ("cc-by-nc", ("cc by nc 3 0", "cc by nc 4 0"), ("cc by nc", "creative commons attribution noncommercial"), (), ("creativecommons.org/licenses/by-nc",)),
    ("cc-by-nd", ("cc by nd 3 0", "cc by nd 4 0"), ("cc by nd", "creative commons attribution noderivatives"), (), ("creativecommons.org/licenses/by-nd",)),
    ("cc-by-sa", ("cc by sa 3 0", "cc by sa 4 0"), ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), (), ("creativecommons.org/licenses/by-sa",)),
    ("cc-by", ("cc by 3 0", "cc by 4 0"), ("cc by", "creative commons attribution"), (), ("creativecommons.org/licenses/by",)),
    ("public-domain", (), ("released into the public domain", "dedicated to the public domain", "placed in the public domain"), (), ("creativecommons.org/publicdomain/mark",)),
    ("proprietary", ("licenseref proprietary",), ("end user license agreement", "proprietary license", "commercial license agreement"), ("unauthorized copying of this file via any medium is strictly prohibited",), ()),
    ("all-rights-reserved", (), ("all rights reserved",), (), ()),
    ("ncsa", ("ncsa",), ("university of illinois ncsa open source license",), (), ("opensource.org/licenses/ncsa",)),
    ("ms-pl", ("ms pl",), ("microsoft public license",), (), ("opensource.org/licenses/ms-pl",)),
    ("ms-rl", ("ms rl",), ("microsoft reciprocal license",), (), ("opensource.org/licenses/ms-rl",)),
    ("upl-1.0", ("upl 1 0",), ("universal permissive license",), (), ("opensource.org/licenses/upl",)),
    ("llama", ("licenseref llama",), ("llama community license", "llama 2 community license", "llama 3 community license"), (), ()),
    ("openrail", ("licenseref openrail",), ("openrail license", "creativeml open rail m", "bigscience rail license"), (), ()),
)


#: label; keyword; pattern over lower-cased text. A blank stands for anything but letters and digits, ``~`` for that or nothing.
PATTERNS = (
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?: as published by the free software foundation)? (?:either )?v(?:ersion)?~3(?:~0)?"),
    ("agpl-3.0", "affero", r"licen[cs]ed under (?:the )?(?:gnu )?affero (?:gpl|general public licen[cs]e)"),
    ("gpl-3.0", "gpl", r"(?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl~v?~3"),
    ("gpl-3.0", "general", r"gnu general public licen[cs]e(?: as published by the free software foundation)? (?:either )?v(?:ersion)?~3(?:~0)?"),
    ("gpl-2.0", "gpl", r"(?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl~v?~2(?!~1)"),
    ("gpl-2.0", "general", r"gnu general public licen[cs]e(?: as published by the free software foundation)? (?:either )?v(?:ersion)?~2(?:~0)?(?!~1)"),
    ("gpl-2.0", "general", r"general public licen[cs]e v(?:ersion)?~2(?:~0)? only"),
    ("gpl", "general", r"under the terms of the gnu general public licen[cs]e(?! v(?:ersion)?~[123])"),
    ("gpl", "general", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[cs]e(?: as published by the free software foundation)? (?:either )?v(?:ersion)?~3"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[cs]e(?: as published by the free software foundation)? (?:either )?v(?:ersion)?~2~1"),
    ("lgpl-2.0", "library", r"gnu library general public licen[cs]e(?: as published by the free software foundation)? (?:either )?v(?:ersion)?~2(?!~1)"),
    ("lgpl", "lesser", r"under the terms of the gnu lesser general public licen[cs]e(?! v(?:ersion)?~[23])"),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("gfdl", "documentation", r"under the terms of the gnu free documentation licen[cs]e(?: v(?:ersion)?~1~[123])?"),
    ("apache-2.0", "apache", r"licen[cs]ed under (?:the )?apache licen[cs]e v(?:ersion)?~2(?:~0)?"),
    ("apache-2.0", "apache", r"(?:released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache~2(?:~0)? licen[cs]e"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e v(?:ersion)?~2(?:~0)?(?!~1)"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e v(?:ersion)?~1~1"),
    ("apache", "apache", r"this product includes software developed (?:by|at) the apache software foundation"),
    ("mit", "mit", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit(?:~x11)? licen[cs]e(?! server)"),
    ("mit", "software", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "warranty", r"the software is provided as is without warranty of any kind express or implied including but not limited to"),
    ("mit-0", "mit", r"(?:licen[cs]ed|released) under (?:the )?mit~0 licen[cs]e"),
    ("x11", "x11", r"(?:licen[cs]ed|released) under (?:the )?x11 licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:2|two) clause bsd licen[cs]e"),
    ("bsd-2-clause", "bsd", r"bsd~2~clause (?:simplified )?licen[cs]e"),
    ("bsd-3-clause", "bsd", r"(?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:3|three) clause bsd licen[cs]e"),
    ("bsd-3-clause", "bsd", r"bsd~3~clause (?:new |revised )?licen[cs]e"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "bsd", r"(?:use of this source code is governed by|licen[cs]ed under) a bsd~style licen[cs]e"),
    ("bsd", "redistributions", r"redistributions of source code must retain the (?:above )?copyright notice this list of conditions"),
    ("0bsd", "bsd", r"(?:bsd zero|zero~clause bsd|0~clause bsd) licen[cs]e"),
    ("isc", "isc", r"(?:licen[cs]ed|released|distributed) under (?:the )?isc licen[cs]e"),
    ("mpl-2.0", "mozilla", r"subject to the terms of the mozilla public licen[cs]e v(?:ersion)?~2(?:~0)?"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e v(?:ersion)?~2(?:~0)?"),
    ("mpl-1.1", "mozilla", r"subject to the mozilla public licen[cs]e v(?:ersion)?~1~1"),
    ("epl-2.0", "eclipse", r"(?:under the terms of the )?eclipse public licen[cs]e v(?:ersion)?~2(?:~0)?"),
    ("epl-1.0", "eclipse", r"(?:under the terms of the )?eclipse public licen[cs]e v(?:ersion)?~1(?:~0)?"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[cs]e(?: v(?:ersion)?~1~[01])?"),
    ("eupl", "european", r"european union public licen[cs]e v(?:ersion)?~1~[12]"),
    ("artistic-2.0", "artistic", r"(?:the )?artistic licen[cs]e v?(?:ersion )?~2(?:~0)?"),
    ("boost-1.0", "boost", r"(?:distributed|released) under the boost software licen[cs]e(?: v(?:ersion)?~1~0)?"),
    ("busl-1.1", "source", r"business source licen[cs]e(?: v?(?:ersion )?~1~1)?"),
    ("sspl-1.0", "server", r"server side public licen[cs]e(?: v(?:ersion)?~1)?"),
    ("elastic-2.0", "elastic", r"(?:licen[cs]ed|released) under (?:the )?elastic licen[cs]e(?: v?(?:ersion )?~2(?:~0)?)?"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "unlicense", r"(?:dedicated to the public domain|released) under (?:the )?unlicense"),
    ("python-2.0", "python", r"python software foundation licen[cs]e v(?:ersion)?~2"),
    ("ofl-1.1", "sil", r"(?:licen[cs]ed|released) under (?:the )?sil open font licen[cs]e(?: v(?:ersion)?~1~[01])?"),
    ("cc0-1.0", "cc0", r"cc0(?: v?~1~0)? public domain dedication"),
    ("cc-by-nc-nd", "noncommercial", r"creative commons attribution noncommercial no~?deriv(?:ative)?s(?: [234]~[05])? (?:international|unported|generic) licen[cs]e"),
    ("cc-by-nc-sa", "noncommercial", r"creative commons attribution noncommercial share~?alike(?: [234]~[05])? (?:international|unported|generic) licen[cs]e"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial(?: [234]~[05])? (?:international|unported|generic) licen[cs]e"),
    ("cc-by-sa", "alike", r"creative commons attribution share~?alike(?: [234]~[05])? (?:international|unported|generic) licen[cs]e"),
    ("cc-by", "attribution", r"creative commons attribution(?: [234]~[05])? (?:international|unported|generic) licen[cs]e"),
    ("public-domain", "domain", r"(?:this work|this file|this software) (?:is|has been) (?:hereby )?(?:placed|released) (?:in|into) the public domain"),
    ("proprietary", "confidential", r"(?:confidential and proprietary|proprietary and confidential)(?: information)? (?:of|all rights reserved) copyright"),
    ("all-rights-reserved", "reserved", r"(?:copyright )?all rights reserved(?! worldwide under)"),
    ("ms-pl", "microsoft", r"(?:licen[cs]ed|released) under (?:the )?microsoft public licen[cs]e"),
    ("llama", "llama", r"llama~[234](?:~[0-9])? community licen[cs]e(?: agreement)?"),
)
#: Tiers of rules: tags, license texts, addresses, titles and patterns.
TIERS = 4


def phrase(words: str) -> str:
    """Pattern for words in a row with anything but letters and digits between."""
    return EDGE_L + GAP.join(words.split()) + EDGE_R


def pattern(text: str) -> str:
    """Pattern for a text of :data:`PATTERNS`; a blank at the start of an optional part belongs to it."""
    return EDGE_L + text.replace("~?", "(?:" + GAP + ")?").replace("~", "(?:" + GAP + ")?").replace(" ", GAP) + EDGE_R


#: Words that many licenses share, so of little use as a keyword.
COMMON = frozenset("license licence public general version software the of or and to is in this use copy free open original new with without any for it not be domain".split())


def rarest(words: str) -> str:
    """The longest telling word of a phrase: a text without it cannot have the phrase."""
    return max(words.split(), key=lambda w: (w not in COMMON, len(w)))


def signatures() -> tuple[Signature, ...]:
    """All rules in their order: tags first, then license texts, addresses and titles; specific families before general ones."""
    out = []
    for tier, (column, weight) in enumerate(((1, 1.0), (3, 0.95), (4, 0.9), (2, 0.8))):
        for rank, family in enumerate(FAMILIES):
            for item in family[column]:
                if column == 1:
                    regex, key = phrase(f"spdx license identifier {item}"), "spdx"
                elif column == 4:
                    regex = EDGE_L + item.replace(".", r"\.").replace("/", r"/+") + EDGE_R
                    key = item.split("/")[0]
                else:
                    regex, key = phrase(item), rarest(item)
                out.append(Signature(family[0], key, regex, tier * 1000 + rank, weight))
    ranks = {family[0]: rank for rank, family in enumerate(FAMILIES)}
    out += [Signature(label, key, pattern(text), (TIERS - 1) * 1000 + ranks[label], 0.85) for label, key, text in PATTERNS]
    return tuple(out)
