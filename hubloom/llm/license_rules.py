"""Signature rules for licences, in order of priority.

Patterns are written by hand over lower-cased text. A space stands for one or more marks or
white spaces between two words, `#` for a version number; both ends are word ends. Each rule
has a keyword that must occur in a text before its pattern is tried, a label, the kind of
evidence (which gives its weight) and its place in the order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Weight of a detection by the kind of evidence.
WEIGHTS = {"tag": 0.99, "text": 0.95, "grant": 0.9, "link": 0.85, "name": 0.7, "hint": 0.4}

# label: keyword, then by kind of evidence the patterns. Versions come before what has none.
SIGNATURES: list[tuple[str, str, dict[str, list[str]]]] = [
    ("agpl-3.0", "affero", {
        "tag": ["spdx license identifier agpl 3 0( only| or later)?"],
        "grant": ["licensed under the gnu affero general public license( v| version)? 3",
                  "terms of the gnu affero general public license as published by the free software foundation"],
        "name": ["gnu affero general public license( v| version)? 3( 0)?"]}),
    ("agpl-1.0", "affero", {
        "tag": ["spdx license identifier agpl 1 0( only| or later)?"],
        "name": ["affero general public license( v| version)? 1( 0)?"]}),
    ("agpl", "agpl", {
        "link": ["gnu org licenses agpl"],
        "name": ["agpl ?v?3", "gnu agpl"],
        "hint": ["agpl"]}),
    ("agpl", "affero", {"name": ["gnu affero general public license", "affero gpl"]}),
    ("lgpl-3.0", "lesser", {
        "grant": ["licensed under the gnu lesser general public license( v| version)? 3",
                  "gnu lesser general public license version 3 or( at your option)? any later version"],
        "name": ["gnu lesser general public license( v| version)? 3( 0)?"]}),
    ("lgpl-2.1", "lesser", {
        "grant": ["licensed under the gnu lesser general public license( v| version)? 2 1",
                  "gnu lesser general public license as published by the free software foundation either version 2 1"],
        "name": ["gnu lesser general public license( v| version)? 2 1"]}),
    ("lgpl-2.0", "library general", {
        "grant": ["licensed under the gnu library general public license( v| version)? 2"],
        "name": ["gnu library general public license"]}),
    ("lgpl", "lgpl", {
        "tag": ["spdx license identifier lgpl 3 0( only| or later)?", "spdx license identifier lgpl 2 1( only| or later)?",
                "spdx license identifier lgpl 2 0( only| or later)?"],
        "link": ["gnu org licenses lgpl", "gnu org copyleft lesser"],
        "name": ["lgpl ?v?3( 0)?", "lgpl ?v?2 1", "gnu lgpl"],
        "hint": ["lgpl"]}),
    ("lgpl", "lesser", {"name": ["gnu lesser general public license", "lesser gpl"]}),
    ("gpl-3.0", "general public", {
        "text": ["gnu general public license version 3 29 june 2007"],
        "grant": ["licensed under the gnu general public license( v| version)? 3( 0)?",
                  "under the terms of the gnu general public license( v| version)? 3",
                  "gnu general public license as published by the free software foundation either version 3"],
        "name": ["gnu general public license( v| version)? 3( 0)?"]}),
    ("gpl-2.0", "general public", {
        "text": ["gnu general public license version 2 june 1991"],
        "grant": ["licensed under the gnu general public license( v| version)? 2( 0)?",
                  "under the terms of the gnu general public license( v| version)? 2",
                  "gnu general public license as published by the free software foundation either version 2"],
        "name": ["gnu general public license( v| version)? 2( 0)?"]}),
    ("gpl-1.0", "general public", {
        "text": ["gnu general public license version 1 february 1989"],
        "name": ["gnu general public license( v| version)? 1( 0)?"]}),
    ("gpl", "general public", {
        "grant": ["licensed under the gnu general public license",
                  "redistribute it and or modify it under the terms of the gnu general public license"],
        "name": ["gnu general public license"]}),
    ("gpl", "gpl", {
        "tag": ["spdx license identifier gpl 3 0( only| or later)?", "spdx license identifier gpl 2 0( only| or later)?",
                "spdx license identifier gpl 1 0( only| or later)?"],
        "grant": ["licensed under( the)?( gnu)? gpl( ?v?#)?", "released under( the)?( gnu)? gpl( ?v?#)?",
                  "distributed under( the)?( gnu)? gpl( ?v?#)?"],
        "link": ["gnu org licenses gpl", "gnu org copyleft gpl"],
        "name": ["gnu gpl( ?v?#)?", "gpl ?v?3( 0)?", "gpl ?v?2( 0)?"]}),
    ("gfdl", "documentation license", {
        "tag": ["spdx license identifier gfdl 1 [123]"],
        "grant": ["licensed under the gnu free documentation license", "terms of the gnu free documentation license"],
        "name": ["gnu free documentation license( version 1 [123])?", "gnu fdl"]}),
    ("apache-2.0", "apache", {
        "tag": ["spdx license identifier apache 2 0"],
        "text": ["you may not use this file except in compliance with the license you may obtain a copy of the license at http s? ?www apache org"],
        "grant": ["licensed under the apache license version 2 0", "licensed under( the)? apache 2 0",
                  "released under the apache( software)? license( version)? 2( 0)?"],
        "link": ["apache org licenses license 2 0"],
        "name": ["apache license version 2 0", "apache license 2 0", "apache software license version 2 0", "apache 2 0 license"]}),
    ("apache-1.1", "apache", {
        "tag": ["spdx license identifier apache 1 1"],
        "link": ["apache org licenses license 1 1"],
        "name": ["apache software license version 1 1", "apache license version 1 1"]}),
    ("apache-1.0", "apache", {
        "tag": ["spdx license identifier apache 1 0"],
        "name": ["apache software license version 1 0", "apache license version 1 0"]}),
    ("apache", "apache", {
        "grant": ["licensed under the apache license", "released under the apache license"],
        "link": ["apache org licenses"],
        "name": ["apache license", "apache software license"]}),
    ("mit", "mit", {
        "tag": ["spdx license identifier mit"],
        "grant": ["(licensed|released|distributed|available|provided) under( the)?( terms of the)? mit licen[cs]e",
                  "subject to the( terms of the)? mit license"],
        "link": ["opensource org licenses mit"],
        "name": ["mit license", "mit licence", "mit expat license", "the mit license mit"]}),
    ("mit", "free of charge", {
        "text": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"]}),
    ("mit-0", "mit", {
        "tag": ["spdx license identifier mit 0"],
        "name": ["mit no attribution", "mit 0 license"]}),
    ("x11", "x11", {
        "tag": ["spdx license identifier x11"],
        "name": ["x11 license", "x consortium license", "mit x11 license"]}),
    ("isc", "isc", {
        "tag": ["spdx license identifier isc"],
        "grant": ["(licensed|released|distributed) under the isc license"],
        "link": ["opensource org licenses isc"],
        "name": ["isc license"]}),
    ("isc", "any purpose with or without fee", {
        "text": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]}),
    ("bsd-4-clause", "advertising", {
        "tag": ["spdx license identifier bsd 4 clause"],
        "text": ["all advertising materials mentioning features or use of this software must display"]}),
    ("bsd-3-clause", "bsd", {
        "tag": ["spdx license identifier bsd 3 clause"],
        "grant": ["licensed under the( 3 clause)? (new|modified|revised) bsd license"],
        "link": ["opensource org licenses bsd 3 clause"],
        "name": ["bsd 3 clause( new or revised)?( license)?", "(3|three) clause bsd license", "(new|modified|revised) bsd license"]}),
    ("bsd-3-clause", "endorse or promote", {
        "text": ["may be used to endorse or promote products derived from this software without specific prior written permission"]}),
    ("bsd-2-clause", "bsd", {
        "tag": ["spdx license identifier bsd 2 clause"],
        "link": ["opensource org licenses bsd 2 clause"],
        "name": ["bsd 2 clause( simplified)?( license)?", "(2|two) clause bsd license", "(simplified|freebsd) bsd license"]}),
    ("0bsd", "bsd", {
        "tag": ["spdx license identifier 0bsd"],
        "name": ["zero clause bsd( license)?", "bsd zero clause( license)?", "0bsd license"]}),
    ("bsd", "bsd", {
        "grant": ["(licensed|released|distributed) under( the| a)? bsd( style)? license"],
        "link": ["opensource org licenses bsd"],
        "name": ["bsd license", "bsd style license", "berkeley software distribution license"]}),
    ("bsd", "redistributions of source", {
        "text": ["redistribution and use in source and binary forms with or without modification are permitted",
                 "redistributions of source code must retain the above copyright notice"]}),
    ("mpl-2.0", "mozilla", {
        "text": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
        "grant": ["licensed under the mozilla public license( v| version)? 2( 0)?"],
        "link": ["mozilla org mpl 2 0", "mozilla org mpl"],
        "name": ["mozilla public license( v| version)? 2( 0)?"]}),
    ("mpl-1.1", "mozilla", {
        "grant": ["licensed under the mozilla public license( v| version)? 1 1"],
        "name": ["mozilla public license( v| version)? 1 1"]}),
    ("mpl-1.0", "mozilla", {"name": ["mozilla public license( v| version)? 1 0"]}),
    ("mpl", "mozilla", {"name": ["mozilla public license"]}),
    ("mpl", "mpl", {
        "tag": ["spdx license identifier mpl 2 0( no copyleft exception)?", "spdx license identifier mpl 1 1", "spdx license identifier mpl 1 0"],
        "name": ["mpl ?v?2 0", "mpl ?v?1 1"]}),
    ("epl-2.0", "eclipse", {
        "link": ["eclipse org legal epl ?v?2?0?", "eclipse org legal epl 2 0"],
        "name": ["eclipse public license( v| version)? 2( 0)?"]}),
    ("epl-1.0", "eclipse", {
        "link": ["eclipse org legal epl v10"],
        "name": ["eclipse public license( v| version)? 1( 0)?"]}),
    ("epl", "epl", {"tag": ["spdx license identifier epl 2 0", "spdx license identifier epl 1 0"]}),
    ("epl", "eclipse", {"name": ["eclipse public license"]}),
    ("edl-1.0", "eclipse", {"name": ["eclipse distribution license( v| version)?( 1 0)?"]}),
    ("cddl-1.1", "development and distribution", {"name": ["common development and distribution license( v| version)? 1 1"]}),
    ("cddl-1.0", "development and distribution", {"name": ["common development and distribution license( v| version)?( 1 0)?"]}),
    ("cddl", "cddl", {
        "tag": ["spdx license identifier cddl 1 [01]"],
        "name": ["cddl license", "cddl ?v?1 [01]"]}),
    ("cpl-1.0", "common public", {"tag": ["spdx license identifier cpl 1 0"], "name": ["common public license( v| version)?( 1 0)?"]}),
    ("cpal-1.0", "common public attribution", {"name": ["common public attribution license( version)?( 1 0)?"]}),
    ("cecill", "cecill", {
        "tag": ["spdx license identifier cecill (b|c|1 0|2 0|2 1)"],
        "name": ["cecill free software license agreement", "cecill ?(b|c)? license", "licence cecill"]}),
    ("eupl-1.2", "european union public", {
        "grant": ["licensed under the eupl( version 1 2)?", "licensed under the european union public licen[cs]e"],
        "name": ["european union public licen[cs]e( v| version)?( 1 2)?"]}),
    ("eupl", "eupl", {"tag": ["spdx license identifier eupl 1 [012]"], "name": ["eupl ?v?1 [12]"]}),
    ("ms-pl", "microsoft", {"tag": ["spdx license identifier ms pl"], "name": ["microsoft public license( ms pl)?"]}),
    ("ms-rl", "microsoft", {"tag": ["spdx license identifier ms rl"], "name": ["microsoft reciprocal license( ms rl)?"]}),
    ("artistic-2.0", "artistic", {
        "tag": ["spdx license identifier artistic 2 0"],
        "link": ["opensource org licenses artistic license 2 0"],
        "name": ["artistic license( v| version)? 2( 0)?"]}),
    ("artistic-1.0", "artistic", {
        "tag": ["spdx license identifier artistic 1 0"],
        "name": ["artistic license( v| version)? 1( 0)?", "perl artistic license"]}),
    ("artistic", "artistic", {"grant": ["same terms as perl itself"], "name": ["the artistic license"]}),
    ("zlib", "zlib", {
        "tag": ["spdx license identifier zlib"],
        "name": ["zlib license", "zlib libpng license", "zlib licence"]}),
    ("zlib", "as is without any express", {
        "text": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable"]}),
    ("libpng", "libpng", {"tag": ["spdx license identifier libpng( 2 0)?"], "name": ["libpng license", "png reference library license"]}),
    ("bsl-1.0", "boost", {
        "tag": ["spdx license identifier bsl 1 0"],
        "grant": ["distributed under the boost software license( version)?( 1 0)?"],
        "link": ["boost org license 1 0"],
        "name": ["boost software license( version)?( 1 0)?"]}),
    ("busl-1.1", "business source", {"tag": ["spdx license identifier busl 1 1"], "name": ["business source license( 1 1)?"]}),
    ("sspl-1.0", "server side", {"tag": ["spdx license identifier sspl 1 0"], "name": ["server side public license( v| version)?( 1)?"]}),
    ("elastic-2.0", "elastic", {"tag": ["spdx license identifier elastic 2 0"], "name": ["elastic license( v| version)?( 2 0| 2)?"]}),
    ("unlicense", "unlicense", {
        "tag": ["spdx license identifier unlicense"],
        "link": ["unlicense org"],
        "name": ["the unlicense"]}),
    ("unlicense", "public domain", {
        "text": ["this is free and unencumbered software released into the public domain"]}),
    ("wtfpl", "wtfpl", {"tag": ["spdx license identifier wtfpl"], "name": ["wtfpl license", "wtfpl version 2"]}),
    ("beerware", "beer", {"tag": ["spdx license identifier beerware"], "name": ["the beer ware license", "beerware license"]}),
    ("postgresql", "postgresql", {"tag": ["spdx license identifier postgresql"], "name": ["postgresql licen[cs]e"]}),
    ("python-2.0", "python", {
        "tag": ["spdx license identifier (python|psf) 2 0"],
        "name": ["python software foundation license( version 2)?", "psf license agreement( for python)?"]}),
    ("php-3.01", "php", {"tag": ["spdx license identifier php 3 01?"], "link": ["php net license 3 01"],
                         "name": ["php license( v| version)? 3( 0| 01)?", "the php license"]}),
    ("ruby", "ruby", {"tag": ["spdx license identifier ruby"], "name": ["the ruby license", "same license as ruby"]}),
    ("openssl", "openssl", {"tag": ["spdx license identifier openssl"], "name": ["openssl license", "openssl ssleay license"]}),
    ("curl", "curl", {"tag": ["spdx license identifier curl"], "name": ["the curl license"]}),
    ("icu", "icu", {"tag": ["spdx license identifier icu"], "name": ["icu license"]}),
    ("unicode", "unicode", {"tag": ["spdx license identifier unicode (dfs 2015|dfs 2016|3 0|tou)"],
                            "name": ["unicode license agreement", "unicode license v3"]}),
    ("ntp", "ntp", {"tag": ["spdx license identifier ntp"], "name": ["ntp license"]}),
    ("ncsa", "ncsa", {"tag": ["spdx license identifier ncsa"],
                      "name": ["university of illinois ncsa open source license", "ncsa open source license"]}),
    ("osl-3.0", "open software license", {"tag": ["spdx license identifier osl 3 0"], "name": ["open software license( v| version)?( 3 0)?"]}),
    ("afl-3.0", "academic free", {"tag": ["spdx license identifier afl 3 0"], "name": ["academic free license( v| version)?( 3 0| 2 1)?"]}),
    ("qpl-1.0", "q public", {"name": ["q public license( version)?( 1 0)?"]}),
    ("ipl-1.0", "ibm public", {"name": ["ibm public license( version)?( 1 0)?"]}),
    ("apsl-2.0", "apple public", {"name": ["apple public source license( version)?( 2 0| 1 2)?"]}),
    ("upl-1.0", "universal permissive", {"tag": ["spdx license identifier upl 1 0"], "name": ["universal permissive license( v| version)?( 1 0)?"]}),
    ("bluebook", "blue oak", {"tag": ["spdx license identifier blueoak 1 0 0"], "name": ["blue oak model license( version)?( 1 0 0)?"]}),
    ("mulan-2.0", "mulan", {"tag": ["spdx license identifier mulanpsl 2 0"], "name": ["mulan (psl|permissive software license)( v| version)?( ?v?2)?"]}),
    ("vim", "vim", {"tag": ["spdx license identifier vim"], "name": ["the vim license"]}),
    ("w3c", "w3c", {"tag": ["spdx license identifier w3c"], "name": ["w3c software( notice)?( and)?( document)? license"]}),
    ("ofl-1.1", "open font", {
        "tag": ["spdx license identifier ofl 1 1( rfn| no rfn)?"],
        "grant": ["licensed under the sil open font license( version)?( 1 1)?"],
        "link": ["scripts sil org ofl", "openfontlicense org"],
        "name": ["sil open font license( version)?( 1 1)?"]}),
    ("lppl", "latex project", {"tag": ["spdx license identifier lppl 1 3[ac]?"], "name": ["latex project public license( version)?( 1 3[abc]?)?"]}),
    ("cc0-1.0", "cc0", {
        "tag": ["spdx license identifier cc0 1 0"],
        "grant": ["dedicated to the public domain under cc0", "released under( the)? cc0( 1 0)?"],
        "link": ["creativecommons org publicdomain zero 1 0"],
        "name": ["cc0 1 0 universal", "cc0 1 0", "cc0 license"]}),
    ("cc-by-nc-nd", "cc by", {
        "tag": ["spdx license identifier cc by nc nd #"],
        "grant": ["licensed under( a| the)? cc by nc nd( #)?"],
        "name": ["cc by nc nd( #)?( international)?"]}),
    ("cc-by-nc-sa", "cc by", {
        "tag": ["spdx license identifier cc by nc sa #"],
        "grant": ["licensed under( a| the)? cc by nc sa( #)?"],
        "name": ["cc by nc sa( #)?( international)?"]}),
    ("cc-by-nc", "cc by", {
        "tag": ["spdx license identifier cc by nc #"],
        "grant": ["licensed under( a| the)? cc by nc( #)?"],
        "name": ["cc by nc( #)?( international)?"]}),
    ("cc-by-nd", "cc by", {
        "tag": ["spdx license identifier cc by nd #"],
        "grant": ["licensed under( a| the)? cc by nd( #)?"],
        "name": ["cc by nd( #)?( international)?"]}),
    ("cc-by-sa", "cc by", {
        "tag": ["spdx license identifier cc by sa #"],
        "grant": ["licensed under( a| the)? cc by sa( #)?"],
        "name": ["cc by sa( #)?( international)?"]}),
    ("cc-by", "cc by", {
        "tag": ["spdx license identifier cc by #"],
        "grant": ["licensed under( a| the)? cc by( #)?"],
        "name": ["cc by( #)?( international)?"]}),
    ("cc-by-nc-nd", "creative", {
        "link": ["creativecommons org licenses by nc nd( #)?"],
        "name": ["creative commons attribution non ?commercial no ?deriv(ative)?s( #)?( international)?( license)?"]}),
    ("cc-by-nc-sa", "creative", {
        "link": ["creativecommons org licenses by nc sa( #)?"],
        "name": ["creative commons attribution non ?commercial share ?alike( #)?( international)?( license)?"]}),
    ("cc-by-nc", "creative", {
        "link": ["creativecommons org licenses by nc( #)?"],
        "name": ["creative commons attribution non ?commercial( #)?( international)?( license)?"]}),
    ("cc-by-nd", "creative", {
        "link": ["creativecommons org licenses by nd( #)?"],
        "name": ["creative commons attribution no ?deriv(ative)?s( #)?( international)?( license)?"]}),
    ("cc-by-sa", "creative", {
        "link": ["creativecommons org licenses by sa( #)?"],
        "name": ["creative commons attribution share ?alike( #)?( international)?( license)?"]}),
    ("cc-by", "creative", {
        "link": ["creativecommons org licenses by( #)?"],
        "name": ["creative commons attribution( #)?( international)?( license)?"]}),
    ("cc-pd", "public domain mark", {"name": ["public domain mark( 1 0)?"]}),
    ("cc", "creative", {"name": ["creative commons( license)?"], "link": ["creativecommons org licenses"]}),
    ("odbl-1.0", "open database", {"tag": ["spdx license identifier odbl 1 0"], "link": ["opendatacommons org licenses odbl"],
                                   "name": ["open (data commons open )?database license( odbl)?( v1 0)?"]}),
    ("odc-by", "open data commons", {"tag": ["spdx license identifier odc by 1 0"], "name": ["open data commons attribution license( v1 0)?"]}),
    ("pddl-1.0", "public domain dedication", {"tag": ["spdx license identifier pddl 1 0"],
                                             "name": ["(open data commons )?public domain dedication and license( v?1 0)?"]}),
    ("cdla-permissive", "community data", {"tag": ["spdx license identifier cdla permissive [12] 0"],
                                           "name": ["community data license agreement permissive( version)?( [12] 0)?"]}),
    ("cdla-sharing", "community data", {"tag": ["spdx license identifier cdla sharing 1 0"],
                                        "name": ["community data license agreement sharing( version)?( 1 0)?"]}),
    ("ogl-uk-3.0", "open government", {"link": ["nationalarchives gov uk doc open government licence"],
                                       "name": ["open government licence( v3 0| version 3 0)?"]}),
    ("openrail", "rail", {"name": ["open ?rail( m)? license", "responsible ai license", "bigscience rail license( v1 0)?"]}),
    ("llama", "community license", {"name": ["llama [23]( [0-9])? community license( agreement)?"]}),
    ("public-domain", "public domain", {
        "grant": ["(released|placed|dedicated|put) (in|into|to) the public domain", "this work is in the public domain"],
        "name": ["public domain dedication"],
        "hint": ["in the public domain"]}),
    ("proprietary", "rights reserved", {"hint": ["all rights reserved"]}),
    ("proprietary", "proprietary", {"name": ["proprietary and confidential", "confidential and proprietary"]}),
    ("unknown", "licen", {
        "hint": ["(this|the) (work|software|file|document|project|program) is licen[cs]ed under", "spdx license identifier [a-z0-9]+",
                 "see the license for the specific language governing permissions", "end user license agreement"]}),
]

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

MARKS = rb"[^0-9a-z\x80-\xff]+"


@dataclass(frozen=True)
class Rule:
    place: int  # smaller goes first
    label: str
    weight: float
    needs: tuple[bytes, ...]  # parts of words that every match holds, the longest first
    pattern: re.Pattern[bytes]


def compiled(phrase: str) -> re.Pattern[bytes]:
    """A phrase as a pattern over lower-cased UTF-8: spaces, also optional ones, are marks."""
    phrase = phrase.replace("( v| version)? ", "( version)?( v ?| )")  # also v3 and version v3
    body = phrase.replace("#", "[0-9]+( [0-9]+)?").encode()
    body = body.replace(b" ?", b"(?:" + MARKS + b")?").replace(b" ", MARKS)
    return re.compile(rb"(?<![0-9a-z\x80-\xff])" + body + rb"(?![0-9a-z\x80-\xff])")


def needed(phrase: str) -> tuple[bytes, ...]:
    """What every match of a phrase holds: its words outside of groups, less optional ends."""
    while "(" in phrase:
        phrase = re.sub(r"\([^()]*\)[?]?", " # ", phrase)
    parts = set()
    for token in phrase.replace(" ?", " ").split():
        part = re.match(r"[a-z0-9]*", token)[0]
        if token[len(part):].startswith("?"):
            part = part[:-1]
        if len(part) > 1:
            parts.add(part.encode())
    return tuple(sorted(parts, key=lambda part: (-len(part), part)))


def rules_by_keyword() -> dict[bytes, list[Rule]]:
    found: dict[bytes, list[Rule]] = {}
    place = 0
    for label, keyword, kinds in SIGNATURES:
        for kind, phrases in kinds.items():
            for phrase in phrases:
                # The family's keyword if the pattern must hold it, else a part that it must.
                needs = needed(phrase)
                gate = next((part for word in keyword.split() for part in needs if part == word.encode()), needs[0])
                found.setdefault(gate, []).append(Rule(place, label, WEIGHTS[kind], needs, compiled(phrase)))
                place += 1
    return found
