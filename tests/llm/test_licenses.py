import random
import re

import pytest
from pyspark.sql import functions as F

from hubloom.llm import licenses
from hubloom.llm.license_rules import BASE, SIGNATURES, needed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = licenses.all_rules()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_base(text):
    words = WORD.findall(lower(text))
    found = []
    for phrase, label in BASE.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    return len(words), sorted(found)


def texts():
    rng = random.Random(6)
    pieces = ["GNU", "General", "Public", "License", "apache", "license", "CC", "BY", "mit", "License,", "-", "xmit", "ünder", "İstanbul",
              "cc by cc", "licenses", "GNU general\npublic--LICENSE", "MIT License.", "the", "by", "version 2.0", "é", "CC-BY-NC 4.0"]
    made = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    return made + ["", None, "...", "Licensed under CC BY-NC 4.0.", "x" * 10000 + " MIT License"]


def test_base_matches_brute_force(spark):
    given = dict(enumerate(texts()))
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    for row in licenses.scan(docs).collect():
        n, places = brute_base(given[row["doc_id"]])
        assert row["n_words"] == n and row["n_base"] == len(places)
        assert (row["first_word"], row["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {label for _, label in places}
        assert row["base_labels"] == ",".join(sorted(base)) and base <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1


@pytest.mark.parametrize("text,labels", [
    ("Released under the MIT License.", ["mit"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["unknown", "gpl-3.0"]),
    ("SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause"]),
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    ("GNU Affero General Public License v3", ["agpl-3.0"]),
    ("https://creativecommons.org/licenses/by-sa/4.0/", ["cc-by-sa"]),
    ("the committee was transmitted by the admit license", []),
])
def test_priority_and_containment(text, labels):
    assert [d[2] for d in licenses.detections(text.lower().encode(), RULES)] == labels


def test_nothing_lies_within_another():
    text = (" ".join(t or "" for t in texts())).encode().lower()
    found = licenses.detections(text, RULES)
    for k, (a, b, *_) in enumerate(found):
        assert not any(c <= a and b <= d for j, (c, d, *_) in enumerate(found) if j != k and (c, d) != (a, b))


def test_gates_hide_no_match():
    """What all rules find without any gate is what they find with gates."""
    text = " ".join(t or "" for t in texts()).encode().lower()
    text += b" spdx-license-identifier: apache-2.0 eclipse public license 2.0 all rights reserved zlib/libpng license"
    free = {(m.start(), m.end()) for rules in RULES.by_keyword.values() for r in rules for m in r.pattern.finditer(text)}
    gated = {(m.start(), m.end()) for k, rules in RULES.by_keyword.items() if k in text for r in rules
             if all(p in text for p in r.needs) for m in r.pattern.finditer(text)}
    assert free == gated and free


def test_there_are_hundreds_of_rules():
    phrases = [p for *_, kinds in SIGNATURES for ps in kinds.values() for p in ps]
    assert len(phrases) >= 300 and len(set(phrases)) > 0.97 * len(phrases)
    assert all(needed(p) for p in phrases)


def shortest(phrase):
    """A text that the phrase matches: optional parts left out, the first of alternatives."""
    while "(" in phrase:
        phrase = re.sub(r"\(([^()|]*)[^()]*\)([?]?)", lambda m: "" if m[2] else m[1], phrase)
    phrase = re.sub(r"\[(.)[^\]]*\]", r"\1", phrase.replace("[a-z0-9]+", "x")).replace(" ?", " ")
    return re.sub(r"[a-z0-9]\?", "", phrase).replace("#", "4 0").strip()


def test_each_rule_is_tried_on_its_own_phrase():
    for label, _, kinds in SIGNATURES:
        for phrases in kinds.values():
            for phrase in phrases:
                text = shortest(phrase).encode()
                found = licenses.detections(text, RULES)
                assert any(a <= 0 and len(text) <= b for a, b, *_ in found), (label, phrase, text, found)


@pytest.mark.parametrize("name,label", [
    ("AGPL-3.0-only", "agpl-3.0"), ("MS-PL", "ms-pl"), ("BSL-1.0", "bsl-1.0"), ("OFL-1.1", "ofl-1.1"),
    ("LPPL-1.3c", "lppl"), ("BSD-4-Clause", "bsd-4-clause"), ("CDLA-Sharing-1.0", "cdla-sharing")])
def test_bare_spdx_lines(name, label):
    text = f"SPDX-License-Identifier: {name}".lower().encode()
    assert [d[2] for d in licenses.detections(text, RULES)] == [label]
