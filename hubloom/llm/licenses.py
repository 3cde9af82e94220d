"""Licences in whole texts by ordered signature rules (operator 2).

Hundreds of patterns are gated by keywords. Detections are accepted in the order of their
rules; one whose interval lies within an accepted one is suppressed, so that a version wins
over the family and a grant over the name in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hubloom.llm import text as words
from hubloom.llm.license_rules import BASE, Rule, compiled, rules_by_keyword
from hubloom.llm.tables import read_table

Detection = tuple[int, int, str, float]


@dataclass(frozen=True)
class Rules:
    by_keyword: dict[bytes, list[Rule]]
    base: list[tuple[str, bytes, re.Pattern[bytes]]]  # label, first word, pattern


def all_rules() -> Rules:
    return Rules(rules_by_keyword(),
                 [(label, phrase.split()[0].encode(), compiled(phrase)) for phrase, label in BASE.items()])


def detections(lowered: bytes, rules: Rules) -> list[Detection]:
    """Accepted detections (start, end, label, weight) in bytes, by start."""
    found = []
    held: dict[bytes, bool] = {}
    for keyword, gated in rules.by_keyword.items():
        if keyword not in lowered:
            continue
        for rule in gated:
            for part in rule.needs:
                if part not in held:
                    held[part] = part in lowered
                if not held[part]:
                    break
            else:
                found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(lowered)]
    accepted: list[Detection] = []
    for cluster in clusters(sorted(found, key=lambda f: f[:2])):
        kept: list[tuple[int, int, Rule]] = []
        for start, end, rule in sorted(cluster, key=lambda f: (f[2].place, f[0] - f[1], f[0])):
            if not any(a <= start and end <= b for a, b, _ in kept):
                kept.append((start, end, rule))
        accepted += [(start, end, rule.label, rule.weight) for start, end, rule in kept]
    return sorted(accepted)


def clusters(found: list[tuple[int, int, Rule]]) -> Iterator[list[tuple[int, int, Rule]]]:
    """Runs of overlapping detections; those of different runs can't contain each other."""
    run, reach = [], -1
    for one in found:
        if run and one[0] >= reach:
            yield run
            run = []
        run.append(one)
        reach = max(reach, one[1])
    if run:
        yield run


def base_places(lowered: bytes, rules: Rules) -> list[tuple[int, str]]:
    """Byte starts and labels of the places where a base phrase's words stand consecutively."""
    return [(m.start(), label) for label, keyword, pattern in rules.base if keyword in lowered
            for m in pattern.finditer(lowered)]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of letters, digits and non-ASCII after A-Z is lower-cased; whole texts are
    read. Spans are label:start:end in bytes of the accepted detections. The score is 1 less the
    product of what each label's best evidence leaves open, 0 without detections. Null and empty
    texts have no words, null places and empty labels. Repeated rows give the same; an empty
    table gives an empty result. Other columns are not looked at.
    """
    rules = all_rules()

    def work(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        data, offsets = words.buffers(texts)
        for first, last in words.steps(offsets):
            part = data[offsets[first]:offsets[last]]
            cuts = offsets[first:last + 1] - offsets[first]
            starts, _, bounds = words.spans(part, cuts, words.ALPHANUMERIC)
            rows = []
            for i in range(last - first):
                lowered = part[cuts[i]:cuts[i + 1]].tobytes().lower()
                base = base_places(lowered, rules)
                found = detections(lowered, rules)
                own = starts[bounds[i]:bounds[i + 1]] - cuts[i]
                at = sorted(int(np.searchsorted(own, place)) for place, _ in base)
                base_labels = {label for _, label in base}
                best: dict[str, float] = {}
                for _, _, label, weight in found:
                    best[label] = max(weight, best.get(label, 0.0))
                rows.append((int(bounds[i + 1] - bounds[i]), len(base), at[0] if at else None, at[-1] if at else None,
                             ",".join(sorted(base_labels)), ",".join(sorted(base_labels | set(best))),
                             round(1 - float(np.prod([1 - w for _, w in sorted(best.items())])), 6),
                             ",".join(f"{label}:{start}:{end}" for start, end, label, _ in found)))
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), KINDS)]
            yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), *columns], names=["doc_id", *NAMES])

    return words.map_texts(docs, key, text, SCHEMA, work)


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans string")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
