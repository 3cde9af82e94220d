"""Personal data by fixed patterns and a semi-Markov conditional random field (operator 8).

A region of a text is cut into atoms (digit runs, letter runs, single marks). The model
scores whole candidate spans of atoms by features of the span as one piece, and dynamic
programming over segments of bounded length chooses boundaries and kinds jointly. It is
trained by conditional likelihood on regions that the fixed patterns have labelled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import zip_longest
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hubloom.llm import text as words
from hubloom.llm.tables import read_table, written

KINDS = ("email", "ip", "card", "phone")
EMAIL_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# A region holds a digit or an @; runs of marks that no span can cross part regions.
REGION = re.compile(r"[A-Za-z0-9._%+@()-]+(?:\x20[+(0-9][A-Za-z0-9._%+@()-]*)*")
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
WORD_BEFORE = re.compile(r"(\w+)\W*$")

MOST_DIGITS = {"card": 19, "phone": 15}
MAX_ATOMS = 24  # longest candidate span
WEIGHTS = 1 << 14
# Documents drawn for the fit, regions used of them, passes over those.
SAMPLE_DOCUMENTS = 20_000
SAMPLE_REGIONS = 1500
EPOCHS = 6
SEED = 8
# Log-odds by which an added span must beat leaving its atoms alone.
MARGIN = 2.0

PERSONAL = np.zeros(256, bool)
PERSONAL[[*range(0x30, 0x3A), 0x40]] = True

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def only_digits(piece: str) -> str:
    return "".join(c for c in piece if "0" <= c <= "9")


def small_parts(piece: str) -> bool:
    """Four numbers of at most 255, whatever zeros lead them."""
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in piece.split("."))


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Leftmost non-overlapping matches of each kind, and whether each one is valid."""
    at, done = text.find("@"), 0
    while at >= 0:
        left = at - (len(text[done:at]) - len(text[done:at].rstrip(EMAIL_LOCAL)))
        domain = EMAIL_DOMAIN.match(text, at) if left < at else None
        if domain:
            yield "email", left, domain.end(), True
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    for found in IP.finditer(text):
        yield "ip", found.start(), found.end(), small_parts(found.group())
    for found in CARD.finditer(text):
        digits = only_digits(found.group())
        yield "card", found.start(), found.end(), 13 <= len(digits) <= 19 and luhn(digits)
    for found in PHONE.finditer(text):
        yield "phone", found.start(), found.end(), 9 <= len(only_digits(found.group())) <= 15


def base_spans(text: str) -> list[Span]:
    return [(kind, start, end) for kind, start, end, valid in base_matches(text) if valid]


@dataclass
class Region:
    """Atoms of a stretch of text and their candidate spans."""

    start: int
    ends: list[int]  # end of each atom, from the region's start
    spans: list[tuple[int, int, str, np.ndarray]]  # first atom, last atom + 1, kind, features
    plain: list[np.ndarray]  # features of each atom left alone


def feature(*parts: object) -> int:
    return crc32("|".join(map(str, parts)).encode()) % WEIGHTS


def plausible(piece: str) -> list[str]:
    """Kinds that a span could be, by its outline alone."""
    kinds = []
    if "@" in piece:
        local, _, domain = piece.partition("@")
        return ["email"] if local and "." in domain.strip(".") and "@" not in domain else []
    if not (piece[0] in "+(" or piece[0].isdigit()) or not piece[-1].isdigit() or any(c.isalpha() for c in piece):
        return []
    digits = len(only_digits(piece))
    if piece.count(".") == 3 and not any(c in " +()-" for c in piece) and ".." not in piece:
        kinds.append("ip")
    if 13 <= digits <= 19 and not any(c in ".+()" for c in piece):
        kinds.append("card")
    if 9 <= digits <= 15 and not any(c in "%_" for c in piece):
        kinds.append("phone")
    return kinds


def outline(piece: str) -> str:
    """The span with digit and letter runs replaced by their lengths."""
    return ATOM.sub(lambda m: f"d{len(m[0])}" if m[0][0].isdigit() else "a" if m[0].isalpha() else m[0], piece)


def char_class(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    char = text[at]
    return "digit" if char.isdigit() else "letter" if char.isalpha() else "space" if char.isspace() else char


def span_features(kind: str, text: str, start: int, end: int, before: str) -> np.ndarray:
    piece = text[start:end]
    digits = only_digits(piece)
    facts = [("kind",), ("digits", len(digits)), ("left", char_class(text, start - 1)),
             ("right", char_class(text, end)), ("before", before), ("first", piece[0] if not piece[0].isalnum() else "x"),
             ("marks", "".join(sorted({c for c in piece if not c.isalnum()})))]
    if kind == "email":
        facts += [("domain", EMAIL_DOMAIN.fullmatch(piece[piece.index("@"):]) is not None),
                  ("local", piece[:piece.index("@")].strip(EMAIL_LOCAL) == "")]
    else:
        facts += [("outline", outline(piece)), ("tail", outline(piece)[-8:])]
    if kind == "ip":
        facts.append(("small", small_parts(piece)))
    if kind == "card":
        facts += [("luhn", luhn(digits)), ("issuer", digits[0])]
    return np.array([feature(kind, *fact) for fact in facts])


def region_of(text: str, start: int, end: int) -> Region:
    atoms = [(m.start() + start, m.end() + start) for m in ATOM.finditer(text[start:end])]
    word = WORD_BEFORE.search(text[max(0, start - 24):start])
    before = word[1].lower() if word else ""
    spans = []
    for i, (left, _) in enumerate(atoms):
        if not (text[left] in "+(" or text[left].isalnum()):
            continue
        for j in range(i + 1, min(i + MAX_ATOMS, len(atoms)) + 1):
            right = atoms[j - 1][1]
            if not text[right - 1].isalnum():
                continue
            for kind in plausible(text[left:right]):
                spans.append((i, j, kind, span_features(kind, text, left, right, before)))
    plain = [np.array([feature("plain", outline(text[a:b]))]) for a, b in atoms]
    return Region(start, [b - start for _, b in atoms], spans, plain)


def regions(text: str) -> Iterator[tuple[int, int]]:
    for found in REGION.finditer(text):
        piece = found.group()
        if "@" in piece or any("0" <= c <= "9" for c in piece):
            yield found.start(), found.end()


def log_add(a: float, b: float) -> float:
    return max(a, b) + np.log1p(np.exp(-abs(a - b))) if min(a, b) > -np.inf else max(a, b)


def region_gradient(region: Region, gold: set[tuple[int, int, str]], weights: np.ndarray) -> dict[int, float]:
    """Gradient of the region's log-likelihood: gold features less expected ones."""
    n = len(region.ends)
    segments = [(i, i + 1, None, f, float(weights[f].sum())) for i, f in enumerate(region.plain)]
    segments += [(i, j, kind, f, float(weights[f].sum())) for i, j, kind, f in region.spans]
    forward, backward = [-np.inf] * (n + 1), [-np.inf] * (n + 1)
    forward[0] = backward[n] = 0.0
    for i, j, _, _, value in sorted(segments, key=lambda s: s[1]):
        forward[j] = log_add(forward[j], forward[i] + value)
    for i, j, _, _, value in sorted(segments, key=lambda s: -s[0]):
        backward[i] = log_add(backward[i], backward[j] + value)
    covered = {k for i, j, _ in gold for k in range(i, j)}
    change: dict[int, float] = {}
    for i, j, kind, features, value in segments:
        chance = float(np.exp(forward[i] + value + backward[j] - forward[n]))
        true = (i, j, kind) in gold if kind else i not in covered
        if abs(true - chance) > 1e-4:
            for at in features.tolist():
                change[at] = change.get(at, 0.0) + true - chance
    return change


def fit(examples: list[tuple[str, int, int, list[Span]]], epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """Weights by Adagrad on regions (text, start, end, gold spans)."""
    weights, steps = np.zeros(WEIGHTS), np.full(WEIGHTS, 0.1)
    prepared = []
    for text, start, end, spans in examples:
        region = region_of(text, start, end)
        first = {0: 0, **{e: k + 1 for k, e in enumerate(region.ends)}}
        places = [(first.get(a - start), first.get(b - start), kind) for kind, a, b in spans]
        known = {(i, j, kind) for i, j, kind, _ in region.spans}
        if all(place in known for place in places):
            prepared.append((region, set(places)))
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for k in rng.permutation(len(prepared)):
            for at, value in region_gradient(*prepared[k], weights).items():
                value -= 1e-3 * weights[at]
                steps[at] += value * value
                weights[at] += 0.5 * value / np.sqrt(steps[at])
    return weights


def decode(text: str, start: int, end: int, weights: np.ndarray) -> list[Span]:
    """Best segmentation of a region into kinds and plain atoms; its spans that win clearly."""
    region = region_of(text, start, end)
    if not region.spans:
        return []
    n = len(region.ends)
    plain = np.concatenate([[0.0], np.cumsum([weights[f].sum() for f in region.plain])])
    best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
    by_end: dict[int, list] = {}
    for i, j, kind, features in region.spans:
        by_end.setdefault(j, []).append((i, kind, float(weights[features].sum())))
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1] + plain[j] - plain[j - 1], (j - 1, None, 0.0)
        for i, kind, value in by_end.get(j, []):
            if best[i] + value > best[j]:
                best[j], back[j] = best[i] + value, (i, kind, value - (plain[j] - plain[i]))
    found, j = [], n
    while j:
        i, kind, lead = back[j]
        if kind and lead >= MARGIN:
            found.append((kind, start + (region.ends[i - 1] if i else 0), start + region.ends[j - 1]))
        j = i
    return found[::-1]


def find_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base and those of the model that overlap no base span."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for start, end in regions(text):
        for kind, a, b in decode(text, start, end, weights):
            if all(b <= x or y <= a for x, y in taken if x < b):
                added.append((kind, a, b))
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return sorted(base, key=order), sorted(base + added, key=order)


def examples_of(text: str) -> Iterator[tuple[str, int, int, list[Span]]]:
    """Regions labelled by the base patterns, each with its surroundings as text of its own.

    Where a pattern matched more digits than its kind can have, there may be several spans in
    it; the truth isn't known and the region isn't used. Phone numbers come again without their prefix, so that the model knows them by their outline.
    """
    matches = list(base_matches(text))
    for start, end in regions(text):
        inside = [m for m in matches if m[1] < end and m[2] > start]
        valid = sorted((a, b, kind) for kind, a, b, good in inside if good)
        doubt = any(not good and len(only_digits(text[a:b])) > MOST_DIGITS.get(kind, 99) for kind, a, b, good in inside)
        apart = all(x[1] <= y[0] for x, y in zip(valid, valid[1:]))
        if doubt or not apart or any(a < start or b > end for a, b, _ in valid) or end - start > 400:
            continue
        left, right = max(0, start - 24), min(len(text), end + 8)
        yield text[left:right], start - left, end - left, [(kind, a - left, b - left) for a, b, kind in valid]
        for a, b, kind in valid:
            prefix = re.match(r"\+[0-9]{1,3}[ -]?", text[a:b])
            if kind == "phone" and prefix and len(valid) == 1 and a == start:
                rest = a + prefix.end()
                if len(only_digits(text[rest:b])) >= 9:
                    yield text[left:a] + text[rest:right], a - left, end - left - prefix.end(), \
                        [("phone", a - left, b - left - prefix.end())]


def train(docs: DataFrame, regions_used: int = SAMPLE_REGIONS) -> np.ndarray:
    """Fit on regions of at most `SAMPLE_DOCUMENTS` documents drawn by a hash of the id.

    At most `regions_used` distinct regions with spans are used, of each kind in turn, and as
    many without.
    Without documents or regions the weights are zero, and no span is added to the base.
    """
    order = F.xxhash64("of", F.lit(SEED))
    drawn = docs.select(F.col("doc_id").alias("of")).filter("of IS NOT NULL").orderBy(order, "of").limit(SAMPLE_DOCUMENTS)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn.distinct()), F.col("doc_id") == F.col("of"))

    def work(ids, texts):
        found = {"doc_id": [], "place": [], "text": [], "start": [], "end": [], "gold": []}
        for i in flagged(texts):
            for text, start, end, gold in examples_of(texts[i].as_py()):
                place = crc32(text.encode("utf-8", "surrogatepass"))
                for name, value in zip(found, (ids[i].as_py(), place, text, start, end,
                                               ",".join(f"{k}:{a}:{b}" for k, a, b in gold))):
                    found[name].append(value)
        yield pa.RecordBatch.from_pydict(found, schema=pa.schema(
            [("doc_id", pa.int64()), ("place", pa.int64()), ("text", pa.string()), ("start", pa.int32()),
             ("end", pa.int32()), ("gold", pa.string())]))

    sample = words.map_texts(rows, "doc_id", "text", "doc_id long, place long, text string, start int, end int, gold string", work)
    sample = written(sample.select("place", "text", "start", "end", "gold").distinct())
    first = lambda some: sample.filter(some).orderBy("place", "text", "start", "end", "gold").limit(regions_used).collect()
    by_kind = zip_longest(*[first(F.col("gold").contains(f"{kind}:")) for kind in KINDS])
    labelled = list(dict.fromkeys(row for rows in by_kind for row in rows if row))[:regions_used]
    examples = []
    for row in labelled + first(F.col("gold") == ""):
        spans = [part.split(":") for part in row["gold"].split(",") if part]
        examples.append((row["text"], row["start"], row["end"], [(k, int(a), int(b)) for k, a, b in spans]))
    return fit(examples)


def flagged(texts: pa.Array) -> np.ndarray:
    """Texts that hold a digit or an @."""
    data, offsets = words.buffers(texts)
    some = np.flatnonzero(np.diff(offsets))
    if not len(some):
        return some
    return some[np.logical_or.reduceat(PERSONAL[data], offsets[:-1][some])]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_personal(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Columns doc_id, base and spans (both kind:start:end, comma-joined) for each row.

    Offsets count code points, the end is exclusive. Null and empty texts have no spans.
    Repeated rows give the same; an empty table gives an empty result. Long runs of digits or
    letters are searched in linear time. Other columns are not looked at.
    """
    def work(ids, texts):
        base, every = [""] * len(ids), [""] * len(ids)
        for i in flagged(texts).tolist():
            base[i], every[i] = map(joined, find_spans(texts[i].as_py(), weights))
        yield pa.RecordBatch.from_arrays([ids, pa.array(base, pa.string()), pa.array(every, pa.string())],
                                         names=["doc_id", "base", "spans"])

    return words.map_texts(docs, "doc_id", "text", "doc_id long, base string, spans string", work)


def masked(text: str, weights: np.ndarray) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    pieces, done = [], 0
    for start, end, kind in sorted((a, b, kind) for kind, a, b in find_spans(text, weights)[1]):
        if start >= done:
            pieces += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*pieces, text[done:]])


def mask_personal(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """`docs` with personal data in text masked, and n_chars, where there is one, counted anew."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = names.index("text")
            texts = batch.column(place)
            changed = {i: masked(texts[i].as_py(), weights) for i in flagged(texts.fill_null("")).tolist()}
            if changed:
                values = texts.to_pylist()
                for i, value in changed.items():
                    values[i] = value
                columns = list(batch.columns)
                columns[place] = pa.array(values, texts.type)
                if "n_chars" in names and pa.types.is_integer(batch.column(names.index("n_chars")).type):
                    at = names.index("n_chars")
                    counts = batch.column(at).to_pylist()
                    for i, value in changed.items():
                        counts[i] = len(value)
                    columns[at] = pa.array(counts, batch.column(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = find_personal(docs, train(docs))
    counts = [F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")
