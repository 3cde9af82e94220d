"""Quality by weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer (operator 4).

Each labeller votes good, bad or nothing on simple facts of the whole text. The votes of all
documents are counted by pattern; expectation-maximisation estimates how each labeller votes on
good and on bad documents, and so the chance that a pattern is good. A linear scorer over hashed
words, hashed word shapes and levels of the facts learns these chances.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hubloom.llm import text as words
from hubloom.llm.tables import read_table, written

BAD, GOOD, NONE = 0, 1, 2
SAMPLE_PER_SIDE = 3000  # documents that the scorer learns from, likely good and likely bad
SAMPLE_WORDS = 6_000_000  # most words of all these, whole texts: bounds the memory of the task that fits
ROUNDS = 5000  # most rounds of expectation-maximisation
WORD_BITS = 13
EPOCHS = 8
SEED = 4
KEPT = 0.5

# Frequent short words of the languages that the labellers know; fixed values.
COMMON = """the of and to in is that it was for on as with be by at this are from or an have not they which
der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es werden aus
de la le les et des en un une du que qui dans est pour par sur pas au avec
el los las y del se con una su al lo como más pero sus""".split()

FACTS = ("words", "symbols", "capitals", "common", "adjacent", "distinct", "sentence", "lines", "length", "marked")


def byte_set(chars: str) -> np.ndarray:
    member = np.zeros(256, bool)
    member[list(chars.encode())] = True
    return member


SYMBOLS = byte_set("#$%&*|<>{}[]^~=_\\/@+")
UPPER, LOWER = byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_set("abcdefghijklmnopqrstuvwxyz")
ENDS, DIGITS = byte_set(".!?"), byte_set("0123456789")
NOT_LINE_END = ~byte_set("\n\r")


def common_hashes() -> np.ndarray:
    data, offsets = words.buffers(pa.array(COMMON))
    return np.sort(words.word_hashes(data, offsets[:-1], offsets[1:]))


@dataclass
class Batch:
    """What labellers and scorer see of a range of texts."""

    facts: np.ndarray  # by text: a column for each of FACTS
    buckets: np.ndarray  # of each word
    shapes: np.ndarray  # of each word
    bounds: np.ndarray  # words before each text


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def read_batch(data: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> Batch:
    starts, ends, bounds = words.spans(data, offsets, words.NOT_SPACE)
    plain_starts, plain_ends, plain_bounds = words.spans(data, offsets, words.ALPHANUMERIC)
    hashes = words.word_hashes(data, starts, ends)
    plain = words.word_hashes(data, plain_starts, plain_ends)
    n, n_plain = np.diff(bounds), np.diff(plain_bounds)
    marks = sums(words.NOT_SPACE[data], offsets)
    upper, lower = sums(UPPER[data], offsets), sums(LOWER[data], offsets)
    same = np.zeros(len(plain), bool)
    same[1:] = plain[1:] == plain[:-1]
    same[plain_bounds[:-1][n_plain > 0]] = False
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(bounds[:-1], bounds[1:])], float)
    line_starts, line_ends, line_bounds = words.spans(data, offsets, NOT_LINE_END)
    lines = words.word_hashes(data, line_starts, line_ends, lower=False)
    n_lines = np.diff(line_bounds)
    line_kinds = np.array([len(np.unique(lines[a:b])) for a, b in zip(line_bounds[:-1], line_bounds[1:])], float)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    before = data[np.maximum(ends - 2, 0)] if len(ends) else last
    long = ends - starts > 1
    marked = (SYMBOLS[last] | (ENDS[last] & ENDS[before] & long))
    place = np.searchsorted(common, plain)
    known = common[np.minimum(place, len(common) - 1)] == plain
    facts = np.stack([
        n, share(sums(SYMBOLS[data], offsets), marks), share(upper, upper + lower),
        share(sums(known, plain_bounds), n_plain), share(sums(same, plain_bounds), n_plain),
        share(distinct, n), share(n, sums(ENDS[last], bounds)), share(n_lines - line_kinds, n_lines),
        share(marks, n), share(sums(marked, bounds), n)], axis=1).astype(float)
    first = data[starts] if len(starts) else last
    shapes = kind_of(first) * 8 * 9 + kind_of(last) * 9 + np.minimum(ends - starts, 8)
    return Batch(facts, (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), shapes, bounds)


def kind_of(chars: np.ndarray) -> np.ndarray:
    kinds = np.full(256, 7, np.int64)
    for k, member in enumerate((UPPER, LOWER, DIGITS, SYMBOLS, ENDS, byte_set(",;:"), np.arange(256) >= 128)):
        kinds[member] = k
    return kinds[chars]


SHAPES = 8 * 8 * 9


def batches(texts: pa.Array) -> Iterator[tuple[int, int, Batch]]:
    data, offsets = words.buffers(texts)
    common = common_hashes()
    for first, last in words.steps(offsets):
        yield first, last, read_batch(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], common)


def votes(facts: np.ndarray) -> np.ndarray:
    """A vote of each labeller on each text, a column for each labeller."""
    f = {name: facts[:, k] for k, name in enumerate(FACTS)}
    some = f["words"] >= 10

    def vote(bad, good):
        return np.where(bad, BAD, np.where(good, GOOD, NONE))

    return np.stack([
        vote(f["words"] < 1, f["words"] > 40),
        vote(f["symbols"] > 0.06, f["symbols"] < 0.01),
        vote(some & (f["capitals"] > 0.4), f["capitals"] < 0.15),
        vote(some & (f["common"] < 0.04), some & (f["common"] > 0.12)),
        vote(some & (f["adjacent"] > 0.2), some & (f["adjacent"] < 0.05)),
        vote(some & (f["distinct"] < 0.08), some & (f["distinct"] > 0.3)),
        vote(some & (f["sentence"] > 80), some & (f["sentence"] > 3) & (f["sentence"] < 40)),
        vote(f["lines"] > 0.4, f["lines"] < 0.1),
        vote(some & ((f["length"] > 14) | (f["length"] < 2.5)), some & (f["length"] > 3.5) & (f["length"] < 9)),
        vote(some & (f["marked"] > 0.15), some & (f["marked"] < 0.03)),
    ], axis=1)


LABELLERS = 10
POWERS = 3 ** np.arange(LABELLERS)


def pattern_chances(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray]:
    """Chance that each vote pattern's documents are good, and how labellers vote by class.

    Expectation-maximisation over patterns weighted by their documents. Labellers are taken to
    be independent within a class, and to say nothing by not voting; pseudo-counts say that they
    are seldom wrong on good documents. Ends when no chance moves by 1e-6; a warning says if
    `rounds` weren't enough for that.
    """
    cast = patterns[:, None] // POWERS % 3
    voted = cast != NONE
    prior = np.zeros((2, 2))
    prior[GOOD, [BAD, GOOD]] = 0.2, 20
    prior[BAD, [BAD, GOOD]] = 6, 10
    table = np.broadcast_to((prior / prior.sum(axis=1, keepdims=True))[:, None, :], (2, LABELLERS, 2))
    good_share = 0.85
    chances = np.zeros(len(patterns))
    for _ in range(rounds):
        logs = (np.log(table[:, np.arange(LABELLERS), np.where(voted, cast, 0)]) * voted).sum(axis=2)
        odds = logs[GOOD] - logs[BAD] + np.log(good_share / (1 - good_share))
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        weights = np.stack([counts * (1 - new), counts * new])
        table = np.zeros((2, LABELLERS, 2))
        for value in (BAD, GOOD):
            table[:, :, value] = weights @ (cast == value) + prior[:, value][:, None]
        table /= table.sum(axis=2, keepdims=True)
        good_share = (weights[GOOD].sum() + 8.5) / (counts.sum() + 10)
        moved, chances = np.abs(new - chances).max(initial=0), new
        if moved < 1e-6:
            break
    else:
        warnings.warn(f"expectation-maximisation has not settled in {rounds} rounds", RuntimeWarning)
    return dict(zip(patterns.tolist(), np.round(chances, 9).tolist())), table


@dataclass
class Scorer:
    words: np.ndarray
    shapes: np.ndarray
    levels: np.ndarray
    intercept: float
    edges: np.ndarray  # of the levels of each fact

    def level_at(self, facts: np.ndarray) -> np.ndarray:
        found = [np.searchsorted(self.edges[k], facts[:, k]) for k in range(facts.shape[1])]
        return np.stack(found, axis=1) + np.arange(facts.shape[1]) * (self.edges.shape[1] + 1)

    def score(self, batch: Batch) -> np.ndarray:
        n = np.diff(batch.bounds)
        raw = share(sums(self.words[batch.buckets], batch.bounds), n)
        raw += share(sums(self.shapes[batch.shapes], batch.bounds), n)
        raw += self.levels[self.level_at(batch.facts)].sum(axis=1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], chances: np.ndarray, seed: int = SEED) -> Scorer:
    """Logistic fit of rows (buckets, shapes, facts) to chances, by Adagrad."""
    facts = np.stack([row[2] for row in rows]) if rows else np.zeros((1, len(FACTS)))
    edges = np.quantile(facts, np.linspace(0.1, 0.9, 9), axis=0).T
    scorer = Scorer(np.zeros(1 << WORD_BITS), np.zeros(SHAPES), np.zeros(len(FACTS) * (edges.shape[1] + 1)), 0.0, edges)
    if not rows:
        return scorer
    levels = scorer.level_at(facts)
    steps = [np.full(len(w), 1e-3) for w in (scorer.words, scorer.shapes, scorer.levels)]
    step, rng = 1e-3, np.random.Generator(np.random.PCG64(seed))
    parts = [(np.unique(b, return_counts=True), np.unique(s, return_counts=True), max(len(b), 1)) for b, s, _ in rows]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            (at, times), (shape_at, shape_times), n = parts[i]
            raw = scorer.words[at] @ times / n + scorer.shapes[shape_at] @ shape_times / n
            raw += scorer.levels[levels[i]].sum() + scorer.intercept
            error = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - chances[i]
            for weights, total, places, grad in (
                    (scorer.words, steps[0], at, error * times / n),
                    (scorer.shapes, steps[1], shape_at, error * shape_times / n),
                    (scorer.levels, steps[2], levels[i], np.full(len(FACTS), error))):
                total[places] += grad ** 2
                weights[places] -= 0.1 * grad / np.sqrt(total[places])
            step += error ** 2
            scorer.intercept -= 0.1 * error / np.sqrt(step)
    return scorer


def packed(scorer: Scorer) -> bytes:
    out = BytesIO()
    np.savez(out, words=scorer.words, shapes=scorer.shapes, levels=scorer.levels, intercept=scorer.intercept, edges=scorer.edges)
    return out.getvalue()


def unpacked(data: bytes) -> Scorer:
    found = np.load(BytesIO(data))
    return Scorer(found["words"], found["shapes"], found["levels"], float(found["intercept"]), found["edges"])


def train(docs: DataFrame, per_side: int = SAMPLE_PER_SIDE, most_words: int = SAMPLE_WORDS) -> tuple[dict[int, float], Scorer]:
    """Vote patterns of all documents, their chances, and a scorer fitted to a bounded sample.

    The patterns number at most 3 to the power of the labellers, whatever the input. The sample
    are `per_side` documents each of likely good and likely bad ones, drawn by a hash of the id
    (rows without an id take part in the counts only); texts are used whole, in the order of the
    draw until `most_words` are reached. One task fits on it, the driver sees the scorer only.
    """
    def vote_work(ids, texts):
        for first, last, batch in batches(texts):
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, last - first), pa.array((votes(batch.facts) @ POWERS).astype(np.int32))],
                names=["doc_id", "pattern"])

    voted = written(words.map_texts(docs, "doc_id", "text", "doc_id long, pattern int", vote_work))
    counted = sorted(tuple(r) for r in voted.groupBy("pattern").count().collect())
    patterns = np.array([p for p, _ in counted], np.int64)
    chances, _ = pattern_chances(patterns, np.array([n for _, n in counted], float))
    bad = [p for p, chance in chances.items() if chance < KEPT]
    order = F.xxhash64("doc_id", F.lit(SEED))
    named = voted.filter("doc_id IS NOT NULL")
    sides = [named.filter(side).orderBy(order, "doc_id").limit(per_side)
             for side in (F.col("pattern").isin(bad), ~F.col("pattern").isin(bad))]
    chosen = sides[0].unionByName(sides[1]).select(F.col("doc_id").alias("of")).distinct()

    def sample_work(ids, texts):
        for first, last, batch in batches(texts):
            at = pa.array(batch.bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                ids.slice(first, last - first), pa.array((votes(batch.facts) @ POWERS).astype(np.int32)),
                pa.ListArray.from_arrays(at, pa.array(batch.buckets.astype(np.int32))),
                pa.ListArray.from_arrays(at, pa.array(batch.shapes.astype(np.int32))),
                pa.array(list(batch.facts), pa.list_(pa.float64()))],
                names=["doc_id", "pattern", "buckets", "shapes", "facts"])

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used = [], 0
        for batch in batches:
            lists = [batch.column(c) for c in ("buckets", "shapes", "facts")]
            for k, (doc_id, pattern) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("pattern").to_pylist())):
                buckets, shapes, facts = (np.array(x[k].values) for x in lists)
                if used + len(buckets) <= most_words:
                    used += len(buckets)
                    held.append((doc_id, pattern, buckets, shapes, facts.astype(float)))
        held.sort(key=lambda r: r[:2])
        scorer = fit([r[2:] for r in held], np.array([chances[r[1]] for r in held]))
        yield pa.RecordBatch.from_arrays([pa.array([packed(scorer)], pa.binary())], names=["scorer"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    sample = words.map_texts(
        rows, "doc_id", "text",
        "doc_id long, pattern int, buckets array<int>, shapes array<int>, facts array<double>", sample_work)
    found = (sample.repartition(1).sortWithinPartitions(order, "doc_id", "pattern")
             .mapInArrow(fit_all, "scorer binary").collect())
    return chances, unpacked(bytes(found[0]["scorer"])) if found else fit([], np.zeros(0))


def score_documents(docs: DataFrame, chances: dict[int, float], scorer: Scorer) -> DataFrame:
    """Columns doc_id, n_votes, posterior, score (chance to be good) and kept for each row.

    Whole texts are read. Null and empty texts are voted on as texts of no words. Repeated rows
    give the same; an empty table gives an empty result. Other columns are not looked at.
    """
    def work(ids, texts):
        for first, last, batch in batches(texts):
            cast = votes(batch.facts)
            posterior = [chances.get(p, 0.5) for p in (cast @ POWERS).tolist()]
            scores = np.round(scorer.score(batch), 6)
            yield pa.RecordBatch.from_arrays([
                ids.slice(first, last - first), pa.array((cast != NONE).sum(axis=1).astype(np.int32)),
                pa.array(np.round(posterior, 6)), pa.array(scores), pa.array(scores >= KEPT)],
                names=["doc_id", "n_votes", "posterior", "score", "kept"])

    return words.map_texts(docs, "doc_id", "text",
                           "doc_id long, n_votes int, posterior double, score double, kept boolean", work)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, *train(docs))
