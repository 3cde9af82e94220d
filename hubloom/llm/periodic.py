"""Periodic runs of words by recursive frequency splitting (operator 13).

A run repeats its period at least four times, so each of its words occurs four times or more
within it. Words that are rarer than that within their segment split it; the parts are counted
anew until nothing changes. What survives is scanned by lag.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hubloom.llm import text as words
from hubloom.llm.tables import read_table

# A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
# Lags up to here are scanned one by one, beyond by repeated windows.
SHORT_LAGS = 16


def surviving(ids: np.ndarray, segment: np.ndarray, times: int = LEAST_TIMES, least: int = LEAST_WORDS) -> np.ndarray:
    """Places of the words left when words that occur under `times` times in their segment split it.

    `segment` holds each word's first segment (its document), ascending. Segments of under
    `least` words go as well. Only segments that lost a word are counted again.
    """
    settled: list[np.ndarray] = []
    place = np.arange(len(ids))
    while len(place):
        order = np.lexsort((ids[place], segment))
        of, word = segment[order], ids[place][order]
        new = np.ones(len(order), bool)
        new[1:] = (of[1:] != of[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(order)))
        rare = np.zeros(len(place), bool)
        rare[order] = np.repeat(counts < times, counts)
        if not rare.any():
            settled.append(place)
            break
        # segments without a rare word are done
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        touched = np.repeat(np.logical_or.reduceat(rare, first), np.diff(np.append(first, len(place))))
        settled.append(place[~touched])
        keep = touched & ~rare
        part = np.cumsum(rare)  # a rare word parts what stands before it from what comes after
        place, segment, part = place[keep], segment[keep], part[keep]
        if not len(place):
            break
        cut = np.append(True, (segment[1:] != segment[:-1]) | (part[1:] != part[:-1]))
        segment = np.cumsum(cut) - 1
        long_enough = np.bincount(segment)[segment] >= least
        place, segment = place[long_enough], segment[long_enough]
    return np.sort(np.concatenate(settled)) if settled else place


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of True of at least `least`."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long_enough = ends - starts >= least
    return starts[long_enough], ends[long_enough]


def least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_TIMES * period)


def prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] if n > 1 else found


def smallest(seq: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of `period`, at least two periods long, has no smaller period that divides it.

    With a length of four periods or more, every smaller period divides this one.
    """
    head = seq[start:start + period]
    return not any(np.array_equal(head, seq[start + period // p:start + period // p + period]) for p in prime_factors(period))


def windows(seq: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each place, `size` a power of two; pairs of halves are hashed."""
    value, width = seq.view(np.uint64), 1
    while width < size:
        value = words.mix64(value[:-width] * np.uint64(0x9E3779B97F4A7C15) + value[width:])
        width *= 2
    return value


def agreeing(seq: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch round `at` in which words `lag` apart are equal: first and last place + 1."""
    limit = len(seq) - lag
    end, step = at, 64
    while end < limit:
        stop = min(end + step, limit)
        differ = np.flatnonzero(seq[end:stop] != seq[end + lag:stop + lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, step * 2
    start, step = at, 64
    while start > 0:
        stop = max(start - step, 0)
        differ = np.flatnonzero(seq[stop:start] != seq[stop + lag:start + lag])
        if len(differ):
            start = stop + int(differ[-1]) + 1
            break
        start, step = stop, step * 2
    return start, end


def lag_scan(seq: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, of every period.

    Short lags are compared word by word. For lags between s / 2 and s a run is over 2 s words
    long, so it holds a whole aligned stretch of s words, whose first s / 2 words come again
    after one lag, or came one lag before: only such repeats of hashed windows are looked at,
    word by word. That takes n log n steps whatever the lags.
    """
    runs: list[tuple[int, int, int]] = []
    for lag in range(1, min(SHORT_LAGS, len(seq) // LEAST_TIMES) + 1):
        starts, ends = stretches(seq[lag:] == seq[:-lag], least_length(lag) - lag)
        runs += [(s, e + lag - s, lag) for s, e in zip(starts.tolist(), ends.tolist()) if smallest(seq, s, lag)]
    half = SHORT_LAGS
    while LEAST_TIMES * (half + 1) <= len(seq):
        runs += long_lags(seq, half, runs)
        half *= 2
    return runs


def long_lags(seq: np.ndarray, half: int, shorter: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of periods over `half`, up to twice that; `shorter` are those of smaller periods."""
    hashed = windows(seq, half)
    anchors = np.arange(0, len(hashed), 2 * half)
    found: list[tuple[int, int]] = []
    for shift in (np.arange(half + 1, 2 * half + 1), -np.arange(half + 1, 2 * half + 1)):
        for group in np.array_split(anchors, max(1, len(anchors) * half >> 20)):  # bounded steps
            other = group[:, None] + shift[None, :]
            there = (other >= 0) & (other < len(hashed))
            same = there & (hashed[np.where(there, other, 0)] == hashed[group][:, None])
            row, column = np.nonzero(same)
            a = np.minimum(group[row], other[row, column])
            found.append(np.stack([a, np.abs(shift[column])], 1))
    pairs = np.concatenate(found)
    pairs = np.unique(pairs[:, ::-1], axis=0)[:, ::-1]  # by lag, then place
    if shorter and len(pairs):
        # A window and its repeat within a run of a smaller period are a multiple of that period.
        known = np.array(sorted(shorter), np.int64)
        reach = np.maximum.accumulate(known[:, 0] + known[:, 1])
        at = np.searchsorted(known[:, 0], pairs[:, 0], side="right") - 1
        inside = (at >= 0) & (reach[np.maximum(at, 0)] >= pairs[:, 0] + pairs[:, 1] + half)
        pairs = pairs[~inside]
    runs, lag, passed = [], 0, -1
    for a, q in pairs.tolist():
        if q == lag and a < passed:
            continue
        start, end = agreeing(seq, a, q)
        lag, passed = q, end
        if end - start + q >= least_length(q) and smallest(seq, start, q):
            runs.append((start, end - start + q, q))
    return runs


def rotated(bounds: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The original word that stands at each place; `hashed` is the crc32 of each document's id, -1 for none."""
    place = np.arange(int(bounds[-1]))
    for k in np.flatnonzero((hashed % 10 == 0) & (hashed >= 0) & (np.diff(bounds) > 0)).tolist():
        first, n, g = int(bounds[k]), int(bounds[k + 1] - bounds[k]), int(hashed[k]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        place[first + a:first + n] = first + a + np.arange(n - a) % p
    return place


def document_runs(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all documents: rows (start, length, period) by document, start and period; runs before each."""
    counts = np.diff(bounds)
    place = surviving(ids, np.repeat(np.arange(len(counts)), counts))
    empty = np.zeros((0, 3), np.int64)
    if not len(place):
        return empty, np.zeros(len(bounds), np.int64)
    # Surviving segments one after the other; what parts them is unlike everything else.
    document = np.searchsorted(bounds, place, side="right") - 1
    cut = np.append(False, (np.diff(place) > 1) | (document[1:] != document[:-1]))
    _, compact = np.unique(ids[place], return_inverse=True)
    shift = np.cumsum(cut)
    seq = -np.arange(1, len(place) + shift[-1] + 1, dtype=np.int64)
    seq[np.arange(len(place)) + shift] = compact.reshape(-1) + 1
    runs = np.array(lag_scan(seq), np.int64).reshape(-1, 3)
    back = np.full(len(seq), -1, np.int64)
    back[np.arange(len(place)) + shift] = place
    runs[:, 0] = back[runs[:, 0]]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs, np.searchsorted(runs[:, 0], bounds)


def repeated(bounds: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Words that stand in a run after its first period."""
    change = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, document: np.ndarray, count: int) -> list[memoryview]:
    """The words of each of `count` documents with one space between."""
    sizes = ends - starts + 1
    before = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 0x20, np.uint8)
    lengths = sizes - 1
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[inner + np.repeat(before, lengths)] = data[inner + np.repeat(starts, lengths)]
    edges = np.append(before, len(out))[np.searchsorted(document, np.arange(count + 1))]
    view = memoryview(out)
    return [view[a:max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


RUN = "struct<start:long,length:long,period:long>"


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", rotate: bool = False) -> DataFrame:
    """Columns doc_id, n_words, runs (array of start, length, period), collapsed.

    `collapsed` is the text with every run cut down to its first period, words joined by one
    space. With `rotate`, one document in ten by its id's hash is made periodic first.

    Null, empty and white texts have no words, no runs and an empty collapsed text. Rows
    without an id are treated as all others, but never rotated. Repeated rows each have their
    result. An empty table gives an empty result. Other columns are not looked at. Texts are
    taken whole; a long one is a step of its own, with some 100 bytes of memory for each word.
    Words are told apart by 64-bit hashes, windows of words likewise before they are compared.
    """

    def work(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        data, offsets = words.buffers(texts)
        for first, last in words.steps(offsets):
            part = data[offsets[first]:offsets[last]]
            starts, ends, bounds = words.spans(part, offsets[first:last + 1] - offsets[first], words.NOT_SPACE)
            names = [x.as_py() for x in ids.slice(first, last - first)]
            if rotate:
                hashed = np.array([-1 if x is None else crc32(str(x).encode()) for x in names], np.int64)
                place = rotated(bounds, hashed)
                starts, ends = starts[place], ends[place]
            runs, before = document_runs(words.word_hashes(part, starts, ends, lower=False).view(np.int64), bounds)
            kept = np.flatnonzero(~repeated(bounds, runs))
            document = np.searchsorted(bounds, kept, side="right") - 1
            collapsed = [bytes(x).decode() for x in joined(part, starts[kept], ends[kept], document, last - first)]
            runs[:, 0] -= np.repeat(bounds[:-1], np.diff(before))
            listed = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(runs[:, k])) for k in range(3)], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([
                ids.slice(first, last - first), pa.array(np.diff(bounds).astype(np.int64)), listed,
                pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return words.map_texts(rows, "id", "text", f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string", work)


def op13_periodic(spark, sf_dir):
    found = find_runs(read_table(spark, sf_dir, "documents"), rotate=True)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return (found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")))
