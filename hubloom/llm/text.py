"""Words of whole Arrow text batches as numpy arrays, without a Python string per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Bytes of text handled at once, each of which takes some 30 bytes for a while; a longer document
# is a step of its own.
STEP_BYTES = 1 << 19


_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)
_POWER_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes of words that white space separates, and of words of letters, digits and non-ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x41:0x5B] = ALPHANUMERIC[0x61:0x7B] = True
ALPHANUMERIC[0x80:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offset of each text in them."""
    wide = pa.types.is_large_string(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of `inside` bytes, and the words before each text."""
    member = inside[data]
    start, end = member.copy(), member.copy()
    start[1:] &= ~member[:-1]
    end[:-1] &= ~member[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = member[cuts]
    end[cuts - 1] = member[cuts - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), _POWER_BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    chars = data[place + np.repeat(starts, lengths)]
    values = _BYTE_VALUES[LOWER[chars] if lower else chars] * powers[place]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def sliding(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words of each text, or of the whole text where it has fewer.

    `bounds` are the words before each text; the second result are the runs before each text.
    Texts without words have no run.
    """
    counts = np.diff(bounds)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(runs)])
    place = np.arange(before[-1], dtype=np.int64) - np.repeat(before[:-1], runs) + np.repeat(bounds[:-1], runs)
    limit = np.repeat(bounds[1:], runs)
    total = np.zeros(len(place), np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        at = place + k
        there = at < limit
        total = total * factor + np.where(there, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(k + 1))
    return mix64(total), before


def map_texts(docs: DataFrame, key: str, text: str, schema: str,
              work: Callable[[pa.Array, pa.Array], list[pa.RecordBatch]],
              more: dict[str, str] | None = None) -> DataFrame:
    """Run `work(ids, texts, ...)` over Arrow batches of (key, text); null texts arrive empty."""
    columns = [F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    columns += [F.col(column).alias(name) for name, column in (more or {}).items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(*batch.columns)
        pa.default_memory_pool().release_unused()  # the worker stays for tasks of other stages

    return docs.select(*columns).mapInArrow(run, schema)
