"""SentencePiece segmentations sampled without replacement, and decoding (operator 7).

The segmentations of a text form a lattice over the vocabulary's pieces; a segmentation's chance
is the product of its pieces' weights over the sum of all. No piece crosses certain pairs of
characters, so the lattice falls into units that are independent of each other. Perturbed A-star
search emits the k segmentations of largest perturbed log-chance: the best node's sample is
emitted and its space is split by the first unit that differs; each part gets the maximum of its
perturbations, bounded by its parent's, so that nothing is expanded that can't come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hubloom.llm import text as words
from hubloom.llm.tables import read_table

SAMPLES = 2
ALPHA = 1.0  # weights are (rank + 2) to the power of -ALPHA
SEED = 7
SPACE = 0x2581  # stands for a space in pieces; the character itself goes by its bytes
LITERAL_SPACE = 0x110000
FIRST_BYTE, FIRST_PIECE = 3, 259  # ids in the model: bytes, then pieces by rank
UNKNOWN = 1 << 24  # ids from here stand for a character that goes by its bytes
SLOT_BITS = 20
STEP_BYTES = 3 << 18
TRIES = 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Lookup:
    """64-bit keys to numbers, in two tables so that keys of one slot don't meet."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, np.uint64(0))
        self.none = len(keys)
        self.tables, left = [], np.arange(len(keys))
        while len(left):
            table = np.full(1 << SLOT_BITS, self.none, np.int32)
            slots = self.slot(keys[left], len(self.tables))
            table[slots[::-1]] = left[::-1]
            self.tables.append(table)
            left = left[table[slots] != left]

    @staticmethod
    def slot(keys: np.ndarray, k: int) -> np.ndarray:
        return (keys >> np.uint64(64 - SLOT_BITS * (k % 3 + 1)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 for those that aren't there."""
        result = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for k, table in enumerate(self.tables):
            found = table[self.slot(keys[left], k)]
            taken = np.flatnonzero(found < self.none)  # a key is in a later table only if its slot is taken
            left, found = left[taken], found[taken]
            hit = self.keys[found] == keys[left]
            result[left[hit]] = found[hit]
            left = left[~hit]
        return result


def char_values(chars: np.ndarray) -> np.ndarray:
    return words.mix64(chars.astype(np.uint64) + np.uint64(0x1234567))


@dataclass
class Vocabulary:
    """Pieces of a model as arrays; small enough to travel with every task."""

    ids: np.ndarray  # of each number in the lookup
    pieces: Lookup
    symbols: np.ndarray  # by code point: number of a character that has neighbours in pieces, else 0
    values: np.ndarray  # of the numbered characters
    beside: np.ndarray  # by pair of numbers: whether they stand side by side in a piece
    longest: int
    weights: np.ndarray  # log-weight by id
    byte_weight: float
    data: np.ndarray  # bytes of all pieces by id, one after the other
    offsets: np.ndarray


def read_vocabulary(path: str | None = None, alpha: float = ALPHA) -> Vocabulary:
    """The vocabulary of a SentencePiece model file with byte fallback.

    A piece's weight falls with its rank in the model, which is the order of its merges.
    """
    import sentencepiece
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    ids = [i for i in range(FIRST_PIECE, size) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    longest = max(len(names[i]) for i in ids)
    keys, pairs = [], set()
    for i in ids:
        chars = np.array([ord(c) for c in names[i]], np.uint64)
        powers = np.cumprod(np.append(np.uint64(1), np.full(len(chars) - 1, _BASE)), dtype=np.uint64)
        keys.append((char_values(chars) * powers).sum(dtype=np.uint64))
        pairs |= set(zip(names[i], names[i][1:]))
    alphabet = np.array(sorted({ord(c) for pair in pairs for c in pair}))
    symbols = np.zeros(LITERAL_SPACE + 1, np.int32)
    symbols[alphabet] = np.arange(1, len(alphabet) + 1)
    beside = np.zeros((len(alphabet) + 1,) * 2, bool)
    for left, right in pairs:
        beside[symbols[ord(left)], symbols[ord(right)]] = True
    weights = -alpha * np.log(np.arange(size) - FIRST_PIECE + 2.0, where=np.arange(size) >= FIRST_PIECE, out=np.zeros(size))
    byte_weight = -alpha * float(np.log(size + 2.0))
    spelled = [bytes([i - FIRST_BYTE]) if FIRST_BYTE <= i < FIRST_PIECE else names[i].replace(chr(SPACE), " ").encode()
               if i >= FIRST_PIECE else b"" for i in range(size)]
    return Vocabulary(np.array(ids), Lookup(words.mix64(np.array(keys, np.uint64))), symbols,
                      char_values(np.append(0, alphabet)), beside, longest, weights, byte_weight, np.frombuffer(b"".join(spelled), np.uint8),
                      np.concatenate([[0], np.cumsum([len(s) for s in spelled])]))


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a space before each one that isn't empty, and their offsets."""
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    some = np.diff(before) > 0
    bounds = before + np.concatenate([[0], np.cumsum(some)])
    result = np.full(bounds[-1], SPACE, np.int64)
    place = np.arange(len(chars)) + np.repeat(np.cumsum(some), np.diff(before))
    result[place] = np.where(chars == SPACE, LITERAL_SPACE, np.where(chars == 0x20, SPACE, chars))
    return result, bounds


def utf8_bytes(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of characters one after the other, and how many each has."""
    chars = np.where(chars == LITERAL_SPACE, SPACE, chars)
    text = chars.astype(np.uint32).tobytes().decode("utf-32-le").encode()
    counts = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
    return np.frombuffer(text, np.uint8), counts


@dataclass
class Lattices:
    """Lattices of distinct units: the positions of all units stand one after the other."""

    first: np.ndarray  # position of each unit's start; its end is the next unit's start less 1
    length: np.ndarray
    ids: np.ndarray  # by position and piece length: the piece's id, -1 for none
    rest: np.ndarray  # log of the weights of all ways from a position to the unit's end
    ways: np.ndarray  # their number
    reach: np.ndarray  # by position and piece length: chance that the next piece is at most so long
    weights: np.ndarray
    byte_weight: float

    def weight(self, ids: np.ndarray) -> np.ndarray:
        """Log-weight of ids; characters that go by bytes weigh as their bytes."""
        result = self.weights[np.where((ids >= 0) & (ids < UNKNOWN), ids, 0)]
        result[ids < 0] = -np.inf
        odd = ids >= UNKNOWN
        if odd.any():
            chars = np.where(ids[odd] == UNKNOWN + LITERAL_SPACE, SPACE, ids[odd] - UNKNOWN)
            result[odd] = (1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)) * self.byte_weight
        return result


def build_lattices(chars: np.ndarray, values: np.ndarray, first: np.ndarray, length: np.ndarray,
                   vocabulary: Vocabulary) -> Lattices:
    """Lattices of units given as (first, length) in `chars`; each unit gets an end position."""
    start = np.cumsum(length + 1) - (length + 1)
    size = int((length + 1).sum())
    position = np.arange(size)
    unit = np.repeat(np.arange(len(length)), length + 1)
    inside = position - start[unit]
    left = length[unit] - inside  # characters from here to the unit's end
    at = np.where(left > 0, first[unit] + inside, 0)
    symbol = chars[at] if size else at
    scattered = values[at] if size else np.zeros(0, np.uint64)
    total = np.zeros(size, np.uint64)
    powers = np.cumprod(np.append(np.uint64(1), np.full(vocabulary.longest, _BASE)), dtype=np.uint64)
    pieces: list[np.ndarray] = []  # by length less 1: ids at each position, and their log-weights
    logs: list[np.ndarray] = []
    there = np.flatnonzero(left > 0)
    for k in range(min(vocabulary.longest, int(length.max(initial=0)))):
        total[:size - k] += scattered[k:] * powers[k]
        there = there[left[there] > k]
        found = vocabulary.pieces.find(words.mix64(total[there]))
        hit = found >= 0
        at, found = there[hit], vocabulary.ids[found[hit]]
        pieces.append(np.full(size, -1, np.int32))
        logs.append(np.full(size, -np.inf, np.float32))
        pieces[k][at], logs[k][at] = found, vocabulary.weights[found]
    while len(pieces) > 1 and (pieces[-1] < 0).all():  # no piece of these units is so long
        pieces.pop()
        logs.pop()
    rest, ways = np.zeros(size + len(pieces)), np.ones(size + len(pieces), np.float32)
    lattices = Lattices(start, length, np.zeros((size, 0), np.int32), rest, ways,
                        np.zeros((size, len(pieces)), np.float32), vocabulary.weights, vocabulary.byte_weight)
    if not pieces:
        return lattices
    lone = np.flatnonzero((left > 0) & (pieces[0] < 0))
    pieces[0][lone] = UNKNOWN + symbol[lone]
    logs[0][lone] = lattices.weight(pieces[0][lone])
    # From the units' ends backwards, all units of at least t characters at once.
    longest_first = np.argsort(-length, kind="stable")
    ends = (start + length)[longest_first]
    counts = np.searchsorted(-length[longest_first], -np.arange(1, int(length.max()) + 1), side="right")
    for t, n in enumerate(counts.tolist(), 1):
        here = ends[:n] - t
        width = min(t, len(pieces))
        # What follows a position in the arrays is what follows it in the unit.
        each = [logs[k][here] + rest[here + k + 1] for k in range(width)]
        top = each[0].copy()
        for one in each[1:]:
            np.maximum(top, one, out=top)
        so_far, count = np.zeros(n), np.zeros(n, np.float32)
        reach = np.empty((width, n))
        for k, one in enumerate(each):
            share = np.exp((one - top).astype(np.float32))
            so_far += share
            reach[k] = so_far
            count += ways[here + k + 1] * (share > 0)
        rest[here] = top + np.log(so_far)
        ways[here] = np.minimum(count, 1e15)
        # Whatever is drawn, the last possible piece is within reach.
        reach /= so_far
        reach[reach >= 1] = 2
        lattices.reach[here, :width] = reach.T
    logs.clear()
    lattices.ids = np.stack(pieces, axis=1)
    return lattices


def draw_keys(seeds: np.ndarray, sample: int, unit: np.ndarray) -> np.ndarray:
    """Keys of the draws of a text's unit; a step of the unit is added to them."""
    of_sample = np.uint64((sample + 1) * 0x2545F4914F6CDD1D % 2**64)
    return words.mix64(seeds + unit.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + of_sample)


def uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers between 0 and 1."""
    return ((words.mix64(keys + np.uint64(step)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53


@dataclass
class Sampled:
    """Segmentations of a run of units: ids one after the other, and the ids before each unit."""

    ids: np.ndarray
    bounds: np.ndarray

    def of(self, unit: int) -> tuple[int, ...]:
        return tuple(self.ids[self.bounds[unit]:self.bounds[unit + 1]].tolist())


def sample_units(lattices: Lattices, kinds: np.ndarray, keys: np.ndarray) -> Sampled:
    """An independent segmentation of each unit, a kind of lattice with a key for its draws."""
    here = lattices.first[kinds]
    end = here + lattices.length[kinds]
    active = np.arange(len(kinds))
    whose, which, step = [], [], 0
    while len(active):
        drawn = uniform(keys, step).astype(np.float32)
        size = (lattices.reach[here] > drawn[:, None]).argmax(axis=1)
        whose.append(active)
        which.append(lattices.ids[here, size])
        here = here + size + 1
        more = np.flatnonzero(here < end)
        here, end, keys, active = here[more], end[more], keys[more], active[more]
        step += 1
    counts = np.zeros(len(kinds), np.int64)
    for units in whose:
        counts[units] += 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    ids = np.empty(int(bounds[-1]), np.int32)
    for k, (units, found) in enumerate(zip(whose, which)):
        ids[bounds[units] + k] = found
    return Sampled(ids, bounds)


def sample_others(lattices: Lattices, kinds: np.ndarray, keys: np.ndarray,
                  excluded: list[list[tuple[int, ...]]]) -> list[tuple[int, ...]]:
    """A segmentation of each unit by its chance among those that aren't excluded.

    Plain samples are drawn until one isn't excluded; after `TRIES`, the way is chosen piece by
    piece with the excluded ways' weight taken off, which has the same distribution.
    """
    result: list[tuple[int, ...]] = [()] * len(kinds)
    left = np.arange(len(kinds))
    for attempt in range(TRIES):
        drawn = sample_units(lattices, kinds[left], words.mix64(keys[left] + np.uint64(attempt << 32)))
        missed = []
        for i, unit in enumerate(left.tolist()):
            result[unit] = drawn.of(i)
            if result[unit] in excluded[unit]:
                missed.append(unit)
        left = np.array(missed, np.int64)
        if not len(left):
            break
    for unit in left.tolist():
        draws = uniform(words.mix64(np.repeat(keys[unit], 64) + np.arange(64, dtype=np.uint64)), TRIES)
        result[unit] = sample_without(lattices, int(kinds[unit]), excluded[unit], draws)
    return result


def piece_sizes(lattices: Lattices, kind: int, ids: tuple[int, ...]) -> list[int]:
    at, sizes = int(lattices.first[kind]), []
    for one in ids:
        k = int(np.flatnonzero(lattices.ids[at] == one)[0])
        sizes.append(k + 1)
        at += k + 1
    return sizes


def sample_without(lattices: Lattices, kind: int, excluded: list[tuple[int, ...]], draws: np.ndarray) -> tuple[int, ...]:
    """A segmentation of one unit by its chance among those that aren't excluded."""
    paths = [(ids, piece_sizes(lattices, kind, ids)) for ids in excluded]
    at, end = int(lattices.first[kind]), int(lattices.first[kind] + lattices.length[kind])
    result: list[int] = []
    while at < end:
        options = []
        for k in np.flatnonzero(lattices.ids[at] >= 0):
            one, after = int(lattices.ids[at, k]), at + int(k) + 1
            if after > end:
                break
            barred = [p for p in paths if len(p[0]) > len(result) and p[0][len(result)] == one]
            # What the excluded ways from there weigh, against all ways from there.
            gone = sum(np.exp(lattices.weight(np.array(p[0][len(result) + 1:], np.int64)).sum() - lattices.rest[after])
                       for p in barred)
            if len(barred) < lattices.ways[after]:
                mass = max(1 - gone, 1e-300)
                options.append((one, after, float(lattices.weight(np.array([one]))[0] + lattices.rest[after]) + np.log(mass), barred))
        masses = np.exp(np.array([o[2] for o in options]) - max(o[2] for o in options))
        pick = int(np.searchsorted(np.cumsum(masses) / masses.sum(), draws[len(result) % len(draws)]))
        one, at, _, paths = options[min(pick, len(options) - 1)]
        result.append(one)
    return tuple(result)


def bounded_gumbel(place: np.ndarray, bound: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Gumbel variables at `place`, conditioned on being less than `bound`."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        value = place - np.log(np.exp(np.minimum(place - bound, 700)) - np.log(drawn))
    return np.where(np.isneginf(place), -np.inf, value)


@dataclass
class Node:
    """What a search knows of one emitted segmentation of a text."""

    split: int  # first unit that could differ from its parent
    excluded: list[tuple[int, ...]]  # what that unit must not be
    bound: float  # its perturbed log-chance
    log_chance: float
    parts: np.ndarray  # perturbed log-chance of the part of the space split off at each unit
    top: float  # the largest of them


def search(lattices: Lattices, kinds: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, samples: int
           ) -> tuple[list[Sampled], list[list[Node]], list[list[int]]]:
    """Up to `samples` distinct segmentations of each text, by perturbed A-star search.

    `kinds` are the lattices of all units, `bounds` the units before each text. Returns the
    emitted runs of ids (over all texts), the nodes of each text, and by round the texts that
    emitted one.
    """
    texts = len(bounds) - 1
    text_of = np.repeat(np.arange(texts), np.diff(bounds))
    place = np.arange(len(kinds)) - bounds[:-1][text_of]
    one_way = lattices.ways[lattices.first[kinds]] <= 1
    total = lattices.rest[lattices.first[kinds]]
    runs: list[Sampled] = []
    nodes: list[list[Node]] = [[] for _ in range(texts)]
    rounds: list[list[int]] = []
    root = uniform(draw_keys(seeds, 3, np.zeros(texts, np.int64)), 0)
    for k in range(samples):
        if k == 0:
            chosen = [(t, -1, 0, []) for t in range(texts)]
            run = sample_units(lattices, kinds, draw_keys(seeds[text_of], 0, place))
        else:
            chosen = []
            take = np.full(len(kinds), k)  # the run that each unit is copied from
            for t in range(texts):
                s = max(range(len(nodes[t])), key=lambda i: nodes[t][i].top)
                if nodes[t][s].top == -np.inf:
                    continue
                unit = int(np.argmax(nodes[t][s].parts))
                barred = ([*nodes[t][s].excluded] if unit == nodes[t][s].split else []) + [runs[s].of(int(bounds[t]) + unit)]
                chosen.append((t, s, unit, barred))
                take[bounds[t]:int(bounds[t]) + unit] = s
            at = np.array([bounds[t] + unit for t, _, unit, _ in chosen], np.int64)
            others = sample_others(lattices, kinds[at], draw_keys(seeds[text_of[at]], 4 * k + 1, place[at]),
                                   [barred for *_, barred in chosen])
            # Only units that aren't copied are drawn.
            drawn_at = np.flatnonzero(take == k)
            fresh = sample_units(lattices, kinds[drawn_at], draw_keys(seeds[text_of[drawn_at]], 4 * k, place[drawn_at]))
            counts = np.zeros(len(kinds), np.int64)
            counts[drawn_at] = np.diff(fresh.bounds)
            fresh = Sampled(fresh.ids, np.concatenate([[0], np.cumsum(counts)]))
            run = merged([*runs, fresh], take, dict(zip(at.tolist(), others)))
        weight = lattices.weight(run.ids)
        rounds.append([t for t, *_ in chosen])
        drawn = uniform(draw_keys(seeds[text_of], 4 * k + 2, place), 0)
        unit_weight = np.zeros(len(kinds))
        if len(kinds):
            unit_weight = np.add.reduceat(weight, run.bounds[:-1]) - total
        chances = np.where(one_way, 0.0, np.minimum(unit_weight, -1e-15))
        with np.errstate(divide="ignore"):
            apart = np.where(one_way, -np.inf, np.log(-np.expm1(chances)))
        # The part where a unit is the first to differ: what stands before it is as sampled.
        before = np.zeros(len(kinds))
        limit = np.zeros(texts)
        for t, s, unit, barred in chosen:
            start, end = int(bounds[t]), int(bounds[t + 1])
            np.cumsum(chances[start:end - 1], out=before[start + 1:end])
            if s < 0:
                limit[t] = -np.log(-np.log(root[t]))
                continue
            parent = nodes[t][s]
            limit[t] = parent.parts[unit]
            parent.parts[unit] = -np.inf
            parent.top = float(parent.parts.max())
            at = start + unit
            apart[start:at] = -np.inf
            gone = [*barred, run.of(at)]
            left = 1 - sum(np.exp(lattices.weight(np.array(ids, np.int64)).sum() - total[at]) for ids in gone)
            all_gone = len(gone) >= lattices.ways[lattices.first[kinds[at]]]
            apart[at] = -np.inf if all_gone else np.log(max(left, 1e-300))
        parts = bounded_gumbel(before + apart, limit[text_of], drawn)
        some = np.diff(bounds) > 0
        tops = np.full(texts, -np.inf)
        if len(parts):
            tops[some] = np.maximum.reduceat(parts, bounds[:-1][some])
        for t, s, unit, barred in chosen:
            start, end = int(bounds[t]), int(bounds[t + 1])
            chance = float(before[end - 1] + chances[end - 1]) if end > start else 0.0
            nodes[t].append(Node(unit, barred, float(limit[t]), chance, parts[start:end], float(tops[t])))
        runs.append(run)
    return runs, nodes, rounds


def merged(runs: list[Sampled], take: np.ndarray, changed: dict[int, tuple[int, ...]]) -> Sampled:
    """A run whose units come from the given runs, but for those that have changed."""
    starts = np.stack([r.bounds[:-1] for r in runs])[take, np.arange(len(take))]
    ends = np.stack([r.bounds[1:] for r in runs])[take, np.arange(len(take))]
    shift = np.concatenate([[0], np.cumsum([len(r.ids) for r in runs])])
    pool = np.concatenate([r.ids for r in runs] + [np.array([i for ids in changed.values() for i in ids], np.int32)])
    starts, ends = starts + shift[take], ends + shift[take]
    at = int(shift[-1])
    for unit, ids in changed.items():
        starts[unit], ends[unit] = at, at + len(ids)
        at += len(ids)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], ends - starts) + np.repeat(starts, ends - starts)
    return Sampled(pool[place], bounds)


def spelled_ids(run: Sampled) -> Sampled:
    """The run with characters that go by bytes replaced by the ids of their bytes."""
    odd = run.ids >= UNKNOWN
    data, counts = utf8_bytes(run.ids[odd].astype(np.int64) - UNKNOWN)
    size = np.ones(len(run.ids), np.int64)
    size[odd] = counts
    ids = np.repeat(run.ids, size)
    ids[np.repeat(odd, size)] = data.astype(np.int32) + FIRST_BYTE
    before = np.concatenate([[0], np.cumsum(size)])
    return Sampled(ids, before[run.bounds])


def decode_bytes(ids: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that ids stand for, one after the other, and the bytes before each id."""
    size = vocabulary.offsets[ids + 1] - vocabulary.offsets[ids]
    before = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(before[-1]) - np.repeat(before[:-1], size) + np.repeat(vocabulary.offsets[ids], size)
    return vocabulary.data[place], before


def copy_numbers(ids: np.ndarray, before: tuple[int, int] | None) -> np.ndarray:
    """How many rows with the same id stand directly before each row; `before` is the last id and its number."""
    place = np.arange(len(ids))
    new = np.append(before is None or ids[0] != before[0], ids[1:] != ids[:-1])
    start = np.maximum.accumulate(np.where(new, place, -1))
    return np.where(start >= 0, place - start, place + (before[1] + 1 if before else 0))


def sampled_batches(ids: pa.Array, texts: pa.Array, vocabulary: Vocabulary, samples: int, seed: int,
                    copies: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    data, offsets = words.buffers(texts)
    keys = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    seeds = words.mix64(words.mix64(keys) + np.uint64(seed))
    if copies is not None:
        seeds = np.where(copies == 0, seeds, words.mix64(seeds ^ words.mix64(copies.astype(np.uint64))))
    for first, last in words.steps(offsets, STEP_BYTES):
        chars, bounds = characters(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        values, starts, length = units_of(chars, bounds, vocabulary)
        unit_bounds = np.searchsorted(starts, bounds)
        one, of = distinct_units(values, starts, length)
        lattices = build_lattices(chars, values, starts[one], length[one], vocabulary)
        del chars, values
        runs, nodes, rounds = search(lattices, of, unit_bounds, seeds[first:last], samples)
        for k, run in enumerate(runs):
            chosen = np.array(rounds[k], np.int64)
            if not len(chosen):
                continue
            run = spelled_ids(run)
            edges = run.bounds[unit_bounds]
            counts = (edges[1:] - edges[:-1])[chosen]
            at = np.concatenate([[0], np.cumsum(counts)])
            own = run.ids
            if len(chosen) < last - first:
                own = np.concatenate([run.ids[edges[t]:edges[t + 1]] for t in chosen])
            threshold = np.array([max(n.top for n in nodes[t]) for t in chosen.tolist()])
            chance = np.array([nodes[t][k].log_chance for t in chosen.tolist()])
            yield pa.RecordBatch.from_arrays([
                ids.slice(first, last - first).take(pa.array(chosen)), pa.array(np.full(len(chosen), k + 1, np.int32)),
                pa.array(counts.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(own.astype(np.int32))),
                pa.array(np.round(chance, 6)), pa.array(np.round(log_inclusion(chance, threshold), 6))], names=NAMES)


def units_of(chars: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash values of the characters, and starts and lengths of the units that no piece leaves."""
    symbol = vocabulary.symbols[chars]
    values = vocabulary.values[symbol]
    rare = np.flatnonzero(symbol == 0)
    values[rare] = char_values(chars[rare])
    new = np.ones(len(chars), bool)
    if len(chars):
        new[1:] = ~vocabulary.beside[symbol[:-1], symbol[1:]]
        new[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(new)
    return values, starts, np.diff(np.append(starts, len(chars)))


def distinct_units(values: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One example of each kind of unit, and the number of each unit's kind."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(values)) - np.repeat(starts, length)
    powers = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()) - 1, _BASE)), dtype=np.uint64)
    keys = words.mix64(np.add.reduceat(values * powers[place], starts) + length.astype(np.uint64))
    _, one, of = np.unique(keys, return_index=True, return_inverse=True)
    return one, of


def log_inclusion(log_chance: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Log of the chance that a perturbed log-chance exceeds the first that wasn't emitted."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        rate = np.exp(np.minimum(log_chance - threshold, 700))
        value = np.where(rate < 1e-8, log_chance - threshold, np.log(-np.expm1(-rate)))
    return np.where(np.isneginf(threshold), 0.0, np.minimum(value, 0.0))


NAMES = ["doc_id", "sample", "n_pieces", "pieces", "log_chance", "log_inclusion"]
SCHEMA = "doc_id long, sample int, n_pieces int, pieces array<int>, log_chance double, log_inclusion double"


def sample_segmentations(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text",
                         samples: int = SAMPLES, seed: int = SEED, copies_apart: bool = False) -> DataFrame:
    """A row for each of up to `samples` distinct segmentations of each text.

    Columns: doc_id, sample (from 1, by falling perturbed log-chance), n_pieces, pieces (ids),
    log_chance, log_inclusion (log of the chance to be among the samples, given the first
    perturbed log-chance that isn't). `decode` gives the text back from any sample. Texts with
    fewer segmentations have all of them. Null and empty texts have the empty one. Whole texts
    are segmented; draws are seeded by the id (null ids alike), so repeated rows give the same.
    With `copies_apart` rows of one id that follow each other, as the copies of a mix do, are
    seeded by their number too, and each has draws of its own. An empty table gives an empty result. Other columns are not looked at.
    """
    last: list[tuple[int, int]] = []  # id and number of the last row of a task's batch before

    def work(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        copies = None
        if copies_apart:
            plain = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            copies = copy_numbers(plain, last[-1] if last else None)
            last[:] = [(int(plain[-1]), int(copies[-1]))]
        yield from sampled_batches(ids, texts, vocabulary, samples, seed, copies)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return words.map_texts(rows, "key", "text", SCHEMA, work)


def decode(rows: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces") -> DataFrame:
    """`rows` with a column `decoded`: the text that the ids in `pieces` stand for.

    The space that was put before the text is taken off; bytes that aren't UTF-8 become the
    replacement character. Null lists give null.
    """
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(names.index(pieces))
            texts = []
            for one in lists:
                if not one.is_valid:
                    texts.append(None)
                    continue
                spelled, _ = decode_bytes(np.asarray(one.values.fill_null(0), np.int64), vocabulary)
                texts.append(spelled.tobytes().removeprefix(b" ").decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def op7_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(read_table(spark, sf_dir, "documents"), read_vocabulary())
