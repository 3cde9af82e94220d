"""Toxicity scores by a convolutional text classifier trained in numpy (operator 9).

Words are hashed to embeddings; filters over one, two and three words are pooled by their
maximum over the whole text; a logistic layer scores the pooled values. All labelled rows are
learned from: each partition trains on its rows, and after each epoch the models are averaged.
Thresholds are calibrated by language on rows that the fit hasn't seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hubloom.llm import text as words
from hubloom.llm.tables import read_table, written

BUCKET_BITS = 17
HASHES = 2  # rows that are summed for a word, so that one shared with another word says little
WORD_BYTES = (HASHES * BUCKET_BITS + 7) // 8
DIMENSIONS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
# Labelled rows of a partition that trains on its own between two averages.
PART_ROWS = 4096
# Values of a model that are averaged together, and travel as one row from each partition.
BLOCK = 1024
# Bits (as a power of 2) of the map of labelled ids that goes to every task: 8 MB.
FILTER_BITS = 26
EPOCHS = 6
NEWTON_STEPS = 50
BATCH = 16
SEED = 9
# The score from which a row is predicted to be toxic where its language has no threshold.
THRESHOLD = 0.3
# Fewest calibration rows of each class for a threshold of a language's own.
LEAST_ROWS = 20


@dataclass
class ToxicityModel:
    embedding: np.ndarray  # a row of zeros at the end stands for the words after a text
    filters: list[np.ndarray]  # by width: (width, dimensions, filters)
    bias: np.ndarray
    output: np.ndarray
    intercept: float
    slope: float = 1.0  # of the calibrated score
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        return sum(self.embedding[buckets[:, k]] for k in range(HASHES))

    def pooled(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each text; zeros for texts without words."""
        counts = np.diff(bounds)
        starts = bounds[:-1] + PAD * np.arange(len(counts))
        padded = np.full((len(buckets) + PAD * len(counts), HASHES), len(self.embedding) - 1, np.int64)
        padded[np.arange(len(buckets)) + PAD * np.repeat(np.arange(len(counts)), counts)] = buckets
        vectors = self.vectors(padded)
        result = np.zeros((len(counts), len(WIDTHS) * FILTERS), np.float32)
        some = counts > 0
        if not some.any():
            return result
        edges = np.stack([starts[some], starts[some] + counts[some]], axis=1).reshape(-1)
        for k, weights in enumerate(self.filters):
            values = vectors @ weights[0]
            for shift in range(1, len(weights)):
                values[:-shift] += vectors[shift:] @ weights[shift]
            result[some, k * FILTERS:(k + 1) * FILTERS] = np.maximum.reduceat(values, edges, axis=0)[::2]
        return np.where(some[:, None], np.maximum(result + self.bias, 0), 0)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        raw = pooled.astype(np.float64) @ self.output + self.intercept
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def word_buckets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hash buckets, a row for each word, of ranges of texts, and the words before each text."""
    data, offsets = words.buffers(texts)
    for first, last in words.steps(offsets):
        part = data[offsets[first]:offsets[last]]
        starts, ends, bounds = words.spans(part, offsets[first:last + 1] - offsets[first], words.ALPHANUMERIC)
        hashes = words.word_hashes(part, starts, ends)
        parts = [hashes >> np.uint64(64 - (k + 1) * BUCKET_BITS) for k in range(HASHES)]
        yield first, last, np.stack(parts, axis=1).astype(np.int64) & ((1 << BUCKET_BITS) - 1), bounds


def started(held: np.ndarray, totals: np.ndarray, seed: int = SEED) -> tuple[ToxicityModel, np.ndarray]:
    """A model before training, and Adagrad's sums of squares: of the dense values, then the buckets'.

    `held` are each bucket's documents by label, `totals` all documents by label. The first
    dimension of the embeddings starts from the smoothed log-odds, the others at random.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    size = 1 << BUCKET_BITS
    totals = np.maximum(totals, 1)
    odds = np.log((held[1] + 2) / (totals[1] + 4)) - np.log((held[0] + 2) / (totals[0] + 4))
    embedding = rng.normal(0, 0.1, (size + 1, DIMENSIONS)).astype(np.float32)
    # Buckets that few documents hold say little: their odds shrink towards none.
    embedding[:-1, 0] = odds * (held.sum(axis=0) / (held.sum(axis=0) + 3)) / HASHES
    embedding[-1] = 0
    filters = [rng.normal(0, 0.2, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for weights in filters:
        weights[:, 0, :] = np.abs(weights[:, 0, :]) + np.float32(0.5 / len(weights))
    bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    model = ToxicityModel(embedding, filters, bias, np.full(len(bias), 1 / len(bias)), -1.0)
    return model, np.full(len(dense(model)) + size + 1, 1e-2)


def dense(model: ToxicityModel) -> np.ndarray:
    """All values but the embeddings, in one row."""
    return np.concatenate([model.bias, model.output, [model.intercept], *[w.reshape(-1) for w in model.filters]])


def set_dense(model: ToxicityModel, values: np.ndarray) -> None:
    n = len(model.bias)
    model.bias, model.output, model.intercept = values[:n].astype(np.float32), values[n:2 * n].copy(), float(values[2 * n])
    at = 2 * n + 1
    for k, weights in enumerate(model.filters):
        model.filters[k] = values[at:at + weights.size].reshape(weights.shape).astype(np.float32)
        at += weights.size


def learn(model: ToxicityModel, squares: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, order: np.ndarray,
          rate: float = 0.1) -> np.ndarray:
    """Adagrad on the logistic loss over the rows in this order; the buckets that it changed."""
    changed = np.zeros(len(model.embedding), bool)
    embedding, n = model.embedding, len(squares) - len(model.embedding)
    for begin in range(0, len(order), BATCH):
        chosen = order[begin:begin + BATCH]
        grads = {"bias": np.zeros_like(model.bias), "output": np.zeros_like(model.output), "intercept": 0.0,
                 "filters": [np.zeros_like(w) for w in model.filters], "at": [], "by": []}
        for i in chosen:
            backward(model, rows[i], int(labels[i]), grads)
        scale = 1 / len(chosen)
        grad = scale * np.concatenate([grads["bias"], grads["output"], [grads["intercept"]],
                                       *[g.reshape(-1) for g in grads["filters"]]])
        squares[:n] += grad ** 2
        set_dense(model, dense(model) - rate * grad / np.sqrt(squares[:n]))
        if grads["at"]:
            at, place = np.unique(np.concatenate(grads["at"]), return_inverse=True)
            total = np.zeros((len(at), DIMENSIONS))
            np.add.at(total, place, np.concatenate(grads["by"]) * scale)
            squares[n + at] += (total ** 2).mean(axis=1)
            embedding[at] -= (rate * total / np.sqrt(squares[n + at])[:, None]).astype(np.float32)
            embedding[-1] = 0
            changed[at] = True
    changed[-1] = False
    return changed


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> ToxicityModel:
    """Train on texts given as bucket arrays, in this process; all of the embeddings are trained."""
    held = np.zeros((2, 1 << BUCKET_BITS))
    for row, label in zip(rows, labels):
        held[label, np.unique(row)] += 1
    model, squares = started(held, np.array([(np.asarray(labels) == k).sum() for k in (0, 1)], float), seed)
    for epoch in range(epochs):
        learn(model, squares, rows, labels, np.random.default_rng([seed, epoch]).permutation(len(rows)))
    return model


def backward(model: ToxicityModel, row: np.ndarray, label: int, grads: dict) -> None:
    """Add one text's gradient; only the words at each filter's maximum take part."""
    pooled = np.zeros(len(model.bias))
    tops = []
    if len(row):
        padded = np.concatenate([row, np.full((PAD, HASHES), len(model.embedding) - 1)])
        vectors = model.vectors(padded)
        for k, weights in enumerate(model.filters):
            values = sum(vectors[s:s + len(row)] @ weights[s] for s in range(len(weights)))
            top = values.argmax(axis=0)
            tops.append(top)
            pooled[k * FILTERS:(k + 1) * FILTERS] = values[top, np.arange(FILTERS)]
        pooled = np.maximum(pooled + model.bias, 0)
    raw = float(pooled @ model.output + model.intercept)
    error = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - label
    grads["output"] += error * pooled
    grads["intercept"] += error
    if not len(row):
        return
    delta = error * model.output * (pooled > 0)
    grads["bias"] += delta.astype(np.float32)
    for k, (weights, top) in enumerate(zip(model.filters, tops)):
        own = delta[k * FILTERS:(k + 1) * FILTERS]
        for s in range(len(weights)):
            grads["filters"][k][s] += vectors[top + s].T * own
            for h in range(HASHES):
                grads["at"].append(padded[top + s, h])
                grads["by"].append(weights[s].T * own[:, None])


def newton_sums(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray, slope: float, shift: float) -> list[float]:
    """What a Newton step on slope and shift needs of these rows."""
    chance = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -40, 40)))
    spread, error = weight * chance * (1 - chance), weight * (chance - labels)
    return [float(x.sum()) for x in (error * raw, error, spread * raw * raw, spread * raw, spread)]


def newton_move(sums: list[float], slope: float) -> np.ndarray:
    curve = np.array([[sums[2] + 0.01, sums[3]], [sums[3], sums[4] + 1e-6]])
    return np.clip(np.linalg.solve(curve, np.array([sums[0] + 0.01 * (slope - 1), sums[1]])), -1, 1)


def calibrate(model: ToxicityModel, pooled: np.ndarray, labels: np.ndarray, langs: np.ndarray,
              base_rate: float) -> None:
    """Fit slope and intercept on unseen rows at the base rate, then a threshold by language.

    A language's threshold gives the largest F1 on its rows, halfway to the next lower score;
    languages with few rows take the common one.
    """
    raw = pooled.astype(np.float64) @ model.output + model.intercept
    share = labels.mean()
    weight = np.where(labels == 1, base_rate / share, (1 - base_rate) / (1 - share))
    slope, shift = 1.0, 0.0
    for _ in range(NEWTON_STEPS):
        move = newton_move(newton_sums(raw, labels, weight, slope, shift), slope)
        slope, shift = slope - move[0], shift - move[1]
    slope = max(slope, 0.05)
    model.output = model.output * slope
    model.intercept = float(model.intercept * slope + shift)
    scores = model.score(pooled)
    for lang in sorted({x for x in langs if x is not None}):
        own = langs == lang
        if min((labels[own] == 1).sum(), (labels[own] == 0).sum()) < LEAST_ROWS:
            continue
        order = np.argsort(-scores[own], kind="stable")
        ranked, hits, weights = scores[own][order], labels[own][order], weight[own][order]
        found = np.cumsum(hits * weights)
        f1 = 2 * found / (np.cumsum(weights) + (hits * weights).sum())
        best = int(f1.argmax())
        lower = ranked[best + 1] if best + 1 < len(ranked) else 0.0
        model.thresholds[lang] = float(min(max((ranked[best] + lower) / 2, 0.05), 0.95))


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) != 2


def packed(model: ToxicityModel) -> bytes:
    arrays = {f"filter{k}": weights for k, weights in enumerate(model.filters)}
    out = BytesIO()
    np.savez(out, embedding=model.embedding, bias=model.bias, output=model.output, numbers=np.array([model.intercept, model.slope]),
             langs=np.array(list(model.thresholds), np.str_), limits=np.array(list(model.thresholds.values()), float), **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> ToxicityModel:
    found = np.load(BytesIO(data))
    filters = [found[f"filter{k}"] for k in range(len(WIDTHS))]
    return ToxicityModel(found["embedding"], filters, found["bias"], found["output"], *found["numbers"].tolist(),
                         dict(zip(found["langs"].tolist(), found["limits"].tolist())))


def one_score(rate: float) -> ToxicityModel:
    """The model without two classes to tell apart: every text has the base rate."""
    model, _ = started(np.zeros((2, 1 << BUCKET_BITS)), np.zeros(2))
    model.output[:] = 0
    model.intercept = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    return model


def packed_words(buckets: np.ndarray) -> np.ndarray:
    """The buckets of each word in as many bytes as they need: a row of bytes for each word."""
    whole = np.zeros(len(buckets), np.uint64)
    for k in range(HASHES):
        whole |= buckets[:, k].astype(np.uint64) << np.uint64(k * BUCKET_BITS)
    return whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]


def unpacked_words(data: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(data) // WORD_BYTES, 8), np.uint8)
    whole[:, :WORD_BYTES] = data.reshape(-1, WORD_BYTES)
    whole = whole.view("<u8")[:, 0]
    parts = [whole >> np.uint64(k * BUCKET_BITS) & np.uint64((1 << BUCKET_BITS) - 1) for k in range(HASHES)]
    return np.stack(parts, axis=1).astype(np.int64)


def texts_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Each text's buckets, which are packed or lists."""
    column = batch.column("buckets")
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        data, at = words.buffers(column.cast(pa.binary()))
        values, at = unpacked_words(data), at // WORD_BYTES
        return [values[a:b] for a, b in zip(at[:-1], at[1:])]
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b].reshape(-1, HASHES).astype(np.int64) for a, b in zip(at[:-1], at[1:])]


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many documents of each label hold each bucket."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for row, label in zip(texts_of(batch), batch.column("label").to_pylist()):
                held[label, np.unique(row)] += 1
        some = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(h[some]) for h in held]], names=["bucket", "clean", "toxic"])

    found = (rows.select("label", "buckets").mapInArrow(tally, "bucket long, clean long, toxic long").groupBy("bucket")
             .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow())
    held = np.zeros((2, 1 << BUCKET_BITS))
    at = found["bucket"].to_numpy()
    held[0, at], held[1, at] = found["clean"].to_numpy(), found["toxic"].to_numpy()
    return held


def average_epoch(rows: DataFrame, model: ToxicityModel, squares: np.ndarray, epoch: int) -> None:
    """Every partition trains on its rows from this model; the results are averaged by rows.

    An embedding is averaged over the partitions that changed it. A partition hands over what it
    changed in single precision, block by block, and a block is averaged in the partitions'
    order. What comes back is bounded by the model's size.
    """
    names = [f"v{k}" for k in range(DIMENSIONS + 1)]
    data, n = packed(model), len(dense(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, weight = unpacked(data), squares.copy(), 0
        changed = np.zeros(len(own.embedding), bool)
        for batch in batches:
            order = np.random.default_rng([SEED, epoch, weight]).permutation(batch.num_rows)
            changed |= learn(own, sums, texts_of(batch), batch.column("label").to_numpy(), order)
            weight += batch.num_rows
        if not weight:
            return
        at = np.flatnonzero(changed)
        values = np.zeros((n + len(at), DIMENSIONS + 1), np.float32)
        values[:n, 0], values[:n, -1] = dense(own), sums[:n]
        values[n:, :-1], values[n:, -1] = own.embedding[at], sums[n + at]
        place = np.concatenate([np.arange(n), n + at])
        first = np.flatnonzero(np.diff(place // BLOCK, prepend=-1))
        ends = np.append(first[1:], len(place))
        within = (place % BLOCK).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([
            pa.array(place[first] // BLOCK), pa.array(np.full(len(first), TaskContext.get().partitionId())),
            pa.array(np.full(len(first), weight)), pa.array([within[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
            pa.array([values[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())],
            names=["block", "part", "weight", "within", "held"])

    def mean(block: pa.Table) -> pa.Table:
        sums, weights = np.zeros((BLOCK, DIMENSIONS + 1)), np.zeros(BLOCK)
        for row in block.sort_by("part").to_pylist():
            within = np.frombuffer(row["within"], np.uint16)
            sums[within] += row["weight"] * np.frombuffer(row["held"], np.float32).reshape(-1, DIMENSIONS + 1).astype(np.float64)
            weights[within] += row["weight"]
        some = np.flatnonzero(weights)
        means = sums[some] / weights[some, None]
        return pa.table([pa.array(block["block"][0].as_py() * BLOCK + some), *[pa.array(c) for c in means.T]], ["place", *names])

    parts = rows.select("label", "buckets").mapInArrow(work, "block long, part long, weight long, within binary, held binary")
    found = parts.groupBy("block").applyInArrow(mean, ", ".join(["place long", *[f"{c} double" for c in names]])).toArrow()
    place = found["place"].to_numpy()
    means = np.stack([found[c].to_numpy() for c in names], axis=1)
    squares[place] = means[:, -1]
    values, low = dense(model), place < n
    values[place[low]] = means[low, 0]
    set_dense(model, values)
    model.embedding[place[~low] - n] = means[~low, :-1].astype(np.float32)


def calibrate_rows(rows: DataFrame, model: ToxicityModel, base_rate: float, counts: tuple[int, int]) -> None:
    """`calibrate` over a table: Newton steps by sums of partitions, F1 by counts of equal scores."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            pooled = [model.pooled(row, np.array([0, len(row)]))[0] for row in texts]
            raw = np.array(pooled).astype(np.float64).reshape(len(texts), -1) @ model.output + model.intercept
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label"), pa.array(raw)],
                                             names=["lang", "label", "raw"])

    found = written(rows.select("lang", "label", "buckets").mapInArrow(measure, "lang string, label int, raw double"))
    share = counts[1] / sum(counts)
    heavy = [(1 - base_rate) / (1 - share), base_rate / share]
    slope, shift = 1.0, 0.0
    for _ in range(NEWTON_STEPS):
        def step(batches: Iterator[pa.RecordBatch], slope: float = slope, shift: float = shift) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels = batch.column("label").to_numpy()
                sums = newton_sums(batch.column("raw").to_numpy(), labels, np.where(labels == 1, heavy[1], heavy[0]), slope, shift)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=list("abcde"))

        parts = found.select("label", "raw").mapInArrow(step, ", ".join(f"{c} double" for c in "abcde")).collect()
        move = newton_move([math.fsum(p[k] for p in parts) for k in range(5)], slope)
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-9:
            break
    slope = max(slope, 0.05)
    model.output = model.output * slope
    model.intercept = float(model.intercept * slope + shift)
    score = F.round(1 / (1 + F.exp(-F.greatest(F.least(F.lit(slope) * F.col("raw") + shift, F.lit(40.0)), F.lit(-40.0)))), 6)
    # At most a million scores a language, whatever the rows.
    steps = (found.filter("lang IS NOT NULL").groupBy("lang", score.alias("score"))
             .agg(F.sum("label").alias("hits"), F.count_if(F.col("label") == 0).alias("others")))
    downwards = Window.partitionBy("lang").orderBy(F.desc("score"))
    upto, all_rows = downwards.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("lang")
    hits, others = F.sum("hits").over(upto) * heavy[1], F.sum("others").over(upto) * heavy[0]
    best = (steps.select("lang", "score", (2 * hits / (hits + others + F.sum("hits").over(all_rows) * heavy[1])).alias("f1"),
                         F.lead("score", 1, 0.0).over(downwards).alias("lower"),
                         F.least(F.sum("hits").over(all_rows), F.sum("others").over(all_rows)).alias("least"))
            .filter(F.col("least") >= LEAST_ROWS).groupBy("lang").agg(F.max(F.struct("f1", "score", "lower")).alias("top")))
    for r in sorted(best.collect(), key=lambda r: r["lang"]):
        model.thresholds[r["lang"]] = float(min(max((r["top"]["score"] + r["top"]["lower"]) / 2, 0.05), 0.95))


def likely_among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """`rows` without most of those whose `key` isn't in the column of that name of `ids`.

    None that is there is lost. The ids are hashed into a bitmap of 2^`FILTER_BITS` bits, whatever
    their number, so that texts which no label asks for needn't be dealt out.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(SEED)), F.lit(1 << FILTER_BITS))
    slot, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    masks = ids.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("mask"))
    return (rows.withColumn("bit", bit).join(F.broadcast(masks), slot == F.col("slot"))
            .filter(F.col("mask").bitwiseAND(F.col("bit")) != 0).select(*rows.columns))


def train(docs: DataFrame, labels: DataFrame, part_rows: int = PART_ROWS) -> ToxicityModel:
    """Fit on three of four labelled rows, all of them, and calibrate on all the others.

    Texts are used whole. Rows lie by a hash of their id in partitions of about `part_rows`,
    which train on their own between the epochs' averages; the driver sees models and counts
    only. Rows without label or text, or with an id whose label isn't to be learned, are left
    out. With one class only the model gives every text the same score.
    """
    known = (labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(learnable(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    rate = counts.get(1, 0) / max(total, 1)
    if len(counts) < 2:
        return one_score(rate)
    ids = known.select("doc_id")
    parts = math.ceil(total / part_rows)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))

    def work(ids, texts, langs):
        for first, last, buckets, bounds in word_buckets(texts):
            at = pa.array((bounds * WORD_BYTES).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                ids.slice(first, last - first), langs.slice(first, last - first),
                pa.Array.from_buffers(pa.binary(), last - first, [None, at.buffers()[1], pa.py_buffer(packed_words(buckets).tobytes())])],
                names=["doc_id", "lang", "buckets"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.filter("text IS NOT NULL").filter(learnable(F.col("doc_id"))).select("doc_id", "text", lang.alias("lang"))
    rows = words.map_texts(likely_among(rows, ids, "doc_id"), "doc_id", "text", "doc_id long, lang string, buckets binary", work, {"lang": "lang"})
    order, drawn = F.xxhash64("doc_id", F.lit(SEED)), F.xxhash64("doc_id", "buckets")
    # Dealt once, by id, for the labels and for the training: labels are rows beside their texts.
    rows = (rows.unionByName(known, allowMissingColumns=True).repartition(parts, "doc_id")
            .withColumn("label", F.max("label").over(Window.partitionBy("doc_id")))
            .filter("buckets IS NOT NULL AND label IS NOT NULL"))
    rows = written(rows.withColumn("unseen", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(4)) == 3)
                   .sortWithinPartitions(order, drawn))
    held = {(r["unseen"], r["label"]): r["count"] for r in rows.groupBy("unseen", "label").count().collect()}
    if len({label for _, label in held}) < 2:
        return one_score(rate)
    seen, unseen = rows.filter("NOT unseen"), rows.filter("unseen")
    if len(held) < 4:
        seen = unseen = rows
        both = [sum(n for (_, label), n in held.items() if label == k) for k in (0, 1)]
        held = {(u, k): both[k] for u in (False, True) for k in (0, 1)}
    model, squares = started(bucket_counts(seen), np.array([held[False, k] for k in (0, 1)], float))
    for epoch in range(EPOCHS):
        average_epoch(seen, model, squares, epoch)
    calibrate_rows(unseen, model, rate, (held[True, 0], held[True, 1]))
    return model


def score_texts(model: ToxicityModel, texts: pa.Array) -> np.ndarray:
    parts = [model.score(model.pooled(buckets, bounds)) for _, _, buckets, bounds in word_buckets(texts)]
    return np.round(np.concatenate([*parts, np.zeros(0)]), 6)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Columns doc_id, score, threshold (of the row's language) for each row.

    Whole texts are scored; null and empty texts get the score of a text without words.
    Language and id have no part in the score. Repeated rows are scored alike; an empty
    table gives an empty result. Other columns are not looked at.
    """
    def work(ids, texts, langs):
        limits = [model.thresholds.get(x, THRESHOLD) for x in langs.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(score_texts(model, texts)), pa.array(limits, pa.float64())],
            names=["doc_id", "score", "threshold"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return words.map_texts(docs.select("doc_id", "text", lang.alias("lang")), "doc_id", "text",
                           "doc_id long, score double, threshold double", work, {"lang": "lang"})


def accept(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs` whose score is below their language's threshold, with all columns.

    Null and empty texts have the score of a text without words; repeated rows go or stay
    together; rows without an id are judged like all others. Whole texts are scored. An empty
    table gives an empty result.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).fill_null("")
            scores = score_texts(model, texts)
            langs = batch.column(names.index("lang")).to_pylist() if "lang" in names else [None] * len(scores)
            limits = np.array([model.thresholds.get(x, THRESHOLD) for x in langs])
            yield batch.filter(pa.array(scores < limits))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold",
        (F.col("score") >= F.col("threshold")).alias("rejected"))
