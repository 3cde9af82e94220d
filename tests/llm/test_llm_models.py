"""Toxicity and quality: held-out accuracy, gradients, expectation-maximisation."""

import os

import numpy as np
import pyarrow as pa
import pytest

from hubloom.llm import quality, toxicity


@pytest.fixture(scope="module")
def folder():
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("test tables not present")
    return path


def test_toxicity_on_held_out_rows(spark, folder):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = toxicity.op9_toxicity(spark, folder).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        label = int(rng.random() < 0.3)
        given = [f"w{int(k)}" for k in rng.zipf(1.3, rng.integers(5, 80)) % 4000]
        if label:
            given.insert(int(rng.integers(len(given))), ["bad", "worse", "worst"][i % 3])
        texts.append(" ".join(given))
        labels.append(label)
    rows = []
    for _, _, buckets, bounds in toxicity.word_buckets(pa.array(texts)):
        rows += [buckets[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return texts, rows, np.array(labels)


def test_network_learns_single_words():
    _, rows, labels = toxic_rows(600, 1)
    model = toxicity.fit(rows, labels)
    texts, _, truth = toxic_rows(300, 2)
    scores = toxicity.score_texts(model, pa.array(texts))
    assert np.mean((scores >= 0.5) == truth) > 0.95


def test_scores_depend_on_the_text_alone():
    _, rows, labels = toxic_rows(60, 3)
    model = toxicity.fit(rows, labels, epochs=1)
    texts = ["a bad one", "", "x " * 3000 + "worst", "ü"]
    together = toxicity.score_texts(model, pa.array(texts))
    assert together.tolist() == [toxicity.score_texts(model, pa.array([t]))[0] for t in texts]


def test_gradient_is_of_the_loss():
    _, rows, labels = toxic_rows(20, 4)
    model = toxicity.fit(rows, labels, epochs=1)
    row, label = rows[0], 1

    def loss():
        pooled = model.pooled(row, np.array([0, len(row)])).astype(float)
        return float(-np.log(model.score(pooled)[0]))

    grads = {"bias": np.zeros_like(model.bias), "output": np.zeros_like(model.output), "intercept": 0.0,
             "filters": [np.zeros_like(w) for w in model.filters], "at": [], "by": []}
    toxicity.backward(model, row, label, grads)
    for array, grad, at in ((model.output, grads["output"], 3), (model.bias, grads["bias"], 2),
                            (model.filters[1], grads["filters"][1], (1, 0, 2))):
        kept, values = array[at], []
        for sign in (1, -1):
            array[at] = kept + sign * 1e-2
            values.append(loss())
        array[at] = kept
        assert grad[at] == pytest.approx((values[0] - values[1]) / 2e-2, abs=2e-2)


def test_thresholds_are_by_language():
    _, rows, labels = toxic_rows(400, 5)
    model = toxicity.fit(rows, labels)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    langs = np.array([["en", "de", "xx"][i % 3 if i < 390 else 0] for i in range(400)], object)
    langs[5] = None
    toxicity.calibrate(model, model.pooled(np.concatenate(rows), bounds), labels, langs, 0.1)
    assert {"en", "de", "xx"} == set(model.thresholds) and all(0.05 <= t <= 0.95 for t in model.thresholds.values())


def test_quality_against_labels(spark, folder):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in quality.op4_quality(spark, folder).collect() if r["doc_id"] in labels]
    kept = np.array([r["kept"] for r in rows])
    truth = np.array([labels[r["doc_id"]] == 1 for r in rows])
    assert (kept == truth).mean() >= 0.97 and kept[truth].mean() >= 0.97


def test_expectation_maximisation_finds_the_labellers():
    """Votes drawn from known tables: the estimates come near them, and the classes apart."""
    rng = np.random.default_rng(7)
    n, wrong = 20_000, np.linspace(0.01, 0.05, quality.LABELLERS)
    good = rng.random(n) < 0.8
    cast = np.empty((n, quality.LABELLERS), np.int64)
    for k in range(quality.LABELLERS):
        bad_vote = np.where(good, rng.random(n) < wrong[k], rng.random(n) < 0.5)
        cast[:, k] = np.where(rng.random(n) < 0.1, quality.NONE, np.where(bad_vote, quality.BAD, quality.GOOD))
    patterns, of, counts = np.unique(cast @ quality.POWERS, return_inverse=True, return_counts=True)
    chances, table = quality.pattern_chances(patterns, counts.astype(float))
    found = np.array([chances[p] for p in patterns.tolist()])[of]
    assert ((found >= 0.5) == good).mean() > 0.97
    assert np.abs(table[quality.GOOD, :, quality.BAD] - wrong).max() < 0.02
    assert np.abs(table[quality.BAD, :, quality.BAD] - 0.5).max() < 0.05


def test_toxicity_is_learned_from_all_labelled_rows(spark):
    """Partitions that train apart: a word in few rows of thousands is learned, thresholds are calibrated."""
    texts, _, truth = toxic_rows(9000, 7)
    texts[4000:4400] = [f"{t} seldom" for t in texts[4000:4400]]
    truth[4000:4400] = 1
    rows = [(k, t, "en" if k % 2 else "de") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(x)) for k, x in enumerate(truth)], "doc_id long, toxic int")
    seen = []

    def counted(found, *more):
        seen.append(found.count())
        return average(found, *more)

    average = toxicity.average_epoch
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "average_epoch", counted)
        model = toxicity.train(docs, labels, part_rows=1000)
    known = docs.filter(toxicity.learnable(docs.doc_id)).count()
    assert 0.7 * known < seen[0] < 0.8 * known and len(seen) == toxicity.EPOCHS
    fresh, _, wanted = toxic_rows(400, 8)
    scores = toxicity.score_texts(model, pa.array(fresh))
    assert np.mean((scores >= 0.5) == wanted) > 0.95
    assert np.mean(toxicity.score_texts(model, pa.array([f"{t} seldom" for t in fresh])) >= 0.5) > 0.9
    assert set(model.thresholds) == {"en", "de"}


def test_texts_without_labels_are_not_dealt_out(spark):
    """What the labels don't ask for goes no further than its first task; what they ask for all does."""
    docs = spark.range(20000).selectExpr("id AS doc_id", "concat('a text ', id) AS text")
    ids = spark.range(0, 20000, 100).selectExpr("id AS doc_id")
    kept = {r["doc_id"] for r in toxicity.likely_among(docs, ids, "doc_id").collect()}
    assert set(range(0, 20000, 100)) <= kept and len(kept) < 210


def test_a_partition_hands_over_little_more_than_what_it_changed(spark, monkeypatch):
    """Bytes between training and averaging: nine values in single precision and a place for each."""
    draw = np.random.default_rng(2)
    texts = [draw.integers(0, 1 << toxicity.BUCKET_BITS, (30, toxicity.HASHES)) for _ in range(200)]
    rows = spark.createDataFrame([(k % 2, bytearray(toxicity.packed_words(t).tobytes())) for k, t in enumerate(texts)],
                                 "label int, buckets binary").coalesce(1)
    model, squares = toxicity.started(np.zeros((2, 1 << toxicity.BUCKET_BITS)), np.array([100.0, 100.0]))
    alone, sums = toxicity.started(np.zeros((2, 1 << toxicity.BUCKET_BITS)), np.array([100.0, 100.0]))
    whole, frame = [], type(rows)
    ran = frame.mapInArrow

    def sized(self, *given):
        found = ran(self, *given).cache()
        whole.append(found.toArrow())
        return found

    monkeypatch.setattr(frame, "mapInArrow", sized)
    toxicity.average_epoch(rows, model, squares, 0)
    order = np.random.default_rng([toxicity.SEED, 0, 0]).permutation(len(texts))
    changed = toxicity.learn(alone, sums, texts, np.arange(len(texts)) % 2, order)
    n = len(toxicity.dense(alone))
    assert whole[0].nbytes < 40 * (changed.sum() + n) + 64 * (len(changed) + n) // toxicity.BLOCK + 200
    assert np.abs(model.embedding - alone.embedding).max() < 1e-6
    assert np.abs(toxicity.dense(model) - toxicity.dense(alone)).max() < 1e-6
    assert squares[:-1] == pytest.approx(sums[:-1], rel=1e-6)  # the last row stands for no word
