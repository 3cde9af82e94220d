"""The quality labellers and the toxicity network against plain loops."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from hubloom.llm import quality, toxicity

SYMBOLS = set(b"#$%&*|<>{}[]^~=_\\/@+")
SPACE = {0x20, *range(9, 14)}
TEXTS = ["", "   ", "One two, THREE four. Five!! six?", "the the the of and la la", "### a_b {x} [y] ~~", "line one\nline one\n\nline two\r\nline one",
         "Größe über naïve façade élan " * 6, "x", "A" * 300, "a.. b.! c! d?! e. f", "word " * 50, "lorem ipsum dolor sit amet. " * 9 + "IPSUM ipsum"]


def split(data, inside):
    parts, now = [], bytearray()
    for byte in data:
        if inside(byte):
            now.append(byte)
        elif now:
            parts.append(bytes(now))
            now = bytearray()
    return parts + ([bytes(now)] if now else [])


def lowered(word):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in word)


def plain_facts(text):
    data = text.encode()
    words = split(data, lambda b: b not in SPACE)
    plain = [lowered(w) for w in split(data, lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)]
    lines = split(data, lambda b: b not in b"\n\r")
    marks = sum(b not in SPACE for b in data)
    upper, lower = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data)
    common = {w.encode() for w in quality.COMMON}
    ends = sum(w[-1] in b".!?" for w in words)
    marked = sum(w[-1] in SYMBOLS or (len(w) > 1 and w[-1] in b".!?" and w[-2] in b".!?") for w in words)
    n = max(len(words), 1)
    return [len(words), sum(b in SYMBOLS for b in data) / max(marks, 1), upper / max(upper + lower, 1),
            sum(w in common for w in plain) / max(len(plain), 1),
            sum(a == b for a, b in zip(plain, plain[1:])) / max(len(plain), 1), len({lowered(w) for w in words}) / n,
            len(words) / max(ends, 1), (len(lines) - len(set(lines))) / max(len(lines), 1), marks / n, marked / n]


def corpus():
    draw = random.Random(3)
    pool = "the der of la Wort word, Satz. END! a_b ## 12 x\n y\r\n é ... z?!".split(" ")
    return TEXTS + ["".join(draw.choice(pool) + draw.choice([" ", "  ", "\n"]) for _ in range(draw.randint(1, 120))) for _ in range(80)]


def facts_of(texts):
    return np.concatenate([b.facts for _, _, b in quality.batches(pa.array(texts))])


def test_facts_are_those_of_plain_loops():
    texts = corpus()
    for text, found in zip(texts, facts_of(texts)):
        assert found.tolist() == pytest.approx(plain_facts(text)), text


def plain_votes(f):
    words, symbols, capitals, common, adjacent, distinct, sentence, lines, length, marked = f
    some = words >= 10

    def vote(bad, good):
        return 0 if bad else 1 if good else 2

    return [vote(words < 1, words > 40), vote(symbols > 0.06, symbols < 0.01), vote(some and capitals > 0.4, capitals < 0.15),
            vote(some and common < 0.04, some and common > 0.12), vote(some and adjacent > 0.2, some and adjacent < 0.05),
            vote(some and distinct < 0.08, some and distinct > 0.3), vote(some and sentence > 80, some and 3 < sentence < 40),
            vote(lines > 0.4, lines < 0.1), vote(some and (length > 14 or length < 2.5), some and 3.5 < length < 9),
            vote(some and marked > 0.15, some and marked < 0.03)]


def test_votes_are_those_of_plain_rules():
    facts = facts_of(corpus())
    assert quality.votes(facts).tolist() == [plain_votes(f) for f in facts.tolist()]


def em_by_document(votes, rounds):
    """Expectation-maximisation document by document, with the pseudo-counts of the operator."""
    prior = {1: (0.2, 20.0), 0: (6.0, 10.0)}
    says = {c: [[prior[c][v] / sum(prior[c]) for v in (0, 1)] for _ in votes[0]] for c in (0, 1)}
    share, chance, moved = 0.85, [0.0] * len(votes), 1.0
    for _ in range(rounds):
        new = []
        for cast in votes:
            odds = math.log(share / (1 - share))
            for k, v in enumerate(cast):
                if v != 2:
                    odds += math.log(says[1][k][v]) - math.log(says[0][k][v])
            new.append(1 / (1 + math.exp(-max(-60.0, min(60.0, odds)))))
        for c in (0, 1):
            for k in range(len(votes[0])):
                held = [prior[c][v] + sum(p if c else 1 - p for p, cast in zip(new, votes) if cast[k] == v) for v in (0, 1)]
                says[c][k] = [h / sum(held) for h in held]
        share = (sum(new) + 8.5) / (len(new) + 10)
        moved, chance = max(abs(a - b) for a, b in zip(new, chance)), new
        if moved < 1e-6:
            break
    return chance, moved


def test_em_is_that_of_single_documents():
    votes = quality.votes(facts_of(corpus()))
    patterns, place, counts = np.unique(votes @ quality.POWERS, return_inverse=True, return_counts=True)
    chances, _ = quality.pattern_chances(patterns, counts)
    expected, moved = em_by_document(votes.tolist(), 200)
    assert moved < 1e-6  # settled before the last round
    assert [chances[patterns[k]] for k in place.reshape(-1)] == pytest.approx(expected, abs=1e-8)


def small_model(seed=1):
    draw = np.random.default_rng(seed)
    size = 1 << toxicity.BUCKET_BITS
    embedding = draw.normal(size=(size + 1, toxicity.DIMENSIONS)).astype(np.float32)
    embedding[-1] = 0
    filters = [draw.normal(size=(w, toxicity.DIMENSIONS, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    count = len(toxicity.WIDTHS) * toxicity.FILTERS
    return toxicity.ToxicityModel(embedding, filters, draw.normal(size=count).astype(np.float32), draw.normal(size=count), 0.1)


def test_convolution_and_pooling_are_those_of_plain_loops():
    model, draw = small_model(), np.random.default_rng(2)
    lengths = [0, 1, 2, 3, 7, 0, 40]
    texts = [draw.integers(0, 1 << toxicity.BUCKET_BITS, (n, toxicity.HASHES)) for n in lengths]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    pooled = model.pooled(np.concatenate(texts), bounds)
    for text, found in zip(texts, pooled):
        vectors = [sum(model.embedding[b].astype(float) for b in row) for row in text]
        vectors += [np.zeros(toxicity.DIMENSIONS)] * toxicity.PAD
        wanted = []
        for weights, bias in zip(model.filters, model.bias.reshape(len(toxicity.WIDTHS), -1)):
            for f in range(toxicity.FILTERS):
                values = [sum(vectors[i + s] @ weights[s][:, f] for s in range(len(weights))) for i in range(len(text))]
                wanted.append(max(0.0, max(values) + bias[f]) if values else 0.0)
        assert found.tolist() == pytest.approx(wanted, abs=1e-4)


def test_thresholds_are_those_of_an_exhaustive_search():
    model, draw = small_model(), np.random.default_rng(4)
    n = 600
    labels = (draw.random(n) < 0.4).astype(int)
    langs = np.array(draw.choice(["en", "de", "xx"], n, p=[0.5, 0.45, 0.05]).tolist(), object)
    pooled = np.abs(draw.normal(size=(n, len(model.bias)))).astype(np.float32)
    pooled[labels == 1] += (0.3 * np.sign(model.output)).astype(np.float32)
    toxicity.calibrate(model, pooled, labels, langs, base_rate=0.1)
    scores, share = model.score(pooled), labels.mean()
    weight = np.where(labels == 1, 0.1 / share, 0.9 / (1 - share))
    few = [x for x in ("en", "de", "xx") if min(np.bincount(labels[langs == x], minlength=2)) < toxicity.LEAST_ROWS]
    assert few == ["xx"] and set(model.thresholds) == {"en", "de"}
    for lang, threshold in model.thresholds.items():
        own = langs == lang

        def f1(cut):
            called = scores[own] >= cut
            hits = weight[own][called & (labels[own] == 1)].sum()
            return 2 * hits / (weight[own][called].sum() + weight[own][labels[own] == 1].sum())

        best = max(f1(cut) for cut in scores[own])
        assert 0.05 <= threshold <= 0.95
        if 0.05 < threshold < 0.95:
            assert f1(threshold) == pytest.approx(best)


def test_a_packed_model_is_the_same():
    model = small_model()
    model.thresholds = {"en": 0.4, "ü": 0.25}
    again = toxicity.unpacked(toxicity.packed(model))
    assert (again.embedding == model.embedding).all() and all((a == b).all() for a, b in zip(again.filters, model.filters))
    assert (again.bias == model.bias).all() and (again.output == model.output).all()
    assert (again.intercept, again.slope, again.thresholds) == (model.intercept, model.slope, model.thresholds)


def test_calibration_of_a_table_is_that_of_arrays(spark):
    draw = np.random.default_rng(6)
    model, other = small_model(3), small_model(3)
    texts = [draw.integers(0, 1 << toxicity.BUCKET_BITS, (int(draw.integers(0, 9)), toxicity.HASHES)) for _ in range(300)]
    pooled = model.pooled(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    raw = pooled @ model.output
    labels = (raw + draw.normal(size=300) * raw.std() > raw.mean()).astype(int)
    langs = np.array(draw.choice(["en", "de"], 300).tolist(), object)
    toxicity.calibrate(other, pooled, labels, langs, base_rate=0.2)
    rows = spark.createDataFrame([(g, int(x), t.reshape(-1).tolist()) for g, x, t in zip(langs, labels, texts)],
                                 "lang string, label int, buckets array<int>").repartition(3)
    toxicity.calibrate_rows(rows, model, 0.2, (int((labels == 0).sum()), int(labels.sum())))
    assert model.intercept == pytest.approx(other.intercept, abs=1e-4) and model.output == pytest.approx(other.output, abs=1e-4)
    assert model.thresholds == pytest.approx(other.thresholds, abs=1e-4) and set(model.thresholds) == {"de", "en"}
