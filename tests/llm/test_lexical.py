"""Ranked lexical search against a plain loop over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from hubloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, top=20):
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    held = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item, text in items:
        scores = []
        for doc_id, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0 and doc_id is not None:
                scores.append((-score, doc_id))
        rows += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(rows)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in lexical.search_items(docs, items, **options).collect())


def corpus(seed, n):
    draw = random.Random(seed)
    lexicon = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 4))) for _ in range(300)]
    word = lambda: lexicon[min(int(draw.expovariate(0.02)), 299)]
    docs = [(k, " ".join(word() for _ in range(draw.choice([1, 3, 20, 60, 200])))) for k in range(n)]
    docs += [(n + k, docs[5][1]) for k in range(n // 3)]  # a crowd of copies
    items = [(k, ", ".join(word() for _ in range(draw.randint(1, 25)))) for k in range(12)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    docs, items = corpus(seed, 900)
    assert found(spark, docs, items) == ranked(docs, items)


def test_several_passes_and_tries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PASS_TERMS", 40)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 500)
    docs, items = corpus(3, 300)
    assert found(spark, docs, items, top=7) == ranked(docs, items, top=7)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " .,; "), (4, "Alpha alpha BETA"), (4, "alpha"), (5, "alpha beta " * 30000), (None, "alpha gamma"),
            (7, "ÀB àb"), (8, "alpha"), (9, "alpha")]
    items = [(1, "ALPHA alpha"), (2, None), (3, "unknown"), (4, "gamma Àb"), (None, "alpha"), (6, "beta"), (6, "alpha")]
    want = ranked(docs, [(1, "ALPHA alpha"), (3, "unknown"), (4, "gamma Àb"), (6, "beta alpha")])
    assert found(spark, docs, items) == want and {r[0] for r in want} == {1, 4, 6}


def test_no_rows_and_clashes(spark):
    docs, items = corpus(4, 40)
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [(1, None)], items) == []
    frame = spark.createDataFrame([(d, t, "x", "x", "x") for d, t in docs], "doc_id long, text string, n string, path string, score string")
    asked = spark.createDataFrame([(i, t, "x", "x") for i, t in items], "item_id long, text string, term string, doc_id string")
    assert sorted(tuple(r) for r in lexical.search_items(frame, asked).collect()) == ranked(docs, items)


def test_nodes_bound_their_documents():
    draw = np.random.default_rng(5)
    sizes = draw.integers(1, 12, 500)
    rows = sorted((tuple(sorted(draw.choice(40, n, replace=False).tolist())) for n in sizes))
    before = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    terms_ = np.concatenate([np.array(r) for r in rows])
    trie = lexical.Trie(lexical.Vectors(before, terms_, draw.integers(1, 9, len(terms_)), draw.integers(75, 900, 500),
                                        draw.permutation(500)))
    weights = draw.integers(0, 5000, 40)
    below = trie.levels[0].scores(0, 500, weights)
    for level, cuts in zip(trie.levels[1:], trie.cuts[1:]):
        bounds = level.scores(0, len(level.m), weights)
        highest = np.maximum.reduceat(below, cuts[:-1])
        assert cuts[0] == 0 and cuts[-1] == len(below) and (bounds >= highest).all()
        below = highest
    assert len(trie.levels[-1].m) == 1 and np.diff(trie.cuts[1]).max() <= lexical.LEAF
