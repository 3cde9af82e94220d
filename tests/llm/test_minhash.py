import random

import numpy as np
import pyarrow as pa
import pytest

from hubloom.llm import minhash


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts, percent=75):
    sets = {i: shingles(t.lower()) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def family(rng, base, copies, edits):
    """Copies of a text with some words replaced, so that similarities lie around the threshold."""
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for size, copies, edits in ((120, 60, 8), (90, 40, 6), (40, 12, 2), (300, 20, 20), (150, 25, 12)):
        texts += family(rng, [f"v{rng.randrange(5000)}" for _ in range(size)], copies, edits)
    texts += [" ".join(f"u{rng.randrange(9000)}" for _ in range(60)) for _ in range(60)] + texts[:15] + ["a b", "a b", "A B c d e"]
    rng.shuffle(texts)
    given = dict(enumerate(texts))
    expected, sizes = brute_components(given)
    rows = minhash.near_duplicates(spark.createDataFrame(list(given.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_signature_is_circulant():
    shingles = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    signature = minhash.signatures(shingles, np.array([0, 20, 50]), 8)
    places = minhash.circle_place(shingles)
    for k in range(8):
        shifted = places - np.uint32(k)
        values = minhash.circle_value(shifted, np.empty_like(shifted), np.empty_like(shifted))
        assert signature[0, k] == values[:20].min() and signature[1, k] == values[20:].min()


def test_second_permutation_is_one():
    places = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65521)
    values = minhash.circle_value(places, np.empty_like(places), np.empty_like(places))
    assert len(np.unique(values)) == len(places)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.75, 0.9):
        n = 2000
        common = rng.integers(0, 2**63, int(n * share)).astype(np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, (n - len(common)) // 2).astype(np.uint64)]) for _ in range(2))
        signature = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
        assert abs((signature[0] == signature[1]).mean() - share) < 0.08


@pytest.mark.parametrize("text", ["", "  ", "one", "One two three four five six", "ünï cödé " * 20, "a  b\tc\nd e f"])
def test_sets_are_the_texts_shingles(text):
    (_, _, hashes, before), = minhash.shingle_sets(pa.array([text]))
    assert before[-1] == len(hashes) == len(shingles(text.lower()))


def test_an_id_with_several_texts_loses_no_link(spark):
    """The smaller text of id 1 is a near copy of id 2, the larger one of id 3."""
    small, large = [f"s{k}" for k in range(40)], [f"l{k}" for k in range(60)]
    rows = [(1, " ".join(large)), (1, " ".join(small)), (2, " ".join([*small, "more"])), (3, " ".join([*large, "more"])),
            (4, "a text of its own with several words"), (4, "another text under the same id as before"), (1, " ".join(small))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert len(found) == 7 and {r["doc_id"] for r in found if not r["kept"]} == {2, 3}


def test_keep_one_judges_rows(spark):
    rng = random.Random(8)
    base = [f"v{k}" for k in range(80)]
    texts = [*family(rng, base, 12, 3), "own words of a first text", "own words of a second text here", None, "", " ", " "]
    rows = [(k % 5 if k % 7 else None, t, "x", k) for k, t in enumerate(texts)] + [(9, texts[12], "x", 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, place int")
    kept = minhash.keep_one(docs)
    places = [r["place"] for r in kept.collect()]
    groups, _ = brute_components({k: t or "" for k, t in enumerate(texts[:14])})
    assert kept.columns == docs.columns and len(set(places)) == len(places)
    assert sorted(groups[p] for p in places if p < 14) + [p for p in places if p == 99] == sorted(set(groups.values())) or \
        sorted(groups[12 if p == 99 else p] for p in places if p < 14 or p == 99) == sorted(set(groups.values()))
    assert {14, 15, 16, 17} <= set(places)
    assert minhash.keep_one(docs.filter("false")).count() == 0


def test_a_crowd_at_the_threshold_leaves_few_pairs_to_the_exact_pass(spark, monkeypatch):
    """Copies without their original, each with edits: most pairs link, none shares all bands."""
    rng, pairs, exact = random.Random(11), [], minhash.rare_prefix_pairs
    base = [f"v{k}" for k in range(150)]
    texts = {}
    for k in range(240):
        words = list(base)
        for place in rng.sample(range(50), 3):
            words[place] = f"w{k}x{place}"
        texts[k] = " ".join(words)

    def counted(*given):
        found = minhash.written(exact(*given))
        pairs.append(found.count())
        return found

    monkeypatch.setattr(minhash, "rare_prefix_pairs", counted)
    rows = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(texts)[0]
    assert pairs[0] <= 4 * len(texts)


def test_tables_have_partitions_for_their_rows(spark, monkeypatch):
    """Where small shuffle partitions aren't put together, links and members aren't as many files."""
    rng, counts, write = random.Random(4), [], minhash.written
    texts = dict(enumerate(family(rng, [f"v{k}" for k in range(60)], 40, 12)))

    def counted(*given):
        found = write(*given)
        counts.append(found.rdd.getNumPartitions())
        return found

    monkeypatch.setattr(minhash, "written", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(texts)[0]
    assert max(counts[2:]) == 1


def test_the_exact_pass_leaves_sets_that_share_too_little_with_others(spark, monkeypatch):
    """Of 100 shingles 70 are their component's own: whatever their order, no pair across is similar."""
    rows, write = [], minhash.written
    sets = [(node, [1000 * (node % 2) + k for k in range(70)] + [5000 + 100 * (node // 2) + k for k in range(30)]) for node in range(6)]
    sets += [(6, list(range(9000, 9080))), (7, list(range(9000, 9079)) + [1])]
    members = [(node, node % 2) for node in range(6)] + [(6, 6), (7, 7)]

    def counted(*given):
        found = write(*given)
        rows.extend(found.collect())
        return found

    monkeypatch.setattr(minhash, "written", counted)
    pairs = minhash.rare_prefix_pairs(spark.createDataFrame(members, "node long, component long"),
                                      spark.createDataFrame(sets, "doc_id long, shingles array<long>"), 75)
    assert [tuple(r) for r in pairs.collect()] == [(6, 7)]
    assert {r["node"] for r in rows} == {6, 7}
