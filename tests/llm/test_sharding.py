import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from hubloom.llm import sharding


def test_laws(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 900) + f" {i}" for i in range(3000)]
    texts += ["the same short text"] * 1500 + ["another one " * 5] * 30 + [None] * 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(24)]
    assert max(sizes) - min(sizes) <= 0.02 * np.mean(sizes)
    counts = [sum(1 for r in rows if r["shard"] == s) for s in range(24)]
    assert max(counts) <= 1.1 * np.mean(counts)  # the crowd of equal texts is split
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert len({r["shard"] for r in rows if texts[r["doc_id"]] == "another one " * 5}) == 1
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_pack_takes_the_highest_dot_product():
    vectors = np.random.default_rng(1).integers(1, 100, (40, 3)).astype(float)
    placed = sharding.pack(vectors, 4)
    scaled = vectors * 4 / vectors.sum(axis=0)
    residual = np.ones((4, 3))
    for item in np.argsort(-scaled.max(axis=1), kind="stable"):
        scores = [sum(w * a * b for w, a, b in zip(sharding.MEASURE_WEIGHTS, scaled[item], r)) for r in residual]
        assert scores[placed[item]] >= max(scores) - 1e-12
        residual[placed[item]] -= scaled[item]


def test_splits_are_bounded(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("one text for all").alias("text"))
    counts = [r["count"] for r in sharding.shard_documents(docs).groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) - min(counts) <= 0.25 * np.mean(counts)


def spread(vectors, placed, shards):
    sums = np.zeros((shards, vectors.shape[1]))
    np.add.at(sums, placed, vectors)
    return (sums.max(axis=0) - sums.min(axis=0)) / sums.mean(axis=0)


def test_all_measures_are_balanced_and_bundles_cost_little():
    """Groups placed one by one, and as bundles: bytes first, tokens and rows within some percent."""
    rng = np.random.default_rng(7)
    size = np.ceil(rng.lognormal(7, 1.2, 40_000))
    rows = rng.choice([1, 1, 1, 2, 5], len(size)).astype(float)
    vectors = np.stack([size * rows, np.ceil(size / rng.uniform(4, 9, len(size))) * rows, rows], axis=1)
    alone = spread(vectors, sharding.pack(vectors, 24), 24)
    bundle = rng.integers(0, 24 * sharding.BUNDLES, len(size))
    bundles = np.zeros((24 * sharding.BUNDLES, 3))
    np.add.at(bundles, bundle, vectors)
    together = spread(vectors, sharding.pack(bundles, 24)[bundle], 24)
    assert alone[0] < 0.002 and (alone[1:] < 0.03).all()
    assert together[0] < 0.002 and (together[1:] < 0.03).all()
