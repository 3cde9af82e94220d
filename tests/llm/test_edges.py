"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hubloom.llm import (ann, licenses, minhash, mixing, neargraph, pii, quality, segmentations, sharding, toxicity)

LONG = "long text of many words " * 8000
ROWS = [
    (1, "", "en", "a"), (2, None, None, None), (None, "a text without id and five words", "en", "a"),
    (3, LONG, "de", "b"), (4, "five words are here now", "en", "a"), (5, "five words are here now", "en", "a"),
    (5, "five words are here now", "en", "a"), (6, "  \t\n ", "xx", "c"), (7, "idiot mail a@b.co +1 (988) 555-2485", "en", None),
    (8, "x", None, "b"), (9, "é" * 300, "fr", "a"),
]
# Names that the operators use for columns of their own.
CLASHES = ["score", "kept", "component_id", "size", "spans", "item", "draw", "bands", "band", "node", "shard", "slot", "target",
           "taken", "repeats", "of", "label", "labels", "pieces", "tokens", "n_words", "base", "threshold", "pattern", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return rows.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 7)) for i in range(1, 10)] + [(None, 1, 1), (4, None, None)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def vocabulary():
    return segmentations.read_vocabulary()


def by_row(spark, labels, vocabulary):
    """Operators that give a row (or, for segmentations, some) for each row of documents."""
    return {
        "licenses": licenses.scan, "minhash": minhash.near_duplicates, "mixing": mixing.mixing_plan,
        "quality": lambda d: quality.score_documents(d, *quality.train(d)),
        "pii": lambda d: pii.find_personal(d, pii.train(d)), "sharding": sharding.shard_documents,
        "toxicity": lambda d: toxicity.score_documents(d, toxicity.train(d, labels)),
        "segmentations": lambda d: segmentations.sample_segmentations(d, vocabulary),
    }


NAMES = ["licenses", "minhash", "mixing", "quality", "pii", "sharding", "toxicity", "segmentations"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(spark, docs, labels, vocabulary, name):
    rows = by_row(spark, labels, vocabulary)[name](docs).collect()
    counted = [r for r in rows if name != "segmentations" or r["sample"] == 1]
    assert sorted(str(r["doc_id"]) for r in counted) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_no_rows_give_no_rows(spark, docs, labels, vocabulary, name):
    result = by_row(spark, labels, vocabulary)[name](docs.filter("false"))
    assert result.count() == 0 and len(result.columns) > 1


def test_minhash_rows(spark, docs):
    rows = minhash.near_duplicates(docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert found[1]["n_shingles"] == found[2]["n_shingles"] == found[6]["n_shingles"] == 0
    assert found[2]["component_id"] == 2 and found[2]["kept"]
    assert found[None]["component_id"] is None and found[None]["kept"]
    assert found[5]["component_id"] == 4 and not found[5]["kept"] and found[4]["kept"]
    assert found[8]["n_shingles"] == 1 and found[3]["n_shingles"] == 5


def test_empty_texts_are_defined(spark, docs, labels):
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert found[2]["n_words"] == 0 and found[2]["first_word"] is None and found[2]["labels"] == "" and found[2]["score"] == 0
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}
    assert scores[1] == scores[2] == scores[6]
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal(docs, pii.train(docs)).collect()}
    assert spans[2] == "" and spans[7] == "email:11:17,phone:18:35"


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = {r["score"] for r in toxicity.score_documents(docs, toxicity.train(docs, none)).collect()}
    assert len(scores) == 1


VECTORS = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]),
           (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (9, [0.0, 1.0]),
           (100, [float("inf"), 1.0]), (10, [0.0, 1e300]), (150, [-1.0, 0.0])]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    return rows.withColumns({c: F.lit("x") for c in ["label", "n_links", "leader", "block", "near", "rank", "score", "component_id"]})


def test_vector_edges(spark, vectors):
    rows = neargraph.near_vectors(vectors).collect()
    assert len(rows) == len(VECTORS)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}
    assert found[1] == (2, 1) and found[2] == (2, 1) and found[50] == (2, 1) and found[9] == (1, 9) and found[10] == (1, 9)
    assert all(found[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 100, 150)) and found[None] == (0, None)
    near = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(vectors).collect()]
    assert sorted(x for x in near if x[0] == 50) == [(50, 1, 1), (50, 2, 2), (50, 3, 9), (50, 4, 10), (50, 5, 150)]
    assert {x[0] for x in near} == {50, 150}


def test_no_vectors(spark, vectors):
    assert neargraph.near_vectors(vectors.filter("false")).count() == 0
    assert ann.nearest(vectors.filter("false")).count() == 0
    assert {r["n_links"] for r in neargraph.near_vectors(vectors.filter("vec_id = 4")).collect()} == {0}


def test_stages_keep_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, rows, str(tmp_path))
            if name != "segmentations":
                assert result.columns == rows.columns
            assert result.count() <= 2 * rows.count()
