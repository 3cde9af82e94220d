"""All stages of the pipeline, one after the other, against plain counterparts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hubloom.llm import mixing, pii, segmentations, toxicity
from hubloom.llm.tables import read_table
from test_minhash import brute_components


@pytest.fixture(scope="module")
def stages(spark, small_folder):
    """What each stage has made of the documents, as written tables."""
    docs, kept = read_table(spark, small_folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept[f"before {name}"] = docs
        docs = corpus_pipeline.stored(stage(spark, docs, small_folder))
        kept[name] = docs
    return kept


def test_toxic_documents_go_and_others_stay(spark, stages, small_folder):
    docs = stages["before toxicity"]
    model = toxicity.train(docs, read_table(spark, small_folder, "labels"))
    scored = toxicity.score_documents(docs, model)
    want = [r["doc_id"] for r in scored.filter("score < threshold").collect()]
    assert sorted(want) == sorted(r["doc_id"] for r in stages["toxicity"].collect()) and want


def test_one_of_each_group_stays(stages):
    texts = {r["doc_id"]: r["text"] or "" for r in stages["before minhash"].collect()}
    groups, _ = brute_components(texts)
    kept = [groups[r["doc_id"]] for r in stages["minhash"].collect()]
    assert sorted(kept) == sorted(set(groups.values())) and len(kept) < len(texts)


def test_masked_texts_hold_no_base_span(stages):
    before, after = ({r["doc_id"]: r["text"] for r in stages[k].collect()} for k in ("before pii", "pii"))
    assert before.keys() == after.keys() and before != after
    for doc_id, text in after.items():
        assert not pii.base_spans(text or "")
        if not pii.base_spans(before[doc_id] or "") and not list(pii.regions(before[doc_id] or "")):
            assert text == before[doc_id]


def test_mix_takes_what_the_plan_says(stages):
    plan = {r["doc_id"]: r["repeats"] for r in mixing.mixing_plan(stages["before mixing"]).collect()}
    assert Counter(r["doc_id"] for r in stages["mixing"].collect()) == Counter({k: n for k, n in plan.items() if n})


def test_segmentations_give_the_texts_back(stages):
    vocabulary = segmentations.read_vocabulary()
    samples = segmentations.decode(stages["segmentations"].filter("sample = 1"), vocabulary)
    found = Counter((r["doc_id"], r["decoded"]) for r in samples.collect())
    assert found == Counter((r["doc_id"], r["text"] or "") for r in stages["mixing"].collect())


def test_copies_are_segmented_apart(stages):
    long = stages["mixing"].filter("length(text) > 200").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    rows = stages["segmentations"].filter("sample = 1").join(long, "doc_id", "left_semi")
    same = rows.groupBy("doc_id").agg(F.count_distinct("pieces").alias("kinds"), F.count("*").alias("n")).collect()
    assert same and all(r["kinds"] == r["n"] for r in same)


def test_run_is_the_stages(spark, stages, small_folder):
    result = corpus_pipeline.run(spark, small_folder)
    key = ["doc_id", "sample", "n_pieces", "log_chance"]
    assert sorted(map(tuple, result.select(key).collect())) == sorted(map(tuple, stages["segmentations"].select(key).collect()))
