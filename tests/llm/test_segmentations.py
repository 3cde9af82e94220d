import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from hubloom.llm import segmentations
from hubloom.llm import segmentations as sg

VOCABULARY = sg.read_vocabulary()


def rows_of(texts, samples=3, seed=7, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return [r for b in sg.sampled_batches(pa.array(ids, pa.int64()), pa.array(texts, pa.string()), VOCABULARY, samples, seed)
            for r in b.to_pylist()]


def all_segmentations(text):
    """Every segmentation of a short text without unknown characters, and its chance."""
    import public_tokenizers
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {model.id_to_piece(i): i for i in range(sg.FIRST_PIECE, model.get_piece_size())}
    spelled = "▁" + text.replace(" ", "▁")

    def ways(at):
        if at == len(spelled):
            yield ()
        for end in range(at + 1, min(at + 16, len(spelled)) + 1):
            if spelled[at:end] in pieces:
                for rest in ways(end):
                    yield (pieces[spelled[at:end]], *rest)

    found = list(ways(0))
    weights = np.array([sum(-sg.ALPHA * math.log(i - sg.FIRST_PIECE + 2) for i in way) for way in found])
    chances = np.exp(weights - weights.max())
    return dict(zip(found, chances / chances.sum()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_round_trip(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    rows = rows_of(texts)
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    for row in rows:
        spelled, _ = sg.decode_bytes(np.array(row["pieces"], np.int64), VOCABULARY)
        assert spelled.tobytes().removeprefix(b" ").decode() == texts[row["doc_id"]]


def test_every_sample_of_the_documents_round_trips(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sg.decode(sg.sample_segmentations(docs, VOCABULARY), VOCABULARY)
    assert rows.join(docs, "doc_id").filter("decoded = text").count() == rows.count() >= docs.count()


def test_library_decodes_the_same():
    import public_tokenizers
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["Hello world\n", "tab\there é ①", "the and of", "日本 x"]
    for row in rows_of(texts):
        assert model.decode(row["pieces"]) == texts[row["doc_id"]]


def test_samples_are_distinct_and_fall():
    for text in ("the theand", "a b", "a", "internationalisation of it", "x" * 200):
        rows = rows_of([text], samples=6)
        assert len({tuple(r["pieces"]) for r in rows}) == len(rows)
        assert all(r["log_inclusion"] <= 0 for r in rows)


@pytest.mark.parametrize("text", ["the", "and a", "ind"])
def test_small_spaces_come_out_whole(text):
    chances = all_segmentations(text)
    rows = rows_of([text], samples=len(chances) + 5)
    assert {tuple(r["pieces"]) for r in rows} == set(chances)
    for row in rows:
        assert row["log_chance"] == pytest.approx(math.log(chances[tuple(row["pieces"])]), abs=1e-5) and row["log_inclusion"] == 0


@pytest.mark.parametrize("text", ["then", "ind or"])
def test_ordered_samples_have_the_right_chances(text):
    """First two samples against sampling without replacement, over many row keys."""
    chances = all_segmentations(text)
    n = 4000
    rows = rows_of([text] * n, samples=2, ids=list(range(n)))
    first = {r["doc_id"]: tuple(r["pieces"]) for r in rows if r["sample"] == 1}
    second = {r["doc_id"]: tuple(r["pieces"]) for r in rows if r["sample"] == 2}
    pairs = {}
    for i in range(n):
        pairs[first[i], second[i]] = pairs.get((first[i], second[i]), 0) + 1
    for a, b in itertools.permutations(sorted(chances, key=chances.get)[-4:], 2):
        expected = n * chances[a] * chances[b] / (1 - chances[a])
        assert abs(pairs.get((a, b), 0) - expected) < 5 * math.sqrt(expected + 1) + 1


def test_inclusion_scores_weigh_right():
    """Sums over samples weighted by 1 / inclusion estimate sums over all segmentations."""
    text, n, k = "then or", 3000, 3
    chances = all_segmentations(text)
    rows = rows_of([text] * n, samples=k, ids=list(range(n)))
    estimate = sum(chances[tuple(r["pieces"])] * len(r["pieces"]) / math.exp(r["log_inclusion"]) for r in rows) / n
    truth = sum(c * len(way) for way, c in chances.items())
    assert estimate == pytest.approx(truth, rel=0.05)


def test_exact_choice_without_excluded():
    """The piecewise choice that leaves excluded ways out has the conditional distribution."""
    chars, bounds = sg.characters(np.frombuffer(b"then", np.uint8), np.array([0, 4]))
    lattices = sg.build_lattices(chars, sg.char_values(chars), np.array([0]), np.array([len(chars)]), VOCABULARY)
    chances = all_segmentations("then")
    barred = sorted(chances, key=chances.get)[-2:]
    rng, n, counts = np.random.default_rng(0), 3000, {}
    for _ in range(n):
        way = sg.sample_without(lattices, 0, barred, rng.random(64))
        counts[way] = counts.get(way, 0) + 1
    assert not set(barred) & set(counts)
    left = 1 - sum(chances[b] for b in barred)
    for way, chance in chances.items():
        if way not in barred:
            expected = n * chance / left
            assert abs(counts.get(way, 0) - expected) < 5 * math.sqrt(expected + 1) + 1


def test_row_key_seeds_the_draws():
    texts = ["some words to be segmented in several ways"] * 3
    again = rows_of(texts, ids=[5, 6, 5])
    by_key = [[r["pieces"] for r in again if r["doc_id"] == k] for k in (5, 6)]
    assert by_key[0][::2] == by_key[0][1::2] and by_key[0][::2] != by_key[1]
    alone = rows_of(["other text", texts[0]], ids=[9, 6])
    assert [r["pieces"] for r in alone if r["doc_id"] == 6] == by_key[1]


def test_decode_operator(spark):
    docs = spark.createDataFrame([(1, "a text\nof é ①"), (2, None), (3, " spaced  out ")], "doc_id long, text string")
    rows = sg.decode(sg.sample_segmentations(docs, VOCABULARY), VOCABULARY).collect()
    assert {(r["doc_id"], r["decoded"]) for r in rows} == {(1, "a text\nof é ①"), (2, ""), (3, " spaced  out ")}


def test_copies_have_draws_of_their_own(spark):
    vocabulary = segmentations.read_vocabulary()
    text = "several segmentations of a sentence that is long enough to differ"
    rows = spark.createDataFrame([(5, text)] * 3 + [(6, text)] + [(5, text)] * 2, "doc_id long, text string").coalesce(1)
    first = lambda apart: [r["pieces"] for r in segmentations.sample_segmentations(
        rows, vocabulary, copies_apart=apart).filter("sample = 1").collect()]
    alike, apart = first(False), first(True)
    assert alike[0] == alike[1] == alike[2] == alike[4] != alike[3]
    assert apart[0] == alike[0] and len({tuple(p) for p in apart[:3]}) == 3 and apart[3] == alike[3] and apart[4] == apart[0]
    decoded = segmentations.decode(segmentations.sample_segmentations(rows, vocabulary, copies_apart=True), vocabulary)
    assert {r["decoded"] for r in decoded.collect()} == {text}


def test_copy_numbers_go_on_over_batches():
    ids = np.array([4, 4, 4, 7, 7, 4])
    assert segmentations.copy_numbers(ids, None).tolist() == [0, 1, 2, 0, 1, 0]
    assert segmentations.copy_numbers(ids, (4, 2)).tolist() == [3, 4, 5, 0, 1, 0]
    assert segmentations.copy_numbers(ids, (3, 2)).tolist() == [0, 1, 2, 0, 1, 0]


def test_units_that_are_copied_are_not_drawn_again(monkeypatch):
    """What stands before a sample's first new unit comes from the sample it was split off."""
    drawn, draw = [], segmentations.sample_units

    def counted(lattices, kinds, keys):
        drawn.append(len(kinds))
        return draw(lattices, kinds, keys)

    monkeypatch.setattr(segmentations, "sample_units", counted)
    texts = pa.array([f"the {k} quick brown foxes jumped over several lazy dogs, again and again" for k in range(60)])
    found = list(segmentations.sampled_batches(pa.array(range(60)), texts, VOCABULARY, 2, 7))
    assert sum(b.num_rows for b in found) == 120
    assert sum(n == drawn[0] for n in drawn) == 1 and max(drawn[1:]) < drawn[0]
