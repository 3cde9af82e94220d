"""A corpus made ready for training: clean, deduplicated, masked, mixed and segmented.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of `docs`;
the last returns the sampled segmentations of the mixed documents. Every stage treats each row
as a document: ids may be missing or repeated, and all rows are judged by their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hubloom.llm import minhash, mixing, pii, segmentations, toxicity
from hubloom.llm.tables import read_table, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of their language.

    Null and empty texts have the score of a text without words. Repeated rows go or stay
    together. Without labels, or on an empty table, nothing is dropped but what the one score of
    such a model says. Whole texts are scored; other columns are passed on.
    """
    return toxicity.accept(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Null, empty and white texts resemble nothing and stay; of equal rows one stays; rows of one
    id with different texts are judged each on its own. Whole texts are compared.
    """
    return minhash.keep_one(docs)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind.

    Null texts stay null, empty ones empty; repeated rows are masked alike. Whole texts are read.
    """
    return pii.mask_personal(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, copies one after the other.

    Null texts have no words and follow their source's repetitions; a null source is one of its
    own. Rows without an id are drawn by their text; repeated rows come equally often.
    """
    return mixing.mix(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of the documents; copies have draws of their own.

    Null and empty texts have the empty segmentation. Whole texts are segmented.
    """
    return segmentations.sample_segmentations(docs, segmentations.read_vocabulary(), copies_apart=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_copies),
    ("pii", mask_personal),
    ("mixing", mix_sources),
    ("segmentations", segment),
]

ORACLE_SQL = None  # no stage but the mixing can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
