"""Nearest neighbours by multi-index hashing over learned binary codes (operator 5).

Rotations learned on a bounded sample (iterative quantisation) turn a vector into signs. Codes
are cut into substrings, each with an index of its own: the values that occur, and their rows.
Codes that differ from a query's in at most r bits agree with it in some substring but for r
divided by the number of substrings (pigeonhole), so the rows of the values that near in one of
the indexes are all that lie within r. The radius grows until the k-th cosine found says that
nothing nearer lies beyond it; floats rank what it brings.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hubloom.llm.tables import read_table, written
from hubloom.llm.vectors import directions, matrix, usable_rows

BITS, SUBSTRING = 256, 16
SUBSTRINGS = BITS // SUBSTRING
SAMPLE_ROWS = 8192
ROUNDS = 20
SEED = 5
NEAREST = 5
QUERY_STEP = 50
# Rows of a block of the index, and of a block of the queries.
BLOCK_ROWS, QUERY_ROWS = 65_536, 65_536
LEAST_BLOCKS, LEAST_BLOCK_ROWS = 24, 1024
# Bits of the first radius, and by how much it grows while fewer than k rows lie within.
FIRST_RADIUS, GROWTH = 2 * SUBSTRINGS - 1, 2 * SUBSTRINGS
# Standard deviations that the radius adds to the bits by which such a cosine differs.
SAFETY = 2.5
# Queries of a block whose radii say where the next one begins: at that share of them.
RECENT, BEGIN_SHARE = 32, 0.25


def learn_codes(sample: np.ndarray, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """A matrix whose product with a direction has the code's bits as signs.

    As many rotations as the bits need, each fitted so that the sample lies near the corners of
    a cube after it. Without a sample they are random.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    d = sample.shape[1]
    found = []
    for _ in range(math.ceil(bits / d)):
        rotation, _ = np.linalg.qr(rng.normal(size=(d, d)))
        for _ in range(ROUNDS if len(sample) else 0):
            corners = np.where(sample @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(sample.T @ corners)
            rotation = u @ v
        found.append(rotation)
    return np.concatenate(found, axis=1)[:, :bits]


def encode(rows: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as four 64-bit numbers each."""
    return np.packbits(rows @ projection >= 0, axis=1).view(np.uint64)


class SubstringIndex:
    """Rows of one block by the value of each substring of their codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        parts = codes.view(np.uint16)
        self.order = np.argsort(parts, axis=0, kind="stable").T
        self.values, self.first = [], []
        for k in range(SUBSTRINGS):
            values, first = np.unique(parts[self.order[k], k], return_index=True)
            self.values.append(values)
            self.first.append(np.append(first, len(codes)))

    def probe(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows among which are all whose code differs from the query's in at most `radius` bits.

        With radius t * SUBSTRINGS + a, such a code differs by at most t bits in one of the
        first a + 1 substrings, or by less than t in one of the others: otherwise the bits
        would add up to more. Only values that occur are looked at.
        """
        most, extra = divmod(radius, SUBSTRINGS)
        found = np.zeros(len(self.codes), bool)
        for k, part in enumerate(query.view(np.uint16)):
            within = most if k <= extra else most - 1
            if within < 0:
                continue
            near = np.flatnonzero(np.bitwise_count(self.values[k] ^ part) <= within)
            starts = self.first[k][near]
            counts = self.first[k][near + 1] - starts
            at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            found[self.order[k][at]] = True
        return np.flatnonzero(found)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def radius_for(cosine: np.ndarray) -> np.ndarray:
    """Bits within which a vector of at least this cosine lies but for rare chance."""
    share = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return np.ceil(BITS * share + SAFETY * np.sqrt(BITS * share * (1 - share))).astype(np.int64)


def within_radius(index: SubstringIndex, rows: np.ndarray, allowed: np.ndarray, code: np.ndarray, query: np.ndarray,
                  k: int, first: int = FIRST_RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows near a query, their cosines, and the radius that was needed.

    It begins at the radius `first`; a larger one brings more rows, never fewer.

    The first radius that holds k rows gives a k-th cosine; the radius at which a row of that
    cosine lies is the last one, as what it adds can only be nearer. It may reach all bits.
    """
    radius = first
    while True:
        hits = index.probe(code, radius)
        hits = hits[(bits_apart(index.codes[hits], code) <= radius) & allowed[hits]]
        scores = np.einsum("ij,j->i", rows[hits], query)
        if radius >= BITS:
            return hits, scores, radius
        if len(hits) >= k:
            needed = int(radius_for(np.partition(scores, -k)[-k]))
            if needed <= radius:
                return hits, scores, radius
            radius = min(needed, BITS)
        else:
            radius = min(radius + GROWTH, BITS)


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
           projection: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of one block for each query: query and row numbers, cosines; equal cosines by id."""
    query_codes = encode(queries, projection)
    index = SubstringIndex(encode(rows, projection))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    needed: list[int] = []
    for q in range(len(queries)):
        # Smaller radii than most queries of the block need would be probed in vain.
        first = int(np.quantile(needed[-RECENT:], BEGIN_SHARE)) if needed else 0
        hits, scores, _ = within_radius(index, rows, ids != query_ids[q], query_codes[q], queries[q], k,
                                        min(max(first, FIRST_RADIUS), BITS))
        if len(hits) >= k:
            needed.append(int(radius_for(np.partition(scores, -k)[-k])))
        found.append(best(np.full(len(hits), q), hits, scores, ids, k))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(part) for part in zip(*found))


def best(query: np.ndarray, hits: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """The k highest scores, ties to the smaller id."""
    if len(hits) > 4 * k:
        least = np.partition(scores, -k)[-k]
        query, hits, scores = query[scores >= least], hits[scores >= least], scores[scores >= least]
    order = np.lexsort((ids[hits], -scores))[:k]
    return query[order], hits[order], scores[order]


def once(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id; of an id on several rows the smallest vector."""
    order = np.lexsort((*rows.T[::-1], ids))
    ids, rows = ids[order], rows[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], rows[first]


def learned_projection(rows: DataFrame) -> np.ndarray | None:
    """Fit the codes on at most `SAMPLE_ROWS` rows drawn by a hash of the id; None without rows."""
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE_ROWS).toArrow()
    if not drawn.num_rows:
        return None
    return learn_codes(directions(matrix(drawn["embedding"].combine_chunks())))


def nearest(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = NEAREST,
            query_step: int = QUERY_STEP) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score: the k rows of largest cosine found, equal ones by id.

    Queries are the rows whose id is divisible by `query_step`; every row but the query's own is
    a candidate and is in the index. Null, empty and zero vectors, those with null or non-finite
    components, rows without id and vectors whose length isn't the most frequent one take no
    part. An id on several rows counts once. Fewer than k candidates: all of them. An empty
    table gives an empty result. Other columns are not looked at.

    Blocks of queries meet blocks of rows in tasks of bounded size; a task gives k rows for each
    of its queries.
    """
    rows = written(usable_rows(vectors, key, column))
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    projection = learned_projection(rows)
    if projection is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    is_query = F.col("vec_id") % query_step == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks = max(math.ceil(n / BLOCK_ROWS), min(LEAST_BLOCKS, math.ceil(n / LEAST_BLOCK_ROWS)))
    query_blocks = max(1, math.ceil(n_queries / QUERY_ROWS))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    index = rows.withColumn("block", block).withColumn("query_block", every(query_blocks))
    queries = rows.filter(is_query).withColumn("query_block", query_block).withColumn("block", every(blocks))

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = once(left["vec_id"].to_numpy(), matrix(left["embedding"].combine_chunks()))
        query_ids, asked = once(right["vec_id"].to_numpy(), matrix(right["embedding"].combine_chunks()))
        q, hits, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(ids) and len(query_ids):
            q, hits, scores = search(ids, directions(found), query_ids, directions(asked), projection, k)
        return pa.table({"query_id": query_ids[q] if len(q) else q, "vec_id": ids[hits] if len(q) else q, "score": scores})

    parts = (index.groupBy("block", "query_block").cogroup(queries.groupBy("block", "query_block"))
             .applyInArrow(work, schema))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (parts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))
