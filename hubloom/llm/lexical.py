"""Ranked lexical search with a document FP-tree (operator 11).

Documents are restricted to the items' terms. A document's terms, rarest first, are a path in a
trie, so documents that share rare terms share a path; adjacent small branches form one leaf.
Every node knows the largest tf of each term and the smallest m below it: a made-up document
that scores at least as high as any of its own. An item walks the trie depth-first, best node
first, and passes by what can't reach its twentieth place.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hubloom.llm import text as words
from hubloom.llm.tables import read_table, stored

TOP = 20
# Documents of a leaf, and branches of a node, at most (a leaf holds more where terms are all alike).
LEAF, BRANCHES = 16, 16
# Postings and documents of one trie; a task builds and searches one after the other.
BLOCK_POSTINGS, BLOCK_DOCUMENTS = 2_000_000, 32_768
# Terms of items searched at once: bounds what is sent to the executors (16 bytes a term). More
# items are searched in several passes over the restricted documents.
PASS_TERMS = 2_000_000
# Leading terms that deal documents to tasks.
LEADING = 6


def counted_terms(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of texts with their distinct terms: first, last, owner, term hash, tf, terms of each text."""
    data, offsets = words.buffers(texts)
    for first, last in words.steps(offsets):
        part = data[offsets[first]:offsets[last]]
        starts, ends, bounds = words.spans(part, offsets[first:last + 1] - offsets[first], words.ALPHANUMERIC)
        hashes = words.word_hashes(part, starts, ends)
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(last - first), sizes)
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        at = np.flatnonzero(new)
        yield first, last, owner[at], hashes[at], np.diff(np.append(at, len(owner))), sizes


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """Columns item_id, term (hash), repeats."""

    def work(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for first, last, owner, term, tf, _ in counted_terms(ids, texts):
            yield pa.RecordBatch.from_arrays([
                ids.slice(first, last - first).take(pa.array(owner)), pa.array(term.view(np.int64)),
                pa.array(tf.astype(np.int64))], names=["item_id", "term", "repeats"])

    rows = items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text"))
    return words.map_texts(rows, "item", "text", "item_id long, term long, repeats long", work)


def restricted(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """Columns doc_id, n (terms with repeats), terms (places in the sorted `vocabulary`), tfs."""

    def work(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for first, last, owner, term, tf, sizes in counted_terms(ids, texts):
            place = np.minimum(np.searchsorted(vocabulary, term), max(len(vocabulary) - 1, 0))
            known = vocabulary[place] == term if len(vocabulary) else np.zeros(len(term), bool)
            before = np.searchsorted(owner[known], np.arange(last - first + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                ids.slice(first, last - first), pa.array(sizes.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(before), pa.array(place[known].astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(before), pa.array(tf[known].astype(np.int32)))],
                names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return words.map_texts(rows, "id", "text", "doc_id long, n long, terms array<int>, tfs array<int>", work)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list array and the values before each list."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term, added up within a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(flat(batch.column(0))[0], minlength=size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "df"])

    summed = (vectors.select("terms").mapInArrow(run, "term long, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).toArrow())
    counts = np.zeros(size, np.int64)
    counts[summed["term"].to_numpy()] = summed["df"].to_numpy()
    return counts


def term_weights(counts: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    distinct, place = np.unique(counts, return_inverse=True)
    weights = [int(1000 * log((2 * documents + 2) / (2 * int(df) + 1))) for df in distinct]
    return np.array(weights, np.int64).reshape(-1)[place]


class Vectors:
    """Term vectors row by row: term ranks and tfs, an m and the smallest id of each row."""

    def __init__(self, before: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, ids: np.ndarray):
        self.before, self.terms, self.tfs, self.m, self.ids = before, terms, tfs, m, ids

    def scores(self, first: int, last: int, weights: np.ndarray) -> np.ndarray:
        """Score of rows `first` to `last` with the item's weight of each term."""
        begin, end = self.before[first], self.before[last]
        weight = weights[self.terms[begin:end]]
        hit = np.flatnonzero(weight)
        tf = self.tfs[begin:end][hit]
        row = np.searchsorted(self.before[first:last + 1] - begin, hit, side="right") - 1
        gain = weight[hit] * ((1_000_000_000 * tf) // (1000 * tf + 12 * self.m[first:last][row]))
        total = np.zeros(last - first, np.int64)
        np.add.at(total, row, gain)
        return total

    def merged(self, cuts: np.ndarray) -> Vectors:
        """One row for each range of rows between `cuts`: largest tfs, smallest m and id."""
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(self.before[cuts]))
        key = (group << 32) | self.terms
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        tfs = np.maximum.reduceat(self.tfs[order], at) if len(at) else self.tfs
        group = key[at] >> 32
        return Vectors(np.searchsorted(group, np.arange(len(cuts))), key[at] & 0xFFFFFFFF, tfs,
                       np.minimum.reduceat(self.m, cuts[:-1]), np.minimum.reduceat(self.ids, cuts[:-1]))


def shared_prefix(before: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Leading terms that each row shares with the row before it; -1 for the first."""
    count = len(before) - 1
    shared = np.zeros(count, np.int64)
    shared[:1] = -1
    sizes = np.diff(before)
    alive, depth = np.arange(1, count), 0
    while len(alive):
        alive = alive[(sizes[alive] > depth) & (sizes[alive - 1] > depth)]
        alive = alive[terms[before[alive] + depth] == terms[before[alive - 1] + depth]]
        depth += 1
        shared[alive] = depth
    return shared


class Trie:
    """Trie over sorted term vectors, level by level.

    Level 0 are the documents. A level's rows are ranges of the rows of the level below:
    branches at a common depth, small ones beside each other taken together.
    """

    def __init__(self, documents: Vectors, leaf: int = LEAF, branches: int = BRANCHES):
        self.levels, self.cuts = [documents], [np.zeros(0, np.int64)]
        shared, limit = shared_prefix(documents.before, documents.terms), leaf
        while len(shared) > 1:
            cuts = self.ranges(shared, limit)
            self.cuts.append(np.append(cuts, len(shared)))
            self.levels.append(self.levels[-1].merged(self.cuts[-1]))
            shared, limit = shared[cuts], branches

    @staticmethod
    def ranges(shared: np.ndarray, limit: int) -> np.ndarray:
        """Starts of ranges of at most `limit` rows, parted where the fewest leading terms are shared."""
        starts = []
        for first in range(0, len(shared), limit * limit):  # bounded steps, so that one range is cut at a time
            last = min(first + limit * limit, len(shared))
            todo = [(first, last)]
            while todo:
                low, high = todo.pop()
                if high - low <= limit:
                    starts.append(low)
                    continue
                inner = shared[low + 1:high]
                least = np.flatnonzero(inner == inner.min()) + low + 1
                cut = int(least[np.argmin(np.abs(least - (low + high) / 2))])
                cut = min(max(cut, low + 1), high - 1)
                todo += [(low, cut), (cut, high)]
        return np.sort(np.array(starts, np.int64))

    def search(self, weights: np.ndarray, best: list[tuple[int, int]], top: int) -> None:
        """Bring `best`, a heap of (score, -id), to the `top` best of it and this trie's documents."""
        height = len(self.levels) - 1
        if not len(self.levels[0].m):
            return
        stack = [(height, 0, len(self.levels[-1].m))]
        while stack:
            level, first, last = stack.pop()
            rows = self.levels[level]
            scores = rows.scores(first, last, weights)
            order = np.lexsort((-rows.ids[first:last], scores))
            if level:  # worst first, so that the best is walked next
                for k in order.tolist():
                    score, row = int(scores[k]), first + k
                    if score and (len(best) < top or (score, -int(rows.ids[row])) > best[0]):
                        stack.append((level - 1, int(self.cuts[level][row]), int(self.cuts[level][row + 1])))
                continue
            for k in order[::-1][:top].tolist():
                found = (int(scores[k]), -int(rows.ids[first + k]))
                if not found[0] or (len(best) == top and found <= best[0]):
                    break
                (heappush if len(best) < top else heapreplace)(best, found)


def searched(vectors: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, ranks: np.ndarray,
             documents: int, terms: int, top: int) -> DataFrame:
    """The best `top` documents of each task for each item: item_id, doc_id, score.

    `vectors` is sorted within partitions; each run of `BLOCK_POSTINGS` postings is one trie.
    """
    by_rank = np.zeros(len(ranks), np.int64)
    by_rank[ranks] = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        active = np.zeros(len(by_rank), np.int64)

        def walk(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            values, before = flat(table["path"].chunk(0))
            tfs, _ = flat(table["tfs"].chunk(0))
            m = 75 + (25 * table["n"].to_numpy() * documents) // terms
            trie = Trie(Vectors(before, values.astype(np.int64), tfs.astype(np.int64), m, table["doc_id"].to_numpy()))
            for (_, place, repeats), found in zip(items, best):
                active[place] = by_rank[place] * repeats
                trie.search(active, found, top)
                active[place] = 0

        held: list[pa.RecordBatch] = []
        postings = rows = 0
        for batch in batches:
            size = len(batch.column("path").flatten())
            if held and (postings + size > BLOCK_POSTINGS or rows + batch.num_rows > BLOCK_DOCUMENTS):
                walk(held)
                held, postings, rows = [], 0, 0
            if batch.num_rows:
                held.append(batch)
                postings, rows = postings + size, rows + batch.num_rows
        if held:
            walk(held)
        out = [(item, -place, score) for (item, _, _), found in zip(items, best) for score, place in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["item_id", "doc_id", "score"])

    return vectors.mapInArrow(run, "item_id long, doc_id long, score long")


def search_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", top: int = TOP) -> DataFrame:
    """Columns item_id, rank (from 1), doc_id, score: each item's best documents with a score above 0.

    Equal scores are ranked by id. Every row of `docs` is a document of its own, repeated ids
    too; rows without an id count in all statistics and are not returned. Null and empty texts
    have no terms and are never found. An item without known terms has no rows; items repeated
    under one id are one item with all their terms; items without an id are left out. Ids are
    integers. Empty tables give an empty result. Other columns are not looked at.

    To the driver and the executors go the items of a pass and the document counts of their
    terms, at most `PASS_TERMS` terms at once.
    """
    spark = docs.sparkSession
    asked = stored(item_terms(items, item_key, item_text).filter("item_id IS NOT NULL")
                   .groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats")))
    passes = max(1, -(-asked.count() // PASS_TERMS))
    results = []
    for k in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else asked
        table = part.orderBy("item_id", "term").toArrow().combine_chunks()
        owner, term, repeats = (table[c].to_numpy() for c in ("item_id", "term", "repeats"))
        vocabulary, place = np.unique(term.view(np.uint64) if len(term) else np.zeros(0, np.uint64), return_inverse=True)
        vectors = stored(restricted(docs, key, text, vocabulary))
        sums = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("terms")).first()
        if not sums["documents"] or not len(vocabulary):
            continue
        counts = document_counts(vectors, len(vocabulary))
        weights = term_weights(counts, sums["documents"])
        ranks = np.empty(len(vocabulary), np.int64)  # rarest term first
        ranks[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        asked_for = [(int(owner[a]), ranks[place[a:b]], repeats[a:b])
                     for a, b in zip(cuts, np.append(cuts[1:], len(owner)))]
        paths = with_paths(vectors.filter("doc_id IS NOT NULL AND size(terms) > 0"), ranks)
        leading = F.slice("path", 1, LEADING)
        dealt = (paths.repartitionByRange(leading, F.xxhash64("path", "tfs"), "doc_id")
                 .sortWithinPartitions("path", "n", "doc_id"))
        results.append(searched(dealt, asked_for, weights, ranks, sums["documents"], sums["terms"], top))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def with_paths(vectors: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Columns doc_id, n, path (term ranks, rarest first), tfs in the path's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, before = flat(batch.column("terms"))
            tfs, _ = flat(batch.column("tfs"))
            rank = ranks[values]
            order = np.lexsort((rank, np.repeat(np.arange(batch.num_rows), np.diff(before))))
            lists = [pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(x[order].astype(np.int32)))
                     for x in (rank, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), *lists],
                                             names=["doc_id", "n", "path", "tfs"])

    return (vectors.select("doc_id", "n", "terms", "tfs")
            .mapInArrow(run, "doc_id long, n long, path array<int>, tfs array<int>"))


def op11_lexical(spark, sf_dir):
    return search_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)
  GROUP BY item_id, term),
tfs AS (
  SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(t) AS term FROM terms)
  WHERE term IN (SELECT term FROM asked) GROUP BY place, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
sums AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM terms),
scored AS (
  SELECT a.item_id, d.doc_id, f.place, sum(a.repeats * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
           * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.t) * n_docs) // n_terms))))::BIGINT AS score
  FROM asked a JOIN tfs f USING (term) JOIN dfs USING (term) JOIN terms d USING (place) CROSS JOIN sums
  GROUP BY a.item_id, d.doc_id, f.place)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
