"""Near-duplicates by circulant MinHash, banding and exact verification (operator 3).

Two permutations generate the whole signature: the first scatters shingle hashes over a
circle of 2^32 places, the second is shifted by k places round the circle for coordinate k.
Bands of equal coordinates propose pairs; full shingle sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hubloom.llm import text as words
from hubloom.llm.components import components
from hubloom.llm.tables import read_table, stored, unused, written

SHINGLE = 5
BANDS, ROWS = 28, 4  # a pair at similarity 0.75 is missed with 2e-5
PERCENT = 75
# Shingles hashed at once, so that they stay in a core's cache.
CACHED = 1 << 15
# Centres to which each document is compared first; all else is left to the exact pass.
FIRST_TRIES = 2
# Rounds that compare what is still apart in a bucket with members of its largest component, how
# many of them a document meets in a round, and of how many pairs one must link for another round.
ROUNDS, ROUND_TRIES, ROUND_LINKS = 6, 4, 20
# Rarest shingles of a set, of those held across components, that travel with each of them in the exact pass.
HEAD = 100
# Different texts for each partition of the tables of links, members and components.
PART_CLASSES = 4096


def circle_place(shingles: np.ndarray) -> np.ndarray:
    """First permutation: 64-bit hashes to places on a circle of 2^32."""
    return (words.mix64(shingles) >> np.uint64(32)).astype(np.uint32)


def circle_value(places: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Second permutation, of the circle's places."""
    np.right_shift(places, np.uint32(16), out=spare)
    np.bitwise_xor(places, spare, out=out)
    np.multiply(out, np.uint32(0x7FEB352D), out=out)
    np.right_shift(out, np.uint32(15), out=spare)
    np.bitwise_xor(out, spare, out=out)
    np.multiply(out, np.uint32(0x846CA68B), out=out)
    np.right_shift(out, np.uint32(16), out=spare)
    return np.bitwise_xor(out, spare, out=out)


def signatures(shingles: np.ndarray, before: np.ndarray, size: int) -> np.ndarray:
    """`size` coordinates for each text with shingles; `before` are the shingles before each text."""
    result = np.empty((len(before) - 1, size), np.uint32)
    places = circle_place(shingles)
    for first, last in words.steps(before, CACHED):
        part = places[before[first]:before[last]]
        starts = before[first:last] - before[first]
        shifted, out, spare = part.copy(), np.empty_like(part), np.empty_like(part)
        for k in range(size):
            result[first:last, k] = np.minimum.reduceat(circle_value(shifted, out, spare), starts)
            np.subtract(shifted, np.uint32(1), out=shifted)
    return result


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = np.broadcast_to(keys, (len(signature), bands)).copy()
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        keys = words.mix64(keys ^ parts[:, :, r].astype(np.uint64)) + np.uint64(r)
    return keys


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct shingle hashes of ranges of texts: first text, last, sorted hashes, counts before."""
    data, offsets = words.buffers(texts)
    for first, last in words.steps(offsets):
        part = data[offsets[first]:offsets[last]]
        starts, ends, bounds = words.spans(part, offsets[first:last + 1] - offsets[first], words.NOT_SPACE)
        runs, before = words.sliding(words.word_hashes(part, starts, ends), bounds, SHINGLE)
        for i in range(last - first):
            runs[before[i]:before[i + 1]].sort()
        new = np.ones(len(runs), bool)
        new[1:] = runs[1:] != runs[:-1]
        new[before[:-1][before[:-1] < len(runs)]] = True
        counted = np.concatenate([[0], np.cumsum(new)])
        yield first, last, runs[new], counted[before]


def set_sums(sets: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Two sums over each set that, with its size, tell sets apart."""
    sums = np.zeros((2, len(before) - 1), np.uint64)
    some = np.flatnonzero(np.diff(before))
    if len(some):
        for k in range(2):
            sums[k, some] = np.add.reduceat(words.mix64(sets + np.uint64(k * 0x5851F42D4C957F2D)), before[:-1][some])
    return sums


def features(docs: DataFrame, key: str, text: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Columns doc_id, n_shingles, two sums that tell sets apart, and the band keys."""

    def work(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for first, last, sets, before in shingle_sets(texts):
            counts = np.diff(before)
            some = np.flatnonzero(counts)
            sums = set_sums(sets, before)
            keys = np.zeros((0, bands), np.uint64)
            if len(some):
                starts = before[:-1][some]
                keys = band_keys(signatures(sets, np.append(starts, len(sets)), bands * rows), bands, rows)
            at = np.concatenate([[0], np.cumsum(counts > 0) * bands]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                ids.slice(first, last - first), pa.array(counts, pa.int64()),
                pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1).view(np.int64))),
            ], names=["doc_id", "n_shingles", "sum_a", "sum_b", "bands"])

    return words.map_texts(docs, key, text, "doc_id long, n_shingles long, sum_a long, sum_b long, bands array<long>", work)


SAME = ["sum_a", "sum_b", "n_shingles"]  # what equal sets have in common


def sets_of(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """Whole shingle sets (doc_id, shingles) of the wanted classes, under their `node` as doc_id.

    `wanted` has node, first_id and the sums of each class; texts are read of its first id only,
    and of an id with several texts the one that is the class's own counts.
    """
    def work(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for first, last, sets, before in shingle_sets(texts):
            sums = set_sums(sets, before)
            yield pa.RecordBatch.from_arrays([
                ids.slice(first, last - first), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                pa.array(np.diff(before), pa.int64()),
                pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(sets.view(np.int64)))],
                names=["first_id", *SAME, "shingles"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(wanted.select(F.col("first_id").alias("doc_id")), "doc_id", "left_semi")
    found = words.map_texts(rows, "doc_id", "text", "first_id long, sum_a long, sum_b long, n_shingles long, shingles array<long>", work)
    one = found.groupBy("first_id", *SAME).agg(F.first("shingles").alias("shingles"))  # repeated rows
    return one.join(wanted, ["first_id", *SAME]).select(F.col("node").alias("doc_id"), "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    shared = F.size(F.array_intersect("set_a", "set_b"))
    size_a, size_b = F.size("set_a"), F.size("set_b")
    return (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
        .filter(100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b))
        .withColumn("shared", shared)
        .filter(100 * F.col("shared") >= percent * (size_a + size_b - F.col("shared")))
        .select("a", "b")
    )


def rare_prefix_pairs(members: DataFrame, sets: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """All pairs of `members` (node, component) across components that can be similar enough.

    Shingles that only one component holds come first in the order and go no further: no pair
    across components has them. Of the n of a set the m others follow, rarest first, and two similar
    sets share one of these within their first m - ceil(percent * n / 100) + 1. A set with fewer
    than that has no such pair. A pair comes out at the first one that they share only, and only
    if the overlap that their sizes ask for can still be reached: by what is left of either
    from there on, and by what their `HEAD` rarest share and what comes after these. (All of a
    head that isn't in the other head is lost, for the one whose head ends first.) For each
    shingle the largest component's documents meet the others only, never each other.
    """
    held = members.join(sets, F.col("node") == F.col("doc_id")).select("node", "component", "shingles")
    tokens = held.select("node", "component", F.explode("shingles").alias("token"))
    counts = (tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("component").alias("low"),
                                          F.max("component").alias("high"))
              .filter(F.col("low") != F.col("high")).select("token", "df"))
    own = Window.partitionBy("node")
    needed = F.ceil(percent * F.col("n") / 100)
    ranked = (tokens.select("node", "token").join(counts, "token")
              .join(held.select("node", "component", F.size("shingles").alias("n")), "node")
              .withColumn("m", F.count("*").over(own)).filter(F.col("m") >= needed)
              .withColumn("rank", F.row_number().over(own.orderBy("df", "token"))))
    heads = ranked.filter(F.col("rank") <= HEAD).groupBy("node").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("head"))
    prefix = written(
        ranked.filter(F.col("rank") <= F.col("m") - needed + 1).join(heads, "node")
        .select("token", "node", "component", "n", "m", (F.col("m") - F.col("rank") + 1).alias("rest"), "head"), most)
    largest = (prefix.groupBy("token", "component").agg(F.count("*").alias("held"))
               .groupBy("token").agg(F.max_by("component", "held").alias("largest"),
                                     F.count("*").alias("kinds"))
               .filter(F.col("kinds") > 1).select("token", "largest"))
    side = lambda s, rows: rows.select(
        "token", F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("component", "n", "m", "rest", "head")])
    left = side("x", prefix.join(largest, "token").filter(F.col("component") != F.col("largest")))
    right = side("y", prefix.join(largest, "token"))
    common = F.array_intersect("x_head", "y_head")
    after = F.greatest(F.col("x_m") - F.size("x_head"), F.col("y_m") - F.size("y_head"))
    asked = percent * (F.col("x_n") + F.col("y_n"))
    reachable = ((100 + percent) * F.least("x_rest", "y_rest") >= asked) & (
        (100 + percent) * (F.size(common) + after) >= asked)
    first = F.coalesce(F.get(common, F.lit(0)) == F.col("token"), F.lit(True))
    return (left.join(right, "token")
            .filter((F.col("x_component") != F.col("y_component")) & reachable & first)
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def open_members(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members (band, node, component) of the buckets that hold more than one component.

    `parts` has the component of every member.
    """
    placed = members.join(parts, "node").select("band", "node", "component")
    mixed = (placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .filter(F.col("low") != F.col("high")).select("band"))
    return placed.join(mixed, "band", "left_semi")


def pairs_with_largest(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of open members with members of the largest components in their buckets.

    Each bucket has one such member, another one each turn; a document meets the `ROUND_TRIES`
    of them that it shares most bands with, so pairs grow with the documents.
    """
    drawn = F.min_by("node", F.xxhash64("node", "band", F.lit(turn)))
    largest = (placed.groupBy("band", "component").agg(F.count("*").alias("held"), drawn.alias("centre"))
               .groupBy("band").agg(F.max(F.struct("held", "component", "centre")).alias("top"))
               .select("band", F.col("top.component").alias("of"), F.col("top.centre").alias("centre")))
    most = Window.partitionBy("node").orderBy(F.desc("bands"), F.xxhash64("centre", F.lit(turn)))
    return (placed.join(largest, "band").filter(F.col("component") != F.col("of"))
            .groupBy("node", "centre").agg(F.count("*").alias("bands"))
            .withColumn("rank", F.row_number().over(most)).filter(F.col("rank") <= ROUND_TRIES)
            .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())


def joined(parts: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """`parts` (node, component) after the links (a, b), which join whole components."""
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
    between = written(links.join(of("a"), "a").join(of("b"), "b")
                      .select(F.col("a_of").alias("a"), F.col("b_of").alias("b")).distinct(), most)
    united = components(between, most).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return written(parts.join(united, "component", "left")
                   .select("node", F.coalesce("whole", "component").alias("component")), most)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Columns doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Equal sets are one class first, so exact copies are never compared. Each band bucket has
    one centre; every class is compared with the centres it shares most bands with. What is
    then not yet in one component with the rest of its buckets is compared with members of the
    largest component there, in rounds. What is left goes through an exact prefix join, so no
    proposed pair is left out and no bucket is expanded into all pairs.

    Null text, empty text and white space: an empty set, linked with nothing. Fewer than five
    words: the whole sequence is one shingle. Rows without an id are linked with nothing, their
    component is null and they are kept. Repeated rows with an id share its component and are
    all kept or not; of an id with several texts each is compared on its own, and may be in a
    component of its own. Ids are integers. An empty table gives an empty result. Other columns
    are not looked at.
    """
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = written(features(whole, "doc_id", "text", bands, rows))
    # Written before it is used, so a class keeps its number.
    classes = written(found.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*SAME).agg(
        F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()))
    # Links, members and sets grow with the classes, so their tables' partitions do.
    most = math.ceil(classes.count() / PART_CLASSES) or 1
    keyed = classes.select("node", F.explode("bands").alias("band"))
    # The smallest id after a flip by the band's key: another centre in every bucket.
    buckets = (keyed.groupBy("band").agg(F.min(F.col("node").bitwiseXOR(F.col("band"))).alias("flipped"),
                                         F.count("*").alias("held"))
               .filter(F.col("held") > 1)
               .select("band", F.col("flipped").bitwiseXOR(F.col("band")).alias("centre"), "held"))
    members = written(keyed.join(buckets, "band").select("band", "node", "centre", "held"), most)
    nearest = Window.partitionBy("node").orderBy(F.desc("bands"), "centre")
    first = (members.filter(F.col("node") != F.col("centre")).groupBy("node", "centre")
             .agg(F.count("*").alias("bands"), F.min("held").alias("held"))
             .withColumn("rank", F.row_number().over(nearest))
             .filter((F.col("rank") <= FIRST_TRIES) | (F.col("held") == 2))
             .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    # One row of text for each class that shares a bucket.
    wanted = classes.drop("bands").join(members.select("node").distinct(), "node", "left_semi")
    sets = written(sets_of(whole, "doc_id", "text", wanted), most)
    links = written(confirmed(first, sets, percent), most)
    parts = written(members.select("node").distinct().join(components(links, most), "node", "left")
                    .select("node", F.coalesce("component", "node").alias("component")), most)
    # A crowd of copies at the threshold is one component soon, so the exact pass, which pairs
    # members of different ones, finds little left of it.
    placed = written(open_members(members.filter("held > 2"), parts), most)  # two have been compared
    near = written(sets.join(placed.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), most)
    for turn in range(ROUNDS):
        tried = written(pairs_with_largest(placed, turn), most)
        links = written(confirmed(tried, near, percent), most)
        linked = links.count()
        if linked:
            parts = joined(parts, links, most)
            placed = written(open_members(placed.drop("component"), parts), most)
        if not linked or ROUND_LINKS * linked < tried.count():
            break
    still = placed.select("node", "component").distinct()
    # What the exact pass adds links whole components.
    found_last = confirmed(rare_prefix_pairs(written(still, most), near, percent, most), near, percent)
    parts = joined(parts, written(found_last, most), most)
    grouped = (classes.drop("bands").join(parts, "node", "left")
               .select("first_id", *SAME, F.coalesce("component", "node").alias("component")))
    names = grouped.groupBy(F.col("component").alias("group")).agg(F.min("first_id").alias("name"))
    named = (grouped.join(names, F.col("component") == F.col("group"))
             .select(*[F.col(c).alias(f"{c}_of") for c in SAME], "name"))
    same_set = [F.col(c) == F.col(f"{c}_of") for c in SAME]
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id"))
    return (found.drop("bands").join(named, same_set, "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


def keep_one(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` without near copies: of each group of near-duplicates the first row.

    Rows are numbered and compared as documents of their own, so ids may be missing or repeated:
    of equal rows one stays, and a row whose text resembles no other stays whatever its id. Null,
    empty and white texts resemble nothing and all stay. An empty table gives an empty result;
    any columns may be there.
    """
    row = unused(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    kept = near_duplicates(numbered, row, text, **options).filter("kept").select(F.col("doc_id").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def op3_minhash(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
parts AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, p.component_id, d.doc_id = p.component_id AS kept
FROM documents d JOIN parts p ON p.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
