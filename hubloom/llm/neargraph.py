"""Near-duplicate vectors by a robust-pruned flat graph on overlapping shards (operator 1).

Vectors so close to a leader that any two of them must be linked are one ball; balls are what
the graph is built on, so a crowd of near copies is a few nodes. Leaders are dealt to the shards
of their nearest centres. In each shard a graph of robustly pruned neighbours is built; the
adjacency lists of all shards are united. Every leader then searches its nearest shards greedily
from the medoid and the nearest of some spread nodes, and widens the search through whatever lies
in range. Pairs of balls are decided by their angle where it leaves no doubt, and vector by vector
otherwise. An audit counts links of a sample by brute force; if too many are missing, more shards
are searched, and at last every ball is compared with every other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hubloom.llm.components import components
from hubloom.llm.tables import read_table, written
from hubloom.llm.vectors import directions, list_array, matrix, usable_rows

COSINE = 0.9
SEED = 1
# Rows that the centres are fitted on, at most so many centres, leaders to each centre.
SAMPLE_ROWS, MOST_CENTRES, SHARD_ROWS = 8192, 1024, 4096
OVERLAP = 2  # shards that a leader is built into
PROBES = 3  # shards that it searches at first
# Rows among which leaders are chosen in one task, and nodes of one graph.
BLOCK_ROWS = 4096
POOL, DEGREE, ALPHA = 32, 16, 1.2
FAR = 2  # links of each node to rows drawn from all of the graph
JOINS = 8  # links that a node may give to nodes that can't be reached otherwise
BEAM = 16
SPREAD, STARTS = 256, 4  # nodes that searches may start from, those nearest to a query
SEARCHED_AT_ONCE = 1024
# Balls that the audit draws of those with links to others, and of those without.
AUDIT_ROWS, AUDIT_DRAWN = 256, 4096
AUDIT_RECALL = 0.999
# Angles within which rounding could decide; such pairs are looked at exactly.
SLACK = 1e-6


def angle(cosine: np.ndarray | float) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of directions, row by row, the same whatever batch they come in."""
    return np.einsum("ij,ij->i", a, b)


def fit_centres(sample: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """Centres by spherical k-means on the sample."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(10):
        own = (sample @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        length = np.sqrt((total ** 2).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-9, total / np.maximum(length, 1e-9), centres)
    return centres


def nearest_centres(rows: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    return np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :count]


def choose_leaders(rows: np.ndarray, radius: float) -> np.ndarray:
    """Number of the leader of each row, itself if it has none.

    The row with most rows in reach leads them first. Reach is half the angle of a link, so
    any two rows of a leader are linked.
    """
    least = np.cos(radius)
    leader = np.arange(len(rows))
    reach = [np.flatnonzero(part) for begin in range(0, len(rows), 512)
             for part in rows[begin:begin + 512] @ rows.T >= least]
    free = np.ones(len(rows), bool)
    for i in sorted(range(len(rows)), key=lambda i: (-len(reach[i]), i)):
        if free[i] and len(reach[i]) > 1:
            own = reach[i][free[reach[i]]]
            leader[own], free[own] = i, False
            leader[i], free[i] = i, False
    return leader


def robust_prune(rows: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of each row out of its pool (sorted nearest first), -1 where there are fewer.

    The nearest candidate is kept; those that are nearer to it, by `alpha`, than to the row
    itself can be reached through it and go. Repeated until the degree is reached.
    """
    n, width = pool.shape
    result = np.full((n, degree), -1, np.int32)
    for begin in range(0, n, 512):
        part = pool[begin:begin + 512]
        there = part >= 0
        vectors = rows[np.maximum(part, 0)]
        own = np.sqrt(np.maximum(2 - 2 * np.einsum("nwd,nd->nw", vectors, rows[begin:begin + 512]), 0))
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("nwd,nvd->nwv", vectors, vectors), 0))
        at = np.arange(len(part))
        for k in range(degree):
            first = there.argmax(axis=1)
            some = there[at, first]
            result[begin:begin + 512, k] = np.where(some, part[at, first], -1)
            there &= alpha * between[at, first] > own
            there[at, first] = False
    return result


def build_graph(rows: np.ndarray) -> np.ndarray:
    """Adjacency of one shard: neighbours out of each row's nearest rows, and a few far ones.

    Every row can be reached from the medoid.
    """
    n = len(rows)
    width = min(POOL, n - 1)
    if width < 1:
        return np.full((n, DEGREE), -1, np.int32)
    pool = np.empty((n, width), np.int64)
    for begin in range(0, n, 512):
        near = rows[begin:begin + 512] @ rows.T
        near[np.arange(len(near)), np.arange(begin, begin + len(near))] = -2
        top = np.argpartition(-near, width - 1, axis=1)[:, :width]
        order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
        pool[begin:begin + 512] = np.take_along_axis(top, order, axis=1)
    graph = robust_prune(rows, pool)
    # Links both ways as far as there is room, so that every node can be reached.
    for node, k in zip(*np.nonzero(graph >= 0)):
        row = graph[graph[node, k]]
        if node not in row and (room := np.flatnonzero(row < 0)).size:
            row[room[0]] = node
    rng = np.random.Generator(np.random.PCG64(SEED))
    far = (np.arange(n)[:, None] + rng.integers(1, n, (n, FAR))) % n
    return connected(rows, np.concatenate([graph, far.astype(np.int32)], axis=1))


def medoid_of(rows: np.ndarray) -> int:
    return int((rows @ rows.mean(axis=0)).argmax())


def reached(graph: np.ndarray, start: int) -> np.ndarray:
    """Which nodes a walk along the links comes to."""
    seen = np.zeros(len(graph), bool)
    front = np.array([start])
    while len(front):
        seen[front] = True
        front = np.unique(graph[front])
        front = front[front >= 0]
        front = front[~seen[front]]
    return seen


def connected(rows: np.ndarray, graph: np.ndarray) -> np.ndarray:
    """The graph with links added until a walk from the medoid comes to every node.

    Each group of nodes that isn't reached gets a link from the nearest node that is and has
    room; what a few rounds leave is strung together.
    """
    n, width = graph.shape
    graph = np.concatenate([graph, np.full((n, JOINS + 1), -1, np.int32)], axis=1)
    given = np.zeros(n, np.int64)
    start = medoid_of(rows)
    for _ in range(8):
        seen = reached(graph, start)
        lost = np.flatnonzero(~seen)
        if not len(lost):
            break
        near = np.full(n, -2.0)
        giver = np.zeros(n, np.int64)
        able = np.flatnonzero(seen & (given < JOINS))
        if not len(able):
            break
        for begin in range(0, len(lost), 512):
            part = lost[begin:begin + 512]
            cosine = rows[part] @ rows[able].T
            giver[part], near[part] = able[cosine.argmax(axis=1)], cosine.max(axis=1)
        group = np.arange(n)
        a, k = np.nonzero(graph >= 0)
        b = graph[a, k]
        inside = ~seen[a] & ~seen[b]
        a, b = a[inside], b[inside]
        while True:
            new = group.copy()
            np.minimum.at(new, a, group[b])
            np.minimum.at(new, b, group[a])
            new = new[new]
            if (new == group).all():
                break
            group = new
        order = lost[np.argsort(-near[lost], kind="stable")]
        for node in order[np.sort(np.unique(group[order], return_index=True)[1])]:
            if given[giver[node]] < JOINS:
                graph[giver[node], width + given[giver[node]]] = node
                given[giver[node]] += 1
    last = start
    for node in np.flatnonzero(~reached(graph, start)):
        graph[last, -1] = last = node
    return graph[:, (graph >= 0).any(axis=0)]


def spread_nodes(rows: np.ndarray) -> np.ndarray:
    """At most SPREAD nodes: half of them drawn, each other one the farthest from all before it."""
    if len(rows) <= SPREAD:
        return np.arange(len(rows))
    chosen = np.random.Generator(np.random.PCG64(SEED)).choice(len(rows), SPREAD // 2, replace=False).tolist()
    near = (rows @ rows[chosen].T).max(axis=1)
    while len(chosen) < SPREAD:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    return np.unique(chosen)


def range_search(rows: np.ndarray, radii: np.ndarray, graph: np.ndarray, queries: np.ndarray,
                 query_radii: np.ndarray, own: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within `reach` plus both radii that the search comes upon.

    Greedy best-first search with a beam from the medoid, from the nearest of the spread nodes and
    from the query's own node where it is in the shard (`own`, else -1); then neighbours of
    everything in range, until nothing new.
    """
    medoid, spread = medoid_of(rows), spread_nodes(rows)
    seen_q, seen_n = [], []
    width = graph.shape[1]
    for begin in range(0, len(queries), SEARCHED_AT_ONCE):
        asked, start = queries[begin:begin + SEARCHED_AT_ONCE], own[begin:begin + SEARCHED_AT_ONCE]
        limit = np.cos(np.minimum(reach + query_radii[begin:begin + SEARCHED_AT_ONCE][:, None] + radii[None, :], np.pi))
        q = np.arange(len(asked))
        visited = np.zeros((len(asked), len(rows)), bool)
        inside = np.zeros_like(visited)
        beam = np.full((len(asked), BEAM), -1, np.int64)
        value = np.full((len(asked), BEAM), -2.0)
        done = np.ones((len(asked), BEAM), bool)

        def visit(at: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            """Cosines of (query, node) not seen before, -2 for the others."""
            new = (nodes >= 0) & ~visited[at, nodes]
            result = np.full(len(nodes), -2.0)
            at, nodes = at[new], nodes[new]
            result[new] = cosines(asked[at], rows[nodes])
            visited[at, nodes] = True
            inside[at, nodes] = result[new] >= limit[at, nodes]
            return result

        beam[:, 0], value[:, 0], done[:, 0] = medoid, visit(q, np.full(len(q), medoid)), False
        beam[:, 1], value[:, 1] = start, visit(q, start)
        done[:, 1] = value[:, 1] <= -2
        starts = spread[np.argsort(-(asked @ rows[spread].T), axis=1, kind="stable")[:, :STARTS]]
        for k in range(starts.shape[1]):
            beam[:, 2 + k], value[:, 2 + k] = starts[:, k], visit(q, starts[:, k])
            done[:, 2 + k] = value[:, 2 + k] <= -2
        while not done.all():
            active = np.flatnonzero(~done.all(axis=1))
            place = np.where(done[active], -3, value[active]).argmax(axis=1)
            done[active, place] = True
            nodes = graph[beam[active, place]].reshape(-1).astype(np.int64)
            found = visit(np.repeat(active, width), nodes).reshape(len(active), width)
            nodes = nodes.reshape(len(active), width)
            # A node may stand twice in a list; the second one isn't new any more.
            all_nodes = np.concatenate([beam[active], nodes], axis=1)
            all_values = np.concatenate([value[active], found], axis=1)
            all_done = np.concatenate([done[active], found <= -2], axis=1)
            best = np.argpartition(-all_values, BEAM - 1, axis=1)[:, :BEAM]
            beam[active] = np.take_along_axis(all_nodes, best, axis=1)
            value[active] = np.take_along_axis(all_values, best, axis=1)
            done[active] = np.take_along_axis(all_done, best, axis=1)
        widened = np.zeros_like(inside)
        while True:
            at, nodes = np.nonzero(inside & ~widened)
            if not len(at):
                break
            widened[at, nodes] = True
            for part in range(0, len(at), 1 << 16):
                more = graph[nodes[part:part + (1 << 16)]].astype(np.int64)
                visit(*unique_pairs(np.repeat(at[part:part + (1 << 16)], width), more.reshape(-1), len(rows)))
        at, nodes = np.nonzero(inside)
        seen_q.append(at + begin)
        seen_n.append(nodes)
    return np.concatenate(seen_q + [np.zeros(0, np.int64)]), np.concatenate(seen_n + [np.zeros(0, np.int64)])


def unique_pairs(at: np.ndarray, nodes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(at[nodes >= 0] * n + nodes[nodes >= 0])
    return keys // n, keys % n


def one_per_id(rows: DataFrame) -> DataFrame:
    """Of an id on several rows the smallest vector."""
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def make_balls(rows: DataFrame, centres: np.ndarray, total: int, radius: float) -> DataFrame:
    """Columns vec_id, leader, angle, embedding: each vector with the leader of its ball.

    Leaders are chosen among the rows nearest to one centre, in blocks of bounded size that a
    hash of the id picks; a crowded centre has more blocks.
    """
    def place(batches):
        for batch in batches:
            found = directions(matrix(batch.column(1)))
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), list_array(found, pa.float64()),
                     pa.array(nearest_centres(found, centres, 1)[:, 0].astype(np.int32))],
                    names=["vec_id", "embedding", "centre"])

    placed = written(rows.mapInArrow(place, "vec_id long, embedding array<double>, centre int"))
    blocks = (placed.groupBy("centre").count()
              .select(F.col("centre").alias("of"), F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")))
    # At most MOST_CENTRES rows.
    dealt = (placed.join(F.broadcast(blocks), F.col("centre") == F.col("of"))
             .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int"))
             .select("vec_id", "embedding", "centre", "block"))

    def lead(table: pa.Table) -> pa.Table:
        order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
        ids, found = table["vec_id"].to_numpy()[order], matrix(table["embedding"].combine_chunks())[order]
        leader = choose_leaders(found, radius)
        return pa.table({"vec_id": ids, "leader": ids[leader], "angle": angle(cosines(found, found[leader])) * (leader != np.arange(len(ids))),
                         "embedding": list_array(found, pa.float64())})

    return written(dealt.groupBy("centre", "block").applyInArrow(
        lead, "vec_id long, leader long, angle double, embedding array<double>"))


def linked_balls(leaders: DataFrame, centres: np.ndarray, probes: int, reach: float, searched: int = 0) -> DataFrame:
    """Pairs (a, b) of leaders whose balls might hold a link, that the search has found.

    `leaders` has leader, embedding, radius. The graph is built in the shards of each leader's
    nearest centres and united; each leader searches its `probes` nearest shards, without the
    `searched` nearest ones.
    """
    overlap = min(OVERLAP, len(centres))
    wide = min(max(probes, overlap), len(centres))

    def place(batches):
        for batch in batches:
            found = matrix(batch.column(1))
            if len(found):
                near = nearest_centres(found, centres, wide).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, list_array(near, pa.int32())],
                                                 names=["leader", "embedding", "radius", "near"])

    dealt = written(leaders.select("leader", "embedding", "radius").mapInArrow(
        place, "leader long, embedding array<double>, radius double, near array<int>"))
    crowd = (dealt.select(F.explode(F.slice("near", 1, overlap)).alias("shard")).groupBy("shard").count()
             .select(F.col("shard").alias("of"), F.ceil(F.col("count") / (2 * BLOCK_ROWS)).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("leader", F.lit(4)), F.col("parts")).cast("int")
    nodes = (dealt.withColumn("shard", F.explode(F.slice("near", 1, overlap)))
             .join(F.broadcast(crowd), F.col("shard") == F.col("of")).withColumn("part", part)
             .select("shard", "part", "parts", "leader", "embedding", "radius"))

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table["leader"].to_numpy(), kind="stable")
        ids = table["leader"].to_numpy()[order]
        graph = build_graph(matrix(table["embedding"].combine_chunks())[order].astype(np.float32))
        node, k = np.nonzero(graph >= 0)
        return pa.table({"leader": ids[node], "next": ids[graph[node, k]]})

    lists = written(
        nodes.select("shard", "part", "leader", "embedding").groupBy("shard", "part")
        .applyInArrow(build, "leader long, next long")
        .groupBy("leader").agg(F.collect_set("next").alias("next")))  # at most OVERLAP lists of DEGREE + FAR + JOINS + 1
    # A crowded shard's leaders are parted on both sides, so that a task holds a bounded number.
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    graph = (nodes.join(lists, "leader", "left").withColumn("asker", every_part)
             .select("shard", "part", "asker", "leader", "embedding", "radius", "next"))
    queries = (dealt.withColumn("shard", F.explode(F.slice("near", searched + 1, wide - searched)))
               .join(F.broadcast(crowd), F.col("shard") == F.col("of"))
               .withColumn("asker", F.pmod(F.xxhash64("leader", F.lit(5)), F.col("parts")).cast("int"))
               .withColumn("part", every_part)
               .select(*[F.col(c).alias(c) for c in ("shard", "part", "asker", "leader", "embedding", "radius")]))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked_ids = left["leader"].to_numpy(), right["leader"].to_numpy()
        if not len(ids) or not len(asked_ids):
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        rows = matrix(left["embedding"].combine_chunks())[order]
        next_ids = [left["next"][int(i)].as_py() or [] for i in order]
        table = np.full((len(ids), max(1, max(map(len, next_ids)))), -1, np.int32)
        for i, near in enumerate(next_ids):
            place = np.searchsorted(ids, sorted(near))
            place = [p for p, x in zip(place, sorted(near)) if p < len(ids) and ids[p] == x]
            table[i, :len(place)] = place
        own = np.searchsorted(ids, asked_ids)
        own = np.where((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == asked_ids), own, -1)
        q, node = range_search(rows, left["radius"].to_numpy()[order], table, matrix(right["embedding"].combine_chunks()),
                               right["radius"].to_numpy(), own, reach)
        a, b = asked_ids[q], ids[node]
        other = a != b
        return pa.table({"a": np.minimum(a, b)[other], "b": np.maximum(a, b)[other]})

    group = ["shard", "part", "asker"]
    pairs = (graph.groupBy(*group).cogroup(queries.groupBy(*group))
             .applyInArrow(search, "a long, b long"))
    return pairs.distinct()


def every_pair(leaders: DataFrame, reach: float) -> DataFrame:
    """All pairs (a, b) of leaders whose balls might hold a link, by comparing blocks of leaders."""
    blocks = max(1, math.ceil(leaders.count() / BLOCK_ROWS))
    dealt = (leaders.select("leader", "embedding", "radius")
             .withColumn("block", F.pmod(F.xxhash64("leader", F.lit(6)), F.lit(blocks)).cast("int")))
    left = dealt.withColumn("other", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))))
    right = dealt.withColumnRenamed("block", "other").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("other"))))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, other_ids = left["leader"].to_numpy(), right["leader"].to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(ids) and len(other_ids):
            same = left["block"][0].as_py() == right["other"][0].as_py()
            rows, others = matrix(left["embedding"].combine_chunks()), matrix(right["embedding"].combine_chunks())
            radii, other_radii = left["radius"].to_numpy(), right["radius"].to_numpy()
            for begin in range(0, len(ids), 512):
                limit = np.cos(np.minimum(reach + SLACK + radii[begin:begin + 512, None] + other_radii[None, :], np.pi))
                i, k = np.nonzero(rows[begin:begin + 512] @ others.T >= limit)
                x, y = ids[i + begin], other_ids[k]
                kept = x < y if same else x != y
                a.append(np.minimum(x, y)[kept])
                b.append(np.maximum(x, y)[kept])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return (left.groupBy("block", "other").cogroup(right.groupBy("block", "other"))
            .applyInArrow(compare, "a long, b long"))


def decide(pairs: DataFrame, members: DataFrame, leaders: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Links of balls (a, b), and the links that each vector has to other balls (vec_id, more).

    A pair is settled by the leaders' angle where all or none of the vectors must be linked;
    otherwise every vector of the one ball is compared with every one of the other, in a task
    that holds two balls, each of bounded size.
    """
    reach = float(angle(cosine))
    side = lambda s: leaders.select(
        F.col("leader").alias(s), F.col("radius").alias(f"{s}_radius"), F.col("held").alias(f"{s}_held"),
        F.col("embedding").alias(f"{s}_vector"))

    def settle(batches):
        for batch in batches:
            at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            if not batch.num_rows:
                continue
            apart = angle(cosines(matrix(at["a_vector"]), matrix(at["b_vector"])))
            radii = at["a_radius"].to_numpy() + at["b_radius"].to_numpy()
            state = np.where(apart + radii <= reach - SLACK, 2, np.where(apart - radii > reach + SLACK, 0, 1))
            kept = np.flatnonzero(state)
            yield pa.RecordBatch.from_arrays(
                [at[n].take(pa.array(kept)) for n in ("a", "b", "a_held", "b_held")] + [pa.array(state[kept].astype(np.int32))],
                names=["a", "b", "a_held", "b_held", "state"])

    settled = written(
        pairs.join(side("a"), "a").join(side("b"), "b")
        .select("a", "b", "a_held", "b_held", "a_radius", "b_radius", "a_vector", "b_vector")
        .mapInArrow(settle, "a long, b long, a_held long, b_held long, state int"))
    sure = settled.filter("state = 2")
    by_ball = (sure.select(F.col("a").alias("leader"), F.col("b_held").alias("n"))
               .unionByName(sure.select(F.col("b").alias("leader"), F.col("a_held").alias("n")))
               .groupBy("leader").agg(F.sum("n").alias("more")))
    balls = members.groupBy("leader").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))  # at most BLOCK_ROWS
    open_pairs = settled.filter("state = 1").select("a", "b")
    both = (open_pairs.join(balls.select(F.col("leader").alias("a"), F.col("rows").alias("a_rows")), "a")
            .join(balls.select(F.col("leader").alias("b"), F.col("rows").alias("b_rows")), "b")
            .select("a", "b", "a_rows", "b_rows"))

    def compare(batches):
        for batch in batches:
            out = {"a": [], "b": [], "vec_id": [], "more": []}
            for i in range(batch.num_rows):
                left, right = batch.column(2)[i].values, batch.column(3)[i].values
                x, y = matrix(left.field("embedding")), matrix(right.field("embedding"))
                ids = left.field("vec_id").to_pylist(), right.field("vec_id").to_pylist()
                found = [0] * len(ids[0]), np.zeros(len(ids[1]), np.int64)
                for k in range(len(x)):
                    hit = cosines(np.broadcast_to(x[k], y.shape), y) >= cosine
                    found[0][k] = int(hit.sum())
                    found[1][:] += hit
                for own, counts in zip(ids, found):
                    for vec_id, n in zip(own, counts):
                        if n:
                            for name, value in zip(out, (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), vec_id, int(n))):
                                out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, pa.int64()) for n in out]))

    compared = written(both.mapInArrow(compare, "a long, b long, vec_id long, more long"))
    by_vector = (members.join(by_ball, "leader").select("vec_id", "more")
                 .unionByName(compared.select("vec_id", "more"))
                 .groupBy("vec_id").agg(F.sum("more").alias("more")))
    return sure.select("a", "b").unionByName(compared.select("a", "b").distinct()), by_vector


def audited(rows: DataFrame, counted: DataFrame, cosine: float) -> float:
    """Share of the links to other balls that was counted, as a mean over balls that have some.

    One vector is drawn of each ball, so that a crowd counts little, and links in its ball, which
    are always counted, don't count. By brute force, AUDIT_ROWS of the balls whose vector has
    links so far show what share of them was found, and AUDIT_DRAWN of the others how many balls
    have lost all; both are weighted by the number of balls that they stand for.
    """
    drawn = (counted.withColumn("order", F.xxhash64("vec_id", F.lit(SEED + 1)))
             .groupBy("leader").agg(F.min(F.struct("order", "vec_id", (F.col("n_links") - F.col("held") + 1).alias("more"))).alias("one"))
             .select("one.*"))
    drawn = written(drawn)
    balls = {r["some"]: r["count"] for r in drawn.groupBy((F.col("more") > 0).alias("some")).count().collect()}
    first = drawn.orderBy("order", "vec_id")
    asked_of = first.filter("more > 0").limit(AUDIT_ROWS).unionByName(first.filter("more = 0").limit(AUDIT_DRAWN))
    sample = (rows.join(F.broadcast(asked_of.select("vec_id", "more")), "vec_id")
              .join(counted.select("vec_id", "held"), "vec_id").select("vec_id", "embedding", "more", "held").toArrow())
    if not sample.num_rows:
        return 1.0
    ids, asked = sample["vec_id"].to_numpy(), directions(matrix(sample["embedding"].combine_chunks()))

    def count(batches):
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            found, own = directions(matrix(batch.column(1))), batch.column(0).to_numpy(zero_copy_only=False)
            for begin in range(0, len(found), 1024):
                # Links that rounding could decide aren't held against the count.
                near = found[begin:begin + 1024] @ asked.T >= cosine + 1e-12
                total += (near & (own[begin:begin + 1024, None] != ids[None, :])).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["vec_id", "n"])

    true = {r["vec_id"]: r["n"] for r in rows.select("vec_id", "embedding").mapInArrow(count, "vec_id long, n long")
            .groupBy("vec_id").agg(F.sum("n").alias("n")).collect()}
    more = sample["more"].to_numpy()
    lost = np.maximum([true[i] for i in ids.tolist()] - (more + sample["held"].to_numpy() - 1), 0)
    some = more > 0
    share = float((more[some] / (more[some] + lost[some])).mean()) if some.any() else 0.0
    missed = float((lost[~some] > 0).mean()) if (~some).any() else 0.0
    having = balls.get(True, 0) + missed * balls.get(False, 0)
    return share * balls.get(True, 0) / having if having else 1.0


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding",
                 cosine: float = COSINE) -> DataFrame:
    """Columns vec_id, n_links, component_id, kept, audit_recall for each row of `vectors`.

    Links are pairs of cosine at least `cosine` (above 0.5) in double precision. Null, empty and
    zero vectors, those with null or non-finite components and those whose length isn't the most
    frequent one link with nothing. Rows without id have a null component and are kept. An id on
    several rows counts once, with its smallest vector. Equal vectors are linked; ties need no
    rule. An empty table gives an empty result. Other columns are not looked at. audit_recall is
    the audit's figure, 1 where it came upon no link between balls.
    """
    every = vectors.select(F.col(key).cast("long").alias("vec_id"))
    rows = written(one_per_id(usable_rows(vectors, key, column)))
    total = rows.count()
    if not total:
        return finished(every, None, 1.0)
    reach = float(angle(cosine))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE_ROWS).toArrow()
    count = max(1, min(MOST_CENTRES, math.ceil(total / SHARD_ROWS)))
    centres = fit_centres(directions(matrix(sample["embedding"].combine_chunks())), count)
    members = make_balls(rows, centres, total, reach / 2 - SLACK)
    radii = members.groupBy("leader").agg(F.max("angle").alias("radius"), F.count("*").alias("held"))
    leaders = written(radii.join(members.filter(F.col("vec_id") == F.col("leader"))
                                 .select("leader", "embedding"), "leader"))
    probes, searched, before = min(PROBES, len(centres)), 0, None
    while True:
        # Where searching all shards wasn't enough, nothing is left out.
        if probes > len(centres):
            pairs = every_pair(leaders, reach)
        else:
            pairs = linked_balls(leaders, centres, probes, reach, searched)
            pairs = before = written(pairs if before is None else before.unionByName(pairs).distinct())
            searched = max(probes, min(OVERLAP, len(centres)))
        links, more = decide(pairs, members, leaders, cosine)
        counted = written(
            members.join(leaders.select("leader", "held"), "leader").join(more, "vec_id", "left")
            .select("vec_id", "leader", "held", (F.col("held") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")))
        recall = audited(rows, counted, cosine)
        if recall >= AUDIT_RECALL or probes > len(centres):
            break
        probes = len(centres) + 1 if probes == len(centres) else min(2 * probes, len(centres))
    parts = components(links).select(F.col("node").alias("leader"), "component")
    named = counted.join(parts, "leader", "left").withColumn("group", F.coalesce("component", "leader"))
    smallest = named.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    return finished(every, named.join(smallest, "group").select(F.col("vec_id").alias("of"), "n_links", "component_id"), recall)


def finished(every: DataFrame, found: DataFrame | None, recall: float) -> DataFrame:
    if found is None:
        found = every.select(F.col("vec_id").alias("of"), F.lit(0).cast("long").alias("n_links"),
                             F.col("vec_id").alias("component_id")).limit(0)
    component = F.coalesce("component_id", "vec_id")
    return (every.join(found, F.col("vec_id") == F.col("of"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
                    F.lit(recall).alias("audit_recall")))


def op1_neargraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
