import numpy as np
import pytest

from hubloom.llm import ann, neargraph


def frame(spark, rows, ids=None):
    ids = range(len(rows)) if ids is None else ids
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows)], "vec_id long, embedding array<double>")


def clustered(seed=0, n=700, d=24):
    """Scattered vectors, a crowd of near copies, equal vectors, and a chain of links."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=(n, d)), rng.normal(size=d) + 0.05 * rng.normal(size=(250, d)),
            rng.normal(size=d) + 0.28 * rng.normal(size=(80, d)), np.repeat(rng.normal(size=(1, d)), 40, axis=0)]
    a, b = np.linalg.qr(rng.normal(size=(d, 2)))[0].T
    rows.append(np.array([np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 3, 0.3)]))
    rows = np.concatenate(rows)
    return rows[rng.permutation(len(rows))] * rng.uniform(0.1, 9, (len(rows), 1))


def brute_links(rows, cosine=0.9):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    group = np.arange(len(rows))
    while True:
        new = np.minimum(group, np.where(near, group[None, :], len(rows)).min(axis=1))
        if (new == group).all():
            return near.sum(axis=1), group
        group = new


@pytest.mark.parametrize("seed", range(2))
def test_links_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(neargraph, "SHARD_ROWS", 200)
    monkeypatch.setattr(neargraph, "BLOCK_ROWS", 120)
    rows = clustered(seed)
    links, group = brute_links(rows)
    found = {r["vec_id"]: r for r in neargraph.near_vectors(frame(spark, rows)).collect()}
    assert [found[i]["n_links"] for i in range(len(rows))] == links.tolist()
    assert [found[i]["component_id"] for i in range(len(rows))] == group.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["audit_recall"] == 1 for r in found.values())


def test_balls_are_cliques():
    rows = neargraph.directions(clustered(3))
    radius = float(neargraph.angle(0.9)) / 2 - neargraph.SLACK
    leader = neargraph.choose_leaders(rows, radius)
    assert (leader[leader] == leader).all() and len(np.unique(leader)) < len(rows) - 250
    for one in np.unique(leader):
        own = rows[leader == one]
        assert (own @ own.T).min() >= 0.9


def test_robust_prune_rule():
    rows = neargraph.directions(np.random.default_rng(2).normal(size=(60, 6)))
    near = rows @ rows.T
    np.fill_diagonal(near, -2)
    pool = np.argsort(-near, axis=1)[:, :20]
    kept = neargraph.robust_prune(rows, pool, degree=5)
    distance = np.sqrt(np.maximum(2 - 2 * rows @ rows.T, 0))
    for p in range(60):
        left, expected = list(pool[p]), []
        while left and len(expected) < 5:
            star = left.pop(0)
            expected.append(star)
            left = [c for c in left if neargraph.ALPHA * distance[star, c] > distance[p, c]]
        assert [k for k in kept[p] if k >= 0] == expected


def test_search_from_the_medoid_alone():
    rows = neargraph.directions(clustered(5))
    graph = neargraph.build_graph(rows)
    near = rows @ rows.T >= 0.9
    q, node = neargraph.range_search(rows, np.zeros(len(rows)), graph, rows, np.zeros(len(rows)),
                                     np.full(len(rows), -1), float(neargraph.angle(0.9)))
    assert len(set(zip(q.tolist(), node.tolist()))) >= 0.9 * near.sum()


def test_recall_of_nearest(spark):
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(size=(3000, 48)), rng.normal(size=48) + 0.1 * rng.normal(size=(300, 48))])
    ids = rng.permutation(len(rows))
    found = {}
    for r in ann.nearest(frame(spark, rows, ids)).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        scores = unit @ unit[q]
        scores[q] = -2
        best = np.lexsort((ids, -scores))[:5]
        mine = found[ids[q]]
        assert sorted(mine) == [1, 2, 3, 4, 5]
        assert [mine[k][1] for k in range(1, 6)] == sorted((mine[k][1] for k in range(1, 6)), reverse=True)
        for vec_id, score in mine.values():
            assert score == pytest.approx(unit[np.flatnonzero(ids == vec_id)[0]] @ unit[q], abs=1e-12)
        hits += len({ids[b] for b in best} & {v for v, _ in mine.values()})
        total += 5
    assert len(found) == (ids % 50 == 0).sum() and hits / total >= 0.95


def test_ties_go_to_the_smaller_id(spark):
    rows = np.array([[1.0, 0.0]] * 9 + [[0.0, 1.0]])
    result = ann.nearest(frame(spark, rows, [50, 7, 3, 9, 1, 8, 2, 6, 4, 11])).orderBy("rank").collect()
    assert [r["vec_id"] for r in result] == [1, 2, 3, 4, 6]


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, 256)
    bits = np.array([np.where(rng.random(256) < rng.uniform(0, 0.2), 1 - base, base) for _ in range(400)])
    codes = np.packbits(bits.astype(bool), axis=1).view(np.uint64)
    index = ann.SubstringIndex(codes)
    for radius in (0, 5, 15, 16, 31, 32, 40, 63, 100, 127, 200, 255):
        hits = set(index.probe(codes[0], radius).tolist())
        near = set(np.flatnonzero(ann.bits_apart(codes, codes[0]) <= radius).tolist())
        assert near <= hits and 0 in near
    assert len(index.probe(codes[0], 15)) < 400 == len(index.probe(codes[0], 255))


def test_search_ends_at_the_radius_of_the_kth_cosine():
    """Every row within the radius is ranked, and the radius covers the k-th cosine; far and near queries."""
    rng = np.random.default_rng(6)
    rows = ann.directions(np.concatenate([rng.normal(size=(500, 32)), rng.normal(size=32) + 0.1 * rng.normal(size=(60, 32))]))
    projection = ann.learn_codes(rows)
    index = ann.SubstringIndex(ann.encode(rows, projection))
    used = set()
    for q in (3, 77, 510, 540):
        hits, scores, radius = ann.within_radius(index, rows, np.arange(len(rows)) != q, index.codes[q], rows[q], 5)
        apart = ann.bits_apart(index.codes, index.codes[q])
        assert set(hits.tolist()) == set(np.flatnonzero(apart <= radius).tolist()) - {q}
        assert scores == pytest.approx(rows[hits] @ rows[q])
        assert radius == ann.BITS or ann.radius_for(np.sort(scores)[-5]) <= radius
        used.add(radius)
    assert len(used) > 1 and max(used) <= ann.BITS


def islands(seed=4, groups=12, each=60, d=24):
    """Groups of more rows than a pool holds; rows of a group are nearer to all of theirs than to any other."""
    rng = np.random.default_rng(seed)
    middle = neargraph.directions(rng.normal(size=(groups, d)))
    return neargraph.directions(np.repeat(middle, each, axis=0) + 0.11 * rng.normal(size=(groups * each, d)))


def test_every_node_of_islands_is_reached():
    rows = islands()
    graph = neargraph.build_graph(rows)
    seen, front = set(), {int((rows @ rows.mean(axis=0)).argmax())}
    while front:
        seen |= front
        front = {int(k) for node in front for k in graph[node] if k >= 0} - seen
    assert len(seen) == len(rows)
    near = rows @ rows.T >= 0.9
    q, node = neargraph.range_search(rows, np.zeros(len(rows)), graph, rows, np.zeros(len(rows)),
                                     np.full(len(rows), -1), float(neargraph.angle(0.9)))
    assert len(set(zip(q.tolist(), node.tolist()))) >= 0.99 * near.sum()


def test_unreachable_rows_are_strung_together():
    rows = neargraph.directions(np.random.default_rng(6).normal(size=(300, 8)))
    graph = neargraph.connected(rows, np.full((300, 2), -1, np.int32))
    assert neargraph.reached(graph, neargraph.medoid_of(rows)).all() and graph.shape[1] <= neargraph.JOINS + 1


def test_what_the_search_loses_is_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(neargraph, "SHARD_ROWS", 200)
    monkeypatch.setattr(neargraph, "BLOCK_ROWS", 120)
    monkeypatch.setattr(neargraph, "linked_balls", lambda leaders, *_: leaders.selectExpr("leader a", "leader b").limit(0))
    rows = clustered(7)
    links, group = brute_links(rows)
    found = {r["vec_id"]: r for r in neargraph.near_vectors(frame(spark, rows)).collect()}
    assert [found[i]["n_links"] for i in range(len(rows))] == links.tolist()
    assert [found[i]["component_id"] for i in range(len(rows))] == group.tolist()


def test_a_crowd_does_not_hide_lost_links(spark, monkeypatch):
    """A ball of copies holds most links; the pairs beside it are all lost by the search."""
    monkeypatch.setattr(neargraph, "linked_balls", lambda leaders, *_: leaders.selectExpr("leader a", "leader b").limit(0))
    rng = np.random.default_rng(8)
    one, other = (neargraph.directions(rng.normal(size=(200, 64))) for _ in range(2))
    pairs = np.concatenate([one, 0.93 * one + np.sqrt(1 - 0.93 ** 2) * neargraph.directions(
        other - (one * other).sum(axis=1, keepdims=True) * one)])
    rows = np.concatenate([np.repeat(rng.normal(size=(1, 64)), 1600, axis=0), pairs])[rng.permutation(2000)]
    links, _ = brute_links(rows)
    found = {r["vec_id"]: r["n_links"] for r in neargraph.near_vectors(frame(spark, rows)).collect()}
    assert [found[i] for i in range(len(rows))] == links.tolist()


def test_audit_counts_balls_that_lost_all(spark):
    rng = np.random.default_rng(9)
    one = rng.normal(size=(50, 32))
    rows = np.concatenate([one, one + 0.05 * rng.normal(size=(50, 32))])
    # Each row a ball of its own; of the 50 pairs 10 are lost.
    counted = spark.createDataFrame([(i, i, 1, int(i % 50 >= 10)) for i in range(100)],
                                    "vec_id long, leader long, held long, n_links long")
    assert neargraph.audited(frame(spark, rows), counted, 0.9) == pytest.approx(0.8)


def test_queries_begin_near_the_radius_that_their_block_needs(monkeypatch):
    """Vectors without near neighbours: few probes a query, and the rows of a search of all."""
    draw, probes, probe = np.random.default_rng(12), [], ann.SubstringIndex.probe
    rows = ann.directions(draw.normal(size=(1500, 32)))
    ids, projection = np.arange(1500), ann.learn_codes(rows[:500])
    monkeypatch.setattr(ann.SubstringIndex, "probe", lambda *given: probes.append(given[2]) or probe(*given))
    q, hits, scores = ann.search(ids, rows, ids[:60], rows[:60], projection, 5)
    assert len(probes) <= 3 * 60
    cosines = rows[:60] @ rows.T
    cosines[np.arange(60), np.arange(60)] = -2
    wanted = np.argsort(-cosines, axis=1)[:, :5]
    assert np.mean([h in wanted[i] for i, h in zip(q, hits)]) >= 0.99 and len(hits) == 300
