"""Runs against the definition, tried place by place."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubloom.llm import periodic


def brute_runs(w):
    """Every stretch by its definition: period q, not to be extended, long enough, no smaller period."""
    runs = []
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k + q < len(w):
            if w[k] != w[k + q]:
                k += 1
                continue
            end = k
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            piece = w[k:end + q]
            if len(piece) >= max(6, 4 * q) and not any(piece[p:] == piece[:-p] for p in range(1, q)):
                runs.append((k, len(piece), q))
            k = end
    return sorted(runs, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *told, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def sample(draw):
    kind, n = draw.randrange(6), draw.randint(0, 260)
    if kind == 0:
        return [draw.choice("ab") for _ in range(n)]
    if kind == 1:
        return [draw.choice("abcdefghijklmnop") for _ in range(n)]
    parts = []
    while len(parts) < n:
        unit = [draw.choice("abcdef") for _ in range(draw.choice([1, 1, 2, 3, 5, 18, 33, 50]))]
        parts += unit * draw.choice([1, 2, 4, 5, 9]) + [f"x{draw.randint(0, 5)}"] * draw.randint(0, 7)
        parts += unit[:draw.randint(0, len(unit))]
    return parts


@pytest.mark.parametrize("seed", range(4))
def test_lag_scan_equals_definition(monkeypatch, seed):
    monkeypatch.setattr(periodic, "SHORT_LAGS", [1, 2, 4, 16][seed])
    draw = random.Random(seed)
    for _ in range(120):
        w = sample(draw)
        ids = np.array([hash(x) for x in w], np.int64)
        runs, _ = periodic.document_runs(ids, np.array([0, len(w)]))
        assert [tuple(r) for r in runs.tolist()] == brute_runs(w)


def test_splitting_by_definition():
    draw = random.Random(9)
    for _ in range(200):
        w = [draw.choice("abcdefg") for _ in range(draw.randint(0, 80))]
        todo, kept = [list(range(len(w)))], []
        while todo:
            part = todo.pop()
            rare = [i for i in part if sum(w[k] == w[i] for k in part) < 4]
            if not rare:
                kept += part
                continue
            for a, b in zip([part[0] - 1, *rare], [*rare, part[-1] + 1]):
                if b - a - 1 >= 6:
                    todo.append(list(range(a + 1, b)))
        place = periodic.surviving(np.array([ord(x) for x in w], np.int64), np.zeros(len(w), np.int64))
        assert place.tolist() == sorted(kept)


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(11)
    docs = [(k, " ".join(sample(draw)) if k % 3 else "  \n".join(f"w{draw.randint(0, 400)}" for _ in range(draw.randint(1, 300))))
            for k in range(1, 400)]
    docs += [(None, "a b " * 5), (7, docs[6][1]), (7, docs[6][1]), (400, None), (401, ""), (402, " \t\n"), (403, "é " * 9), (404, "A a " * 6)]
    docs += [(405 + k, " ".join(f"{x}" for x in range(9000))) for k in range(20)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "runs", "n_words", "collapsed", "start")})
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in periodic.op13_periodic(spark, str(tmp_path)).collect()), key=str)
    want = [brute_row(d, t) for d, t in docs if d is None or d < 405]
    at = next(k for k, (d, _) in enumerate(docs) if d is None)
    assert docs[at][0] is None
    assert [r for r in got if r[0] is None or r[0] < 405] == sorted(want, key=str)
    assert len(got) == len(docs)
    assert periodic.find_runs(rows.filter("false")).count() == 0


def test_long_sequences():
    draw = np.random.default_rng(3)
    unit = draw.integers(0, 50, 7000)
    constant = np.zeros(60000, np.int64)
    ids = np.concatenate([draw.integers(0, 50, 5000), np.tile(unit, 5)[:31000], [99], constant, [98]])
    runs, _ = periodic.document_runs(ids, np.array([0, len(ids)]))
    tiles = [r for r in runs.tolist() if r[2] > 100]
    assert [r[2] for r in tiles] == [7000] and tiles[0][1] >= 31000
    assert [r for r in runs.tolist() if r[1] > 50000] == [[36001, 60000, 1]]
