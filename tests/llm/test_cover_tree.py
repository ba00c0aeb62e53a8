import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.llm import cover_tree
from tests.llm.conftest import rows

SCHEMA = "vec_id bigint, embedding array<float>, id string, cell int, tree string"


@pytest.fixture
def table(llm):
    return lambda data: llm.createDataFrame([(i, v, "x", 1, "t") for i, v in data], SCHEMA)


def brute(data, queries, k):
    usable = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float))) for i, v in data if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for me, (i, q) in enumerate(usable):
        if i in queries:
            found = sorted((-int(q @ v), j is None, j or 0) for at, (j, v) in enumerate(usable) if at != me and len(v) == len(q))[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found)]
    return sorted(out, key=str)


def test_repeated_ids_are_rows_of_their_own(table):
    rng = np.random.default_rng(4)
    data = [(i % 60, rng.integers(-3, 4, size=4).astype(float).tolist()) for i in range(300)] + [(0, [1.0, 2.0, 3.0, 4.0])] * 3 + [(None, [3.0, 3.0, 3.0, 3.0])]
    got = rows(cover_tree.top_k(table(data), F.col("id") % 20 == 0, k=6, block_rows=64, query_rows=8, pivots=3))
    assert sorted(got, key=str) == brute(data, {0, 20, 40}, 6)


def test_against_brute_force(table):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    data = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(900)]
    data += [(1000 + i, data[0][1]) for i in range(60)] + [(2000, None), (2001, [float("nan")] * 8), (2002, [None] * 8), (2003, [float("inf")] * 8), (2005, [])]
    got = rows(cover_tree.top_k(table(data), F.col("id") % 50 == 0, k=7, block_rows=128, query_rows=8, pivots=5))
    assert sorted(got, key=str) == brute(data, {i for i, _ in data if i % 50 == 0}, 7)


def test_grid_of_many_cells(llm, table, monkeypatch):
    """Blocks over many cells and partitions, none of them merged: every pair of blocks meets once."""
    monkeypatch.setattr(cover_tree, "SIDE", 2)
    llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(8)
        data = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(800)]
        got = rows(cover_tree.top_k(table(data), F.col("id") % 10 == 0, k=5, block_rows=64, query_rows=8, pivots=4))
        assert sorted(got, key=str) == brute(data, set(range(0, 800, 10)), 5)
    finally:
        llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_few_rows_and_other_lengths(table):
    data = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (100, [1.0, 1.0, 1.0])]
    got = rows(cover_tree.top_k(table(data), F.col("id") % 100 == 0))
    assert sorted(got) == [(0, 1, 2, 1024 * 1024), (0, 2, 1, 1024 * 512)]
    assert rows(cover_tree.top_k(table(data).limit(0), F.col("id") % 100 == 0)) == []


def test_tree_covers():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(1500, 4)) * 100)
    t = cover_tree.Tree(v, np.arange(1500))
    for node in range(len(t.centre)):
        mine = t.points[t.perm[t.spans[node, 0] : t.spans[node, 1]]]
        assert (np.sqrt(((mine - t.points[t.centre[node]]) ** 2).sum(axis=1)) <= t.radius[node] + 1e-9).all()
        kids = range(*t.kids[node])
        assert not kids or sum(t.spans[c, 1] - t.spans[c, 0] for c in kids) == len(mine)


def test_pruning_drops_nodes(monkeypatch):
    rng = np.random.default_rng(9)
    near, far = rng.normal(size=(500, 6)) + 20, rng.normal(size=(2000, 6)) - 20
    q, d = cover_tree.Tree(np.floor(near * 50), np.arange(500)), cover_tree.Tree(np.floor(np.vstack([near, far]) * 50), np.arange(2500))
    offers = []
    plain = cover_tree.Best.offer
    monkeypatch.setattr(cover_tree.Best, "offer", lambda self, r, s, i, n: (offers.append(s.size), plain(self, r, s, i, n))[1])
    cover_tree.search(q, d, 3, np.full(500, -np.inf))
    assert sum(offers) < 500 * 2500 * 0.6
