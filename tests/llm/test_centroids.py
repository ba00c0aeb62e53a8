import hashlib

import numpy as np
import pytest

from rubrica.llm import centroids
from tests.llm.conftest import rows

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, v int, rotated int"
COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.fixture
def table(llm):
    return lambda data: llm.createDataFrame([(i, v, "x", 1, 2) for i, v in data], SCHEMA)


def brute(data, k=8, rounds=10, scale=1024, length=64):
    kept = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in data if v is not None and len(v) == length and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in kept]
    if not kept:
        return []
    lot = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, lot(r[0])))[:k]]

    def assign(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        met = [assign(v)[0] for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), m in zip(kept, met, strict=True) if m == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    met = [assign(v) for _, v in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    inertia = {c: sum(d for m, d in met if m == c) for c, _ in met}
    big = {c for c, d in met if d >= 1 << 63}
    fit = lambda x, lost=False: x if x < 1 << 63 and not lost else None
    return [(i, c, fit(d), fit(inertia[c], c in big), fit(sum(inertia.values()), bool(big)), sha[c]) for (i, _), (c, d) in zip(kept, met, strict=True)]


def ordered(found):
    return sorted(found, key=str)


def test_against_brute_force(table):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(5, 64))
    data = [(i, (base[i % 5] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(250)]
    data += [(1000 + i, data[0][1]) for i in range(80)] + [(None, data[1][1]), (7, data[7][1])]
    data += [(2000, None), (2001, [float("nan")] * 64), (2002, [None] * 64), (2003, [float("-inf")] * 64), (2004, []), (2005, [1.0] * 63), (2006, [1.0] * 128)]
    assert ordered(rows(centroids.cluster_digest(table(data)).select(*COLUMNS))) == ordered(brute(data))


def test_few_rows_ties_and_nothing(table):
    data = [(i, [float(i % 2)] * 64) for i in range(5)]
    assert ordered(rows(centroids.cluster_digest(table(data)).select(*COLUMNS))) == ordered(brute(data))
    assert rows(centroids.cluster_digest(table(data).limit(0))) == []
    assert rows(centroids.cluster_digest(table([(1, None), (2, [1.0])]))) == []


def test_huge_components(table):
    rng = np.random.default_rng(5)
    data = [(i, (rng.normal(size=64) * 10.0 ** (i % 14)).astype(np.float32).tolist()) for i in range(60)]
    assert ordered(rows(centroids.cluster_digest(table(data)).select(*COLUMNS))) == ordered(brute(data))


def test_filter_is_exact_and_prunes(table):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(8, 64)) * 300
    m = np.floor(base[rng.integers(0, 8, size=600)] + 40 * rng.normal(size=(600, 64))).astype(np.int64)
    data = [(i, (v / 1024).astype(np.float32).tolist()) for i, v in enumerate(m)]
    d = table(data).selectExpr("vec_id", "embedding e")
    turn = centroids.rotation(d, 64, 1024, 8)
    m = np.array([np.floor(1024 * np.array(v, dtype=np.float32).astype(float)) for _, v in data]).astype(np.int64)
    now = centroids.Centroids(np.floor(base).astype(np.int64), turn)
    cluster, far, measured = now.assign(m, turn.of(m))
    full = ((m[:, None] - now.centres[None]) ** 2).sum(axis=2)
    assert (cluster == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()
    assert measured < 1.5 * len(m)
    assert np.allclose(turn.axes.T @ turn.axes, np.eye(8))
