import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rubrica.llm import vector_codes
from tests.llm.conftest import rows

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, cell int, total int"


@pytest.fixture
def table(llm):
    return lambda data: llm.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in data], SCHEMA)


def brute(data, parts=8, entries=16, rounds=6, scale=4096):
    """The contract in Python integers: (vec_id, code, error, label_error, sha) of usable rows."""
    usable = [(i, np.array(v, dtype=np.float32).astype(float), label) for i, v, label in data if v and all(x is not None and np.isfinite(x) for x in v)]
    usable = [u for u in usable if len(u[1]) % parts == 0]
    if not usable:
        return []
    sizes = [len(v) for _, v, _ in usable]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n))
    whole = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in usable if len(v) == size]
    whole.sort(key=lambda u: (u[0] is None, u[0] or 0, u[1]))
    width = size // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in whole[:entries]] for p in range(parts)]

    def assign(v):
        out = []
        for p in range(parts):
            d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        met = [assign(v) for _, v, _ in whole]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), m in zip(whole, met, strict=True) if m[p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    met = [assign(v) for _, v, _ in whole]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for _, d in m) for m in met]
    by_label = {}
    for (_, _, label), e in zip(whole, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{e:02x}" for e, _ in m), err, by_label[label], sha) for (i, _, label), m, err in zip(whole, met, errors, strict=True)]


def ordered(found):
    return sorted(found, key=str)


@pytest.mark.parametrize("size", [8, 24, 64])
def test_against_brute_force(table, size):
    rng = np.random.default_rng(size)
    base = rng.normal(size=(9, size))
    data = [(i, (base[i % 9] + 0.2 * rng.normal(size=size)).astype(np.float32).tolist(), None if i % 7 == 0 else i % 3) for i in range(150)]
    data += [(500 + i, data[3][1], 1) for i in range(40)] + [(3, data[5][1], 2), (None, data[6][1], None)]
    data += [(600, None, 1), (601, [float("nan")] * size, 1), (602, [None] * size, 1), (603, [float("inf")] * size, 1), (604, [], 1), (605, [1.0] * 16, 1), (606, [1.0] * 7, 1)]
    got = rows(vector_codes.code_digest(table(data)).select("vec_id", "code", "error", "label_error", "codebooks_sha256"))
    assert ordered(got) == ordered(brute(data))


def test_few_rows_ties_and_nothing(table):
    data = [(2, [0.0] * 8, None), (1, [1.0] * 8, None), (7, [0.5] * 8, 4), (9, [1.0] * 8, 4)]
    got = rows(vector_codes.code_digest(table(data)).select("vec_id", "code", "error", "label_error", "codebooks_sha256"))
    assert ordered(got) == ordered(brute(data))
    assert rows(vector_codes.code_digest(table(data).limit(0))) == []
    assert rows(vector_codes.code_digest(table([(1, None, 1), (2, [], 2), (3, [1.0], 3)]))) == []


def test_huge_components(table):
    """Sums and distances beyond 64 bits stay exact; an error that does not fit a long is null."""
    data = [(i, [float(x) for x in np.float32([1e12 * (i % 3), -1e12, 3e11 * i, 1, 2, 3, 4, 5e10])], i % 2) for i in range(30)]
    want = [(i, c, e if e < 1 << 63 else None, s) for i, c, e, _, s in brute(data)]
    got = rows(vector_codes.code_digest(table(data)).select("vec_id", "code", "error", "codebooks_sha256"))
    assert ordered(got) == ordered(want)


def test_round_trip(table):
    data = [(i, [float(i % 3)] * 16, 1) for i in range(30)]
    books = vector_codes.fit(table(data))
    back = dict(rows(vector_codes.decode(vector_codes.encode(table(data), books), books)))
    assert back == {i: [4096 * (i % 3)] * 16 for i in range(30)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 9), st.integers(1, 12), st.integers(0, 10**6))
def test_transform_keeps_distances(n, k, width, seed):
    rng = np.random.default_rng(seed)
    x, e = rng.integers(-3, 4, size=(n, width)), rng.integers(-3, 4, size=(k, width))
    hx, he = vector_codes.hadamard(x), vector_codes.hadamard(e)
    size = hx.shape[1]
    full = ((x[:, None] - e[None]) ** 2).sum(axis=2)
    assert (((hx[:, None] - he[None]) ** 2).sum(axis=2) == size * full).all()
    entry, scaled, _ = vector_codes.nearest(hx, he)
    assert (entry == full.argmin(axis=1)).all() and (scaled == size * full.min(axis=1)).all()


def test_sequency_and_elimination():
    h = vector_codes.hadamard(np.eye(16, dtype=np.int64)).T
    assert [int((r[1:] != r[:-1]).sum()) for r in h] == list(range(16))
    rng = np.random.default_rng(1)
    e = np.repeat(rng.integers(-400, 400, size=(16, 1)), 8, axis=1)  # parts that differ in their means
    x = e[rng.integers(0, 16, size=500)] + rng.integers(-5, 6, size=(500, 8))
    _, _, work = vector_codes.nearest(vector_codes.hadamard(x), vector_codes.hadamard(e))
    assert work < 500 * 16 * 8 * 0.45
