import random

import numpy as np
import pytest

from rubrica.llm import jaccard
from tests.llm.conftest import rows


def shingles(text):
    words = [w.lower() if w.isascii() else w for w in (text or "").split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(items):
    sets = [(i, shingles(t)) for i, t in items]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 6) + str(rng.randint(0, 400))
    passage = [word() for _ in range(25)]
    texts = [[word() for _ in range(rng.choice([1, 3, 5, 20, 60, 200]))] for _ in range(n // 3)]
    for t in texts[::3]:
        at = rng.randint(0, len(t))
        t[at:at] = passage
    while len(texts) < n:
        t = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 2, 3, len(t) // 25])):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    return [rng.choice([" ", "\n", " \t"]).join(t) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(docs, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 500)
    texts = corpus(seed) + ["", None, " \t ", "One two", "one TWO", "one two three"]
    assert sorted(rows(jaccard.linked(docs(texts)))) == brute(list(enumerate(texts)))


@pytest.mark.parametrize(("short", "long"), [(7, 8), (10, 12), (19, 24)])
def test_pairs_at_the_bound(docs, short, long):
    """All of the short text's shingles are three quarters of the long one's, wherever the hash puts the others."""
    texts = [" ".join(f"p{i}w{k}" for k in range(n)) for i in range(60) for n in (short, long)]
    assert sorted(rows(jaccard.linked(docs(texts)))) == [(i, (short, long)[i % 2] - 4, i - i % 2) for i in range(120)]


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_least_met_in_the_worst_order(percent):
    """Both first have the tokens that the other lacks, which leaves as few common ones before the cuts as any order."""
    for n in range(1, 90):
        met = []
        for other in range(1, 2 * n + 1):
            for common in range(1, min(n, other) + 1):
                if 100 * common >= percent * (n + other - common):
                    cuts = [int(jaccard.leading(np.int64(k), percent, 0.35)) - (k - common) for k in (n, other)]
                    met.append(max(0, min(cuts)))
        assert jaccard.least_met(n, percent, 0.35) == min(met) >= 1


def test_large_group_of_near_copies(docs):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(150)] = f"x{i}"
        texts.append(" ".join(t))
    got = rows(jaccard.linked(docs(texts)))
    assert {r[2] for r in got} == {0} and len(got) == 300


def test_edges(docs):
    text = " ".join(f"w{i}" for i in range(30))
    got = sorted(rows(jaccard.linked(docs([text, text, text, "", ""], ids=[5, 5, 3, 3, 1]))))
    assert [(i, c) for i, _, c in got] == [(1, 1), (3, 3), (3, 3), (5, 3), (5, 3)]
    assert rows(jaccard.linked(docs([text]).limit(0))) == []
    d = docs([text, text, "other words that stand here alone", None])
    kept = jaccard.one_of_each(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_null_ids_link_and_bridge(docs):
    base = [f"w{i}" for i in range(40)]
    near = [*base[:10], "x", *base[11:]]
    far = [*base[:10], "x", *base[11:25], "y", *base[26:]]
    a, n, b = (" ".join(t) for t in (base, near, far))
    d = docs([a, n, b, n, "alone here are five words", "", None, "twice the same text stands here", "twice the same text stands here"], ids=[1, None, 2, None, None, None, None, None, None])
    got = sorted(rows(jaccard.linked(d)), key=str)
    assert got == sorted([(1, 36, 1), (2, 36, 1), (None, 36, 1), (None, 36, 1), (None, 1, None), (None, 0, None), (None, 0, None), (None, 2, None), (None, 2, None)], key=str)
    assert sorted(rows(jaccard.linked(docs([a, b], ids=[1, 2])))) == [(1, 36, 1), (2, 36, 2)]  # without the bridge


def test_rounds_go_on_while_many_pairs_are_ahead(docs, monkeypatch):
    """Documents with two words changed are near those with one, but not near each other: a leader does not reach all."""
    rng = random.Random(11)
    base, texts = [f"w{i}" for i in range(120)], []
    for i in range(160):
        t = list(base)
        for _ in range(1 + i % 2):
            t[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(t))
    ahead, count = [], jaccard._pairs_ahead
    monkeypatch.setattr(jaccard, "_pairs_ahead", lambda w: ahead.append(count(w)) or ahead[-1])
    assert sorted(rows(jaccard.linked(docs(texts), spare=0.5))) == brute(list(enumerate(texts)))
    assert len(ahead) >= 2 and ahead[-1] < ahead[0] / 10


def test_components_are_exact(llm):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = dict(rows(jaccard.components(llm.createDataFrame(edges, "a long, b long"))))
    assert got == {x: find(x) for x in root if any(find(y) == find(x) for y in root if y != x)}


def test_sketches_tell_unlike_sets_apart(spark):
    """Sketches differ in no more bits than the sets do in tokens, and leave out most of the pairs that are nearly similar enough."""
    import numpy as np

    rng, sets = np.random.default_rng(3), []
    for changed in range(0, 60, 4):
        one = rng.integers(0, 1 << 63, 146, dtype=np.uint64)
        two = np.concatenate([one[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)])
        sets.append((changed, *[np.unique(v * np.uint64(2)).view(np.int64) for v in (one, two)]))
    rows_ = [(c, len(a), len(b), *[[int(x) for x in jaccard.sketch(v)] for v in (a, b)]) for c, a, b in sets]
    df = spark.createDataFrame(rows_, "changed int, n int, n_b int, sketch array<bigint>, sketch_b array<bigint>")
    near = {r["changed"] for r in df.filter(jaccard._alike(75)).collect()}
    for c, a, b in sets:
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * (len(a) + len(b) - common):
            assert c in near
    assert max(near) < 32  # 0.64 and less are told apart


def near_copies(n, words, changed, seed=5):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        t = [f"w{k}" for k in range(words)]
        for j in range(changed):
            t[rng.randrange(words)] = f"x{i}y{j}"
        texts.append(" ".join(t))
    return texts


def test_a_pair_meets_about_once(docs, monkeypatch):
    """Every pair that meets at any token comes out of the last join, from about one token and not from all in common."""
    seen, met = [], jaccard._met
    monkeypatch.setattr(jaccard, "_met", lambda where, percent: seen.append((where, met(where, percent))) or seen[-1][1])
    texts = near_copies(60, 150, 2)
    assert sorted(rows(jaccard.linked(docs(texts), spare=1e9))) == brute(list(enumerate(texts)))
    where, pairs = seen[0]
    places = where.withColumnRenamed("row", "a").join(jaccard._beside(where), "token").filter(f"a < b AND {jaccard._near(75)}")
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(r["a"], r["b"]) for r in places.select("a", "b").collect()}
    assert places.count() > 5 * pairs.count() > 0
    assert places.filter("NOT arrays_overlap(before, before_b)").count() < 1.2 * pairs.count()


def test_shuffle_files_go_as_the_job_runs(llm, docs):
    """Tens of short queries leave no shuffle files behind; those of one query are dropped when it ends."""
    disk = llm._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: sum(f.getName().startswith("shuffle_") for f in (disk.getAllFiles().apply(i) for i in range(disk.getAllFiles().size())))
    before = held()
    jaccard.linked(docs(near_copies(40, 80, 3)))
    assert held() - before < 50
    assert llm.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
