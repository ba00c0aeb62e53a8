import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rubrica.llm import mixing
from tests.llm.conftest import rows


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def corpus(docs, n=600):
    sources = [None if i % 29 == 0 else "big" if i % 3 == 0 else f"s{i % 7}" for i in range(n)]
    texts = [None if i % 41 == 0 else " ".join(["w"] * (i * 7 % 53)) for i in range(n)]
    return docs(texts, sources=sources), sources, [0 if t is None else len(t.split()) for t in texts]


def test_targets_and_totals(docs):
    d, sources, sizes = corpus(docs)
    by_source = {s: sum(z for z, x in zip(sizes, sources, strict=True) if x == s) for s in set(sources)}
    want = brute_targets(by_source)
    got = mixing.mix_digest(d).toPandas()
    assert len(got) == len(sizes) and got["size"].tolist() == [sizes[i] for i in got.doc_id]
    got["source"] = [sources[i] for i in got.doc_id]
    for s, goal in want.items():
        mine = got[got.source.isna()] if s is None else got[got.source == s]
        assert math.isclose(mine.target.iloc[0], goal, rel_tol=1e-12) and (mine.source_size == by_source[s]).all()
        assert mine.taken.sum() == math.floor(goal)
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.mix_digest(d.repartition(7)).toPandas()
    assert sorted(again.itertuples(index=False)) == sorted(got.drop(columns="source").itertuples(index=False))


def test_shards_split_the_quotas(docs):
    d, *_ = corpus(docs)
    placed = mixing.mix(d, shards=5, block_docs=16).select("doc_id", "source", F.explode("copies").alias("c")).select("doc_id", "source", "c.*").toPandas()
    assert placed.shard.notna().all() and set(placed.shard) == set(range(5))
    assert not placed.duplicated(["doc_id", "copy"]).any()
    mixed = mixing.mixed_documents(d, shards=5, block_docs=16)
    assert mixed.columns[:4] == ["doc_id", "text", "lang", "source"] and mixed.count() == len(placed)
    words = mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == placed.taken.sum()


def test_the_stage_gives_shards_in_shuffled_order(llm, docs):
    d, *_ = corpus(docs)
    want = mixing.mixed_documents(d.select(*corpus_pipeline.COLUMNS)).orderBy("shard", "shard_order").select("doc_id", "text")
    assert rows(corpus_pipeline.mix_sources(llm, d, "").select("doc_id", "text")) == rows(want)


def test_tree_keeps_sums(llm):
    units = [1500, 300, 0, 77, 5]
    q = llm.createDataFrame(list(enumerate(units)), "number long, units long")
    got = mixing.split_quotas(q, 7, "s").toPandas()
    got["n"] = got["last"] - got["first"]
    assert got.groupby("number").n.sum().tolist() == units and (got.n >= 0).all()
    per_shard = got.groupby("shard").n.sum()
    assert per_shard.max() - per_shard.min() <= 1
    for _, g in got.sort_values("shard").groupby("number"):
        assert g["first"].tolist() == [0, *g["last"].tolist()[:-1]]


@pytest.mark.parametrize(("total", "good", "drawn"), [(50, 20, 15), (10, 10, 4), (10, 0, 4), (7, 3, 7), (0, 0, 0), (40, 39, 2)])
def test_hypergeometric(llm, total, good, drawn):
    n = 4000
    u = (F.col("id") + 0.5) / n
    got = llm.range(n).select(mixing.hypergeometric(F.lit(total).cast("long"), F.lit(good).cast("long"), F.lit(drawn).cast("long"), u).alias("k"))
    share = {r["k"]: r["count"] / n for r in got.groupBy("k").count().collect()}
    for k in range(drawn + 1):
        p = math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn) if k <= good else 0
        assert abs(share.get(k, 0) - p) < 1e-3


def test_edges(docs):
    assert rows(mixing.mix_digest(docs(["a"]).limit(0))) == []
    assert rows(mixing.mix_digest(docs([None, ""]))) == [(0, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)]
    twice = rows(mixing.mix_digest(docs(["a b c"] * 4, ids=[1, 1, 2, None], sources=["s"] * 4)))
    assert len(twice) == 4 and sum(r[4] for r in twice) in (17, 18)


def test_first_words(llm):
    d = llm.createDataFrame([(" a  b\tc\n", 2), ("a", 1), ("", 0), ("é\x0bü z", 2)], "t string, n long")
    assert [r[0] for r in d.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == [" a  b", "a", "", "é\x0bü"]
