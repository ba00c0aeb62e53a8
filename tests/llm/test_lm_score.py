import math
from collections import Counter

from rubrica.llm import lm_score
from rubrica.llm.queries import QUERIES
from tests.llm.conftest import rows


def brute(texts, order, alpha=0.4):
    words = [[w.lower() for w in (t or "").split()] for t in texts]
    grams = [Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in words]
    total = sum(grams, Counter())
    everything, out = sum(map(len, words)), []
    for w, own in zip(words, grams, strict=True):
        rest = lambda g, own=own: total[g] - own[g]
        score = 0
        for i in range(len(w)):
            most = min(order, i + 1)
            for k in range(most, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if k > 1 and rest(g) > 0:
                    p = alpha ** (most - k) * rest(g) / rest(g[:-1])
                    break
                if k == 1:
                    p = alpha ** (most - 1) * (rest(g) or alpha) / max(1, everything - len(w))
            score += round(math.log(p) * 1e6)
        out.append((len(w), score))
    return out


TEXTS = ["a b c a b", "A b d", "", None, "x", "a b c a b", "b c a \t b\n\nq", "z " * 3000]


def test_against_counting(docs):
    for order in (1, 2, 3):
        got = sorted(rows(lm_score.scored(docs(TEXTS), order=order)))
        assert [g[1:3] for g in got] == [(n, s) for n, s in brute(TEXTS, order)]


def test_trigrams_are_registered(llm, docs, tmp_path):
    docs(TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(rows(QUERIES["op1_lm_score_trigrams"](llm, str(tmp_path))))
    assert [g[1:3] for g in got] == brute(TEXTS, 3) != brute(TEXTS, 2)


def test_repeated_rows_and_empty_table(docs):
    got = sorted(rows(lm_score.scored(docs(["a b", "a b"], ids=[1, 1]))))
    assert [g[:3] for g in got] == [(1, 2, brute(["a b", "a b"], 2)[0][1])] * 2
    assert rows(lm_score.scored(docs(["a"]).limit(0))) == []
    assert rows(lm_score.scored(docs(["a"], ids=[None])))[0][:2] == (None, 1)


def test_small_blocks_give_the_same(docs, monkeypatch):
    want = sorted(rows(lm_score.scored(docs(TEXTS))))
    monkeypatch.setattr(lm_score, "BLOCK_DOCS", 1)
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 100)
    assert sorted(rows(lm_score.scored(docs(TEXTS)))) == want
