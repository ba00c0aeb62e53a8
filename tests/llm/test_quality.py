import re

import numpy as np
import pyarrow.parquet as pq

from rubrica.llm import quality
from tests.llm.conftest import rows

SF_DIR = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


TEXTS = ["", None, " \t\n", "a b c d e a b c d e", "x " * 40, "a\nb\n a\na\n\n\n", "#|<> é é 1 2 3 4 5 1 2 3 4 5 6 1 2 3 4 5 6", "one two three four"]


def base(text):
    m = dict(zip(quality.STATS, quality.measure(text), strict=True))
    return tuple(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_base_numbers():
    texts = TEXTS + pq.read_table(SF_DIR + "/documents.parquet")["text"].to_pylist()[:60]
    assert [base(t) for t in texts] == [brute(t) for t in texts]


def test_repeated_words_at_random():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(0, 3, size=rng.integers(0, 40))
        windows = [tuple(ids[i : i + 5]) for i in range(len(ids) - 4)]
        want = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
        assert quality.repeated_words(np.unique(ids, return_inverse=True)[1]) == len(want)


def test_decisions_agree_with_labels(llm):
    docs = llm.read.parquet(SF_DIR + "/documents.parquet")
    labels = llm.read.parquet(SF_DIR + "/labels.parquet")
    met = quality.judge(docs).join(labels, "doc_id").select("quality", "kept", "base_failed").toPandas()
    good, bad = met[met.quality == 1], met[met.quality == 0]
    assert good[~good.base_failed].kept.mean() > 0.99 and bad.kept.mean() < 0.05


def test_accuracies_are_found():
    """Votes drawn from known accuracies come back, and a lone vote of a poor rule does not condemn."""
    rng = np.random.default_rng(2)
    names = list(quality.rules())
    bad = rng.random(20000) < 0.1
    votes = np.ones((20000, len(names)), dtype=int)
    votes[bad & (rng.random(20000) < 0.95), names.index("symbols")] = -1
    votes[bad & (rng.random(20000) < 0.9), names.index("symbol_words")] = -1
    votes[bad & (rng.random(20000) < 0.6), names.index("letters")] = -1
    votes[~bad & (rng.random(20000) < 0.06), names.index("line_ends")] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, model = quality.estimate(patterns, counts.astype(float), names)
    p = dict(zip(map(tuple, patterns), good, strict=True))
    lone = tuple(-1 if n == "line_ends" else 1 for n in names)
    assert p[lone] > 0.5 and p[tuple(-1 if n in ("symbols", "symbol_words") else 1 for n in names)] < 0.01
    assert abs(model["votes"][names.index("line_ends"), 0, 0] - 0.06) < 0.02


def test_edges(docs):
    got = {r["doc_id"]: r for r in quality.judge(docs(TEXTS)).collect()}
    assert not any(got[i]["kept"] for i in (0, 1, 2, 4, 7)) and got[1]["n_words"] == 0
    assert rows(quality.judge(docs(TEXTS).limit(0))) == []
    assert quality.good_documents(docs(TEXTS)).columns == docs(TEXTS).columns
    fine = " ".join(f"word{i}" for i in range(60)) + "."
    kept = quality.good_documents(docs([fine, fine, None, "### " * 50], ids=[1, 1, None, 3]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1]
