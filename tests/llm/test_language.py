import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from rubrica.llm import language
from tests.llm.conftest import rows

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth():
    t = pq.read_table(SF_DIR + "/documents.parquet", columns=["doc_id", "lang"]).to_pydict()
    return dict(zip(t["doc_id"], t["lang"], strict=True))


def test_held_out_accuracy(llm, truth):
    got = rows(language.language_digest(llm.read.parquet(SF_DIR + "/documents.parquet")))
    assert len(got) == len(truth)
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h, _, _ in got)
    held = [(truth[i] == p, s) for i, h, p, s in got if h]
    assert np.mean([ok for ok, _ in held]) > 0.98
    # calibrated: the mean score is the accuracy
    assert abs(np.mean([s for _, s in held]) - np.mean([ok for ok, _ in held])) < 0.03
    assert all(0 <= s <= 1 for *_, s in got)


def test_weights_are_sparse(llm):
    model = language.fit(llm.read.parquet(SF_DIR + "/documents.parquet"), sample_rows=400)
    assert (model.weights == 0).mean() > 0.5 and model.temperature > 0 and model.langs == ["de", "en", "es", "fr"]


def test_held_out_labels_teach_nothing(llm):
    from pyspark.sql import functions as F

    docs = llm.read.parquet(SF_DIR + "/documents.parquet").limit(400)
    held = language.held_out(F.col("doc_id"))
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("zz"))
    assert sorted(rows(language.language_digest(docs))) == sorted(rows(language.language_digest(other)))


def test_edges(docs):
    texts = ["the cat and the dog", "le chat et le chien", None, "", " 12 ## ", "the", "le", "x" * 100000] * 3
    langs = ["en", "fr", "en", "en", None, "en", "fr", None] * 3
    got = {i: (p, s) for i, _, p, s in rows(language.language_digest(docs(texts, langs=langs)))}
    assert all(got[i] == ("und", 0.0) for i in range(24) if i % 8 in (2, 3, 4)) and len(got) == 24
    assert {got[i][0] for i in range(24) if i % 8 in (0, 1, 5, 6, 7)} <= {"en", "fr"}
    assert rows(language.language_digest(docs(texts).limit(0))) == []
    assert {p for _, _, p, _ in rows(language.language_digest(docs(["a", "b"])))} == {"und"}
    one = rows(language.language_digest(docs(["abc"] * 6, langs=["en"] * 6)))
    assert {(p, s) for _, _, p, s in one} == {("en", 1.0)}
