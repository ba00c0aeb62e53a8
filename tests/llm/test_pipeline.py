import random

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from rubrica.llm import quality
from rubrica.llm.queries import ORACLES, QUERIES
from rubrica.session import shared_dir
from tests.compare import check, connect
from tests.llm.test_jaccard import brute as components
from tests.llm.test_secrets import brute as spans

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and what each stage left."""
    out = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        folder = shared_dir(spark, name)
        stage(spark, out[-1], SF_DIR).write.parquet(folder)
        out.append(spark.read.parquet(folder))
    return [d.toPandas() for d in out]


def test_columns(stages):
    columns = pq.read_schema(f"{SF_DIR}/documents.parquet").names
    assert all(list(d.columns) == columns for d in stages[:-1])


def test_quality_stage(stages):
    kept = set(stages[1].doc_id)
    for i, t in zip(stages[0].doc_id, stages[0].text, strict=True):
        m = dict(zip(quality.STATS, quality.measure(t), strict=True))
        if m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]:
            assert i not in kept
    assert len(kept) > 0.7 * len(stages[0])


def test_join_stage(stages):
    want = {i for i, _, c in components(list(zip(stages[1].doc_id, stages[1].text, strict=True))) if i == c}
    assert set(stages[2].doc_id) == want and len(stages[2]) == len(want)


def test_secret_stage(stages):
    before = dict(zip(stages[2].doc_id, stages[2].text, strict=True))
    assert set(stages[3].doc_id) == set(before)
    for i, t, n in zip(stages[3].doc_id, stages[3].text, stages[3].n_chars, strict=True):
        assert (t == before[i]) == (not spans(before[i])) and n == len(t)
        assert not [s for s in spans(t) if s[0] != "entropy"]


def test_mix_stage(stages):
    before = dict(zip(stages[3].doc_id, stages[3].text, strict=True))
    cut = sum(before[i] != t for i, t in zip(stages[4].doc_id, stages[4].text, strict=True))
    assert all(before[i].startswith(t) for i, t in zip(stages[4].doc_id, stages[4].text, strict=True))
    assert cut <= stages[3].source.nunique() and stages[4].groupby("doc_id").size().max() <= 2
    words = lambda d: sum(len(t.split()) for t in d.text)
    assert abs(words(stages[4]) - 1.5 * words(stages[3])) <= stages[3].source.nunique()


def test_pack_stage(stages):
    ends = stages[5].assign(end=stages[5].start + stages[5].length)
    assert (stages[5].groupby("sequence_id").length.sum() <= 2048).all()
    assert stages[5].length.sum() == ends[ends.end == ends.doc_tokens].doc_tokens.sum()


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert got.length.sum() == stages[5].length.sum() and set(key) <= set(got.columns)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randint(0, 9999)}" for _ in range(n)) + "."


def test_stages_on_odd_rows(spark):
    """Nulls anywhere, empty and very long texts, repeated rows and ids, columns with the operators' own names, nothing."""
    text, long = words(80, 1), words(60_000, 2)
    rows = [
        (1, text, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", "s", 9), (1, "no", None, "s", 2),
        (4, long, "en", "s", len(long)), (5, words(90, 3) + " token=abcdefgh12345678", "en", None, 7), (5, words(90, 4), "en", None, 7),
        (None, words(70, 5), "de", "t", 1),
    ]
    named = [(*r, 1, "x", 2, "y", 0.5, True) for r in rows]
    docs = spark.createDataFrame(
        named, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard string, row int, comp string, p_good double, kept boolean"
    )
    stage = dict(corpus_pipeline.STAGES)
    columns = list(corpus_pipeline.COLUMNS)
    for name in list(stage)[:-1]:
        out = stage[name](spark, docs, SF_DIR)
        assert out.columns == columns and stage[name](spark, docs.limit(0), SF_DIR).collect() == []
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    kept = stage["quality_rules"](spark, docs, SF_DIR)
    assert ids(kept) == sorted([1, 3, 4, 5, 5, None], key=str)  # row by row: id 1 stays with its good text
    one = stage["jaccard_join"](spark, docs, SF_DIR)
    assert ids(one) == sorted([1, 1, 2, 4, 5, 5, None, None], key=str)
    clean = {(r["doc_id"], r["n_chars"]): r["text"] for r in stage["secret_scan"](spark, docs, SF_DIR).collect()}
    assert len(clean) == 9 and clean[4, len(long)] == long and not any(t and "abcdefgh12345678" in t for t in clean.values())
    mixed = stage["mix_sources"](spark, docs, SF_DIR).collect()
    assert {r["doc_id"] for r in mixed} <= {1, 2, 3, 4, 5, None} and all(r["text"] for r in mixed)
    packed = stage["pack_sequences"](spark, docs, SF_DIR).toPandas()
    assert packed.length.sum() == packed[packed.start + packed.length == packed.doc_tokens].doc_tokens.sum()
    assert len(packed[packed.start == 0]) == len(rows)
    assert stage["pack_sequences"](spark, docs.limit(0), SF_DIR).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert check(spark, connect(SF_DIR), name, SF_DIR, QUERIES, ORACLES) is None
