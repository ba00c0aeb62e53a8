"""Chunking, labels, replies and vectors on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from rubrica.functions import replies, text, vectors
from rubrica.operators.rubric import normalise_weights

LONG = "First clause about normal forms goes here, second clause about keys is also long, tiny, and a last clause that ends the sentence."


def chunks(spark, value):
    df = spark.createDataFrame([(1, value)], "k int, text string")
    return [(r["text"], r["start"], r["end"]) for r in text.chunk_text(df, "text", ["k"]).orderBy("chunk_no").collect()]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("  \n ", []),
        ("No terminator at all", ["No terminator at all"]),
        (LONG, ["First clause about normal forms goes here,", "second clause about keys is also long, tiny,", "and a last clause that ends the sentence."]),
        ("A short, comma, sentence.", ["A short, comma, sentence."]),
        ("Wide space. Next one.", ["Wide space.", "Next one."]),
    ],
)
def test_chunks(spark, value, want):
    got = chunks(spark, value)
    assert [t for t, _, _ in got] == want
    trimmed = value.strip()
    assert all(trimmed[s:e] == t for t, s, e in got)


@pytest.mark.parametrize(
    ("value", "label", "lenient"),
    [("1a) x", "1a", None), ("Q. 2 b. x", "2b", None), ("(3) x", "3", None), ("12", None, "12"), ("no label", None, None), ("4c)", "4c", "4c")],
)
def test_labels(spark, value, label, lenient):
    df = spark.createDataFrame([(value,)], "t string")
    r = df.select(text.extract_label("t").alias("a"), text.extract_label("t", True).alias("b")).first()
    assert (r["a"], r["b"]) == (label, lenient)


@pytest.mark.parametrize(
    ("reply", "verdict"),
    [
        ('{"verdict": "COVERED"}', "COVERED"),
        ("{'verdict': 'partial'}", "PARTIAL"),
        ('```json\n{"verdict": "MISSING"}\n```', "MISSING"),
        ('Of course: {"verdict": "NOT COVERED"}.', "COVERED"),
        ('{"verdict": "MAYBE"}', "MISSING"),
        ("plain partial prose", "PARTIAL"),
        ("{broken covered", "COVERED"),
        ("nothing", "MISSING"),
    ],
)
def test_verdicts(spark, reply, verdict):
    df = spark.createDataFrame([(reply,)], "reply string")
    assert replies.extract_verdict(df).first()["verdict"] == verdict


def test_cosine(spark):
    rows = [([1.0, 0.0], [2.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 3.0], 0.0), ([1.0, 1.0], [-1.0, -1.0], -1.0), ([0.0, 0.0], [1.0, 2.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert df.where(F.abs(vectors.cosine("a", "b") - F.col("want")) > 1e-12).count() == 0
    with pytest.raises(Exception, match="unequal length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vectors.cosine("a", "b")).collect()


@pytest.mark.parametrize("dim", [16, 40, 100])
def test_hash_embedding_is_a_unit_vector_of_the_trimmed_text(spark, dim):
    df = spark.createDataFrame([(" Same text ",), ("same TEXT",), ("other",)], "t string")
    a, b, c = [r["embedding"] for r in vectors.hash_embed(df, "t", dim).collect()]
    assert a == b != c
    assert len(a) == dim
    assert abs(sum(x * x for x in a) - 1) < 1e-9


def test_weights_sum_to_one_after_cap_and_drops(spark):
    rows = [(1, i, f"c{i}" if i != 2 else " ", 1.0 if i != 4 else 0.0) for i in range(10)]
    got = normalise_weights(spark.createDataFrame(rows, "q int, ord int, text string, weight double"), "q").orderBy("ord").collect()
    assert [r["ord"] for r in got] == [0, 1, 3, 5, 6, 7]
    assert round(sum(r["weight"] for r in got), 9) == 1.0
    assert got[-1]["weight"] == 0.166665


def test_upper_case_keeps_the_length_of_a_text(spark):
    df = spark.createDataFrame([("straße, ǆ ﬁx ᾳ ŉ",), ("plain é",), (None,)], "t string")
    assert [r[0] for r in df.select(text.upper("t")).collect()] == ["STRAẞE, Ǆ ﬁX ᾼ ŉ", "PLAIN É", None]


def test_hash_vectors_are_made_in_arrow_batches(spark):
    """No expression a number: a vector of 2,048 cost as many conversions of text before. Nulls stay nulls."""
    import math
    from hashlib import sha256

    df = spark.createDataFrame([(1, " Ab "), (2, None)], "id int, t string")
    out = vectors.hash_embed(df, "t", 40)
    assert "conv(" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r["id"]: r["embedding"] for r in out.collect()}
    raw = b"".join(sha256(f"ab#{b}".encode()).digest() for b in range(3))
    want = [int.from_bytes(raw[2 * i : 2 * i + 2], "big") / 32767.5 - 1 for i in range(40)]
    total = 0.0
    for x in want:
        total += x * x
    assert got == {1: [x / math.sqrt(total) for x in want], 2: [None] * 40}
