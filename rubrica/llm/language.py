"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased whole text with runs of white space as one blank; weights are
(1 + log tf) * idf, scaled to length 1. Document frequencies are counted over every training document, one row per hash
bucket leaving a task. The classifier is fitted on the driver on at most `sample_rows` training documents (a documented
bound; each language's share is taken by hash, so rare languages are whole) with follow-the-regularised-leader and
elastic-net penalties, which leave most weights exactly zero. A quarter of the sample is set aside to find the temperature
that makes the probabilities honest. Scoring is one pass over the table, the model a closure of bounded size.

A prediction reads the text alone. Null texts and texts without a letter are `und` with score 0; so is everything when
there is nothing to learn from. With a single learned language its score is 1. Repeated rows are predicted each. Ties go to the first
language by code point. Null languages teach nothing. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rubrica.llm.common import pick

BITS = 15
_BLANKS = re.compile(r"\s+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def grams(text: str, orders: int = 3, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of a text's character n-grams, ascending, and their counts."""
    clean = f" {_BLANKS.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    counts = np.zeros(1 << bits, dtype=np.int64)
    for n in range(1, orders + 1):
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ codes[k : len(codes) - n + 1 + k]) * _ODD[k]
                h ^= h >> np.uint64(29)
            counts += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    found = np.flatnonzero(counts)
    return found, counts[found]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """`weights` has a column per language, the last row is the bias; `idf` a number per bucket."""

    langs: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[found]
        return x / (np.linalg.norm(x) or 1.0)

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(found, counts) @ self.weights[found] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not has_letter(text):
            return "und", 0.0
        z = self.logits(*grams(text)) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int, epochs: int, alpha: float, beta: float, l1: float, l2: float
) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates. Rows are (buckets, values, class); the bias is the last coordinate."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            found, values, truth = rows[i]
            at, x = np.append(found, size), np.append(values, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[truth] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size + 1))


def calibrated(logits: np.ndarray, truth: np.ndarray) -> float:
    """Temperature of the least negative log likelihood, by golden section on its logarithm."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        return float((np.logaddexp.reduce(s, axis=1) - s[np.arange(len(s)), truth]).sum())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(
    labelled: DataFrame,
    sample_rows: int = 4000,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.01,
) -> Model:
    """A model from (doc_id, text, lang). The sample is bounded by `sample_rows`, the frequencies cover every row."""
    d = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[grams(text)[0]] += 1
                rows += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(found, -1), "df": np.append(df[found], rows)})

    counted = d.select("text").mapInArrow(frequencies, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df"))
    df, rows = np.zeros(1 << BITS), 0
    for r in counted.collect():  # at most 2^BITS + 1 rows
        if r["bucket"] < 0:
            rows = r["df"]
        else:
            df[r["bucket"]] = r["df"]
    idf = np.log((1 + rows) / (1 + df)) + 1

    per_lang = d.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.lit(float(sample_rows)) / (F.col("n") * F.sum(F.lit(1)).over(Window.partitionBy()))
    lot = (F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("lot")
    drawn = d.join(per_lang.select("lang", share.alias("share")), "lang").select("*", lot).filter("lot < share")
    drawn = drawn.orderBy("lot", "doc_id").limit(sample_rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, lot_, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found, counts = grams(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([lot_]), pa.array([found.astype("<u4").tobytes()]), pa.array([counts.astype("<u4").tobytes()])],
                    names=["lang", "lot", "found", "counts"],
                )

    sample = drawn.select("lang", "lot", "text").mapInArrow(featured, "lang string, lot double, found binary, counts binary")
    sample = sorted(sample.collect(), key=lambda r: (r["lot"], r["lang"]))
    langs = sorted({r["lang"] for r in sample})
    model = Model(langs, np.zeros(((1 << BITS) + 1, max(1, len(langs)))), idf)
    if len(langs) < 2:
        return model
    cases = []
    for r in sample:
        found, counts = (np.frombuffer(r[c], dtype="<u4").astype(np.int64) for c in ("found", "counts"))
        cases.append((found, counts, langs.index(r["lang"])))
    held, taught = cases[::4], [c for i, c in enumerate(cases) if i % 4]
    rows_ = [(f, model.vector(f, c), y) for f, c, y in taught or held]
    model.weights = ftrl(rows_, len(langs), 1 << BITS, epochs, alpha, beta, l1, l2)
    model.temperature = calibrated(np.stack([model.logits(f, c) for f, c, _ in held]), np.array([y for _, _, y in held]))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, lang_pred, score of every document."""
    d = pick(docs, doc_id="doc_id", text="text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return d.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by CRC-32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def language_digest(docs: DataFrame) -> DataFrame:
    """Learns from what is not held out and predicts everything."""
    d = pick(docs, doc_id="doc_id", text="text", lang="lang")
    model = fit(d.filter(~held_out(F.col("doc_id"))))
    return predict(d, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
