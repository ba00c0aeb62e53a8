"""Vector arithmetic over array columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine_of(dot_col: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from parts, so that a join can carry each side's norm instead of recomputing it per pair."""
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(dot_col / (norm_a * norm_b))


def cosine(a, b) -> Column:
    """Cosine similarity, 0 for a zero vector; vectors of unequal length raise."""
    same = F.size(_c(a)) == F.size(_c(b))
    value = cosine_of(dot(a, b), norm(a), norm(b))
    return F.when(same, value).otherwise(F.raise_error(F.lit("vectors of unequal length")).cast("double"))


NUMBERS_HELD = 1 << 18  # numbers of vectors that a worker makes at once


def hash_vectors(texts: list, dim: int) -> pa.Array:
    """Unit vectors of texts, each number 16 bits of a digest; a null text's are nulls. Sums go in order, as in `norm`."""
    rounds = range(math.ceil(dim / 16))
    raw = b"".join(sha256(f"{t}#{r}".encode("utf-8", "surrogatepass")).digest() for t in texts if t is not None for r in rounds)
    v = np.frombuffer(raw, dtype=">u2").reshape(-1, 16 * len(rounds))[:, :dim] / 32767.5 - 1
    if dim:
        size = np.sqrt(np.cumsum(v * v, axis=1)[:, -1:])
        v = v / np.where(size == 0, 1.0, size)
    known = np.array([t is not None for t in texts], dtype=bool)
    flat = np.zeros((len(texts), dim))
    flat[known] = v
    numbers = pa.array(flat.ravel(), mask=np.repeat(~known, dim))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), numbers)


def hash_embed(df: DataFrame, text_col: str, dim: int = 2048, out: str = "embedding") -> DataFrame:
    """Append a unit vector derived from the text alone: equal texts, trimmed and lower-cased, get equal vectors.

    One Arrow call per batch; long vectors leave it in batches of few rows.
    """
    from rubrica.functions.text import strip

    rows = max(1, NUMBERS_HELD // max(dim, 1))
    names = [*[c for c in df.columns if c != out], out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                vectors = hash_vectors(part.column(part.num_columns - 1).to_pylist(), dim)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], vectors], names=names)

    kept = df.select(*[F.col(f"`{c}`") for c in names[:-1]], F.lower(strip(text_col)).alias("_hashed"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField(out, T.ArrayType(T.DoubleType()))])
    return kept.mapInArrow(run, schema)


def check_embeddings(texts: DataFrame, vectors: DataFrame, key: str, dim: int, col: str = "embedding"):
    """(good, rejects): one vector per key, each of `dim` numbers; missing and misshapen vectors are rejected."""
    found = texts.select(key).join(vectors.select(key, col), key, "left")
    reason = F.when(F.col(col).isNull(), F.lit("missing vector")).when(
        F.size(col) != dim, F.concat(F.lit("vector has "), F.size(col).cast("string"), F.lit(f" values, expected {dim}"))
    )
    checked = found.withColumn("reason", reason)
    return (
        checked.where("reason IS NULL").drop("reason"),
        checked.where("reason IS NOT NULL").select(key, "reason"),
    )


def fit_length(col, dim: int) -> Column:
    """Cut or zero-pad a vector to `dim` values."""
    v = _c(col)
    pad = F.array_repeat(F.lit(0.0), dim)
    return F.slice(F.concat(v.cast("array<double>"), pad), 1, dim)
