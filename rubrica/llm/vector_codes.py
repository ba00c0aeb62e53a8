"""Vector compression to codes of codebook entries, in exact integers with a Walsh-Hadamard filter.

Components become integers, floor(scale * x). A vector is cut into equal consecutive parts, and each part position has a
codebook of `entries` entries, trained by assigning every part of every vector to its nearest entry and moving entries to
the floored mean. The nearest entry is found on transformed parts: parts and entries are padded with zeros to a power of
two L and go through the integer Walsh-Hadamard transform with rows in sequency order (by sign changes). The transform H
has H'H = L * I, so that the squared differences of all L coefficients add up to L times the squared distance, with nothing
rounded. They are added in sequency order, where the first few hold most of the sum; an entry is eliminated as soon as what
it has gathered is above the whole sum of the entry that looked best after the first coefficients. Ties go to the lower index.

Work per round is one pass of the table, a task at a time; a task returns sums per entry, which Spark adds up, and the
driver holds the codebooks alone (parts x entries x part length numbers). Nothing is shuffled by vector. The label totals of
the digest are partial aggregates joined back to the rows, in a broadcast if few labels are counted and else in a join that
AQE splits.

Left out: null or empty vectors, those with null or non-finite components or integers of 2^62 and above, those whose length
is no multiple of the number of parts or is not the commonest such length (of equally common ones the longer). Null ids are
rows like others and come last when the first codebooks are taken; repeated ids are rows of their own, ordered by their
vectors. With fewer rows than entries the codebooks are shorter. Null labels are one label. An error that does not fit a long
is null, and so is a sum with it or beyond. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rubrica.llm.common import pick
from rubrica.llm.int_vectors import LARGEST, SUMS, Sums, components, exact, long_or_null, moved, whole
from rubrica.session import cut_lineage

SAFE = 1 << 26  # L * L * 4 * SAFE^2 stays below 2^62 for parts of eight components
LABELS_BROADCAST = 1_000_000  # label totals, two numbers each, that a broadcast may hold


def hadamard(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard coefficients of the last axis, padded to a power of two, by rising sequency."""
    n = x.shape[-1]
    size = 1 << (n - 1).bit_length()
    y = np.zeros((*x.shape[:-1], size), dtype=x.dtype)
    y[..., :n] = x
    h = 1
    while h < size:
        pairs = y.reshape(*y.shape[:-1], size // (2 * h), 2, h)
        y = np.concatenate([pairs[..., :1, :] + pairs[..., 1:, :], pairs[..., :1, :] - pairs[..., 1:, :]], axis=-2).reshape(y.shape)
        h *= 2
    return y[..., sequency(size)]


def sequency(size: int) -> np.ndarray:
    """Natural indexes of the transform's rows by their number of sign changes: bit-reversed Gray codes."""
    bits = size.bit_length() - 1
    gray = [s ^ (s >> 1) for s in range(size)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray], dtype=np.int64)


def nearest(x: np.ndarray, entries: np.ndarray, first: int = 2) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, L times its squared distance, squares added) per row, from coefficients of rows and of entries."""
    n, size = x.shape
    first = min(first, size)
    got = ((x[:, None, :first] - entries[None, :, :first]) ** 2).sum(axis=2)
    every = np.arange(n)
    guess = got.argmin(axis=1)
    best = got[every, guess] + ((x[:, first:] - entries[guess, first:]) ** 2).sum(axis=1)
    row, entry = np.nonzero((got <= best[:, None]).astype(bool))
    got, work, at = got[row, entry], n * len(entries) * first, first
    while at < size:
        to = min(size, 2 * at)
        got = got + ((x[row, at:to] - entries[entry, at:to]) ** 2).sum(axis=1)
        work += len(row) * (to - at)
        alive = (got <= best[row]).astype(bool)
        row, entry, got, at = row[alive], entry[alive], got[alive], to
    # rows stay ascending and entries within a row too: the first least one is the answer
    starts = np.searchsorted(row, every)
    least = np.minimum.reduceat(got, starts) if n else got
    hit = np.flatnonzero((got == least[row]).astype(bool))
    hit = hit[np.searchsorted(row[hit], every)]
    return entry[hit], least, work


class Codebooks:
    """Codebooks (parts x entries x part length) and the assignment of vectors to them."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.parts, self.entries, self.width = books.shape
        self.size = 1 << (self.width - 1).bit_length()

    def assign(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes: rows x parts, squared distances: rows x parts) of whole vectors."""
        most = SAFE * 8 // max(8, self.size)
        m, books = exact(m, most), exact(self.books, most)
        if m.dtype != books.dtype:
            m, books = m.astype(object), books.astype(object)
        codes = np.zeros((len(m), self.parts), dtype=np.int64)
        far = np.zeros((len(m), self.parts), dtype=m.dtype)
        if len(m):
            x, e = hadamard(m.reshape(len(m), self.parts, self.width)), hadamard(books)
            for p in range(self.parts):
                codes[:, p], scaled, _ = nearest(x[:, p], e[p])
                far[:, p] = scaled // self.size
        return codes, far

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for c in self.books.reshape(-1)).encode()).hexdigest()


def _plain(vectors: DataFrame, label: str | None = None) -> DataFrame:
    """(vec_id, label, e): what the passes read."""
    d = pick(vectors, vec_id="vec_id", e="embedding", **({"label": label} if label else {}))
    kind = d.schema["e"].dataType.simpleString()
    return d.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label") if label else F.lit(None).cast("long").alias("label"),
        components(F.col("e"), kind).alias("e"),
    )


def first_rows(d: DataFrame, scale: int, parts: int, k: int) -> tuple[int, np.ndarray]:
    """(commonest length, its k rows with the smallest ids); 0 and none without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        low: dict[int, list] = {}
        for batch in batches:
            ids = np.array([LARGEST * 2 if i is None else i for i in batch.column(0).to_pylist()], dtype=object)
            for at, m in whole(batch.column(1), scale):
                n = m.shape[1]
                if n % parts or not len(at):
                    continue
                count[n] = count.get(n, 0) + len(at)
                mine = sorted(zip(ids[at].tolist(), m.tolist(), strict=True))[:k]
                low[n] = sorted(low.get(n, []) + mine)[:k]
        for n, found in low.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n] * len(found), pa.int64()),
                    pa.array([count[n]] + [0] * (len(found) - 1), pa.int64()),
                    pa.array([None if i == LARGEST * 2 else i for i, _ in found], pa.int64()),
                    pa.array([v for _, v in found], pa.list_(pa.int64())),
                ],
                names=["length", "n", "vec_id", "v"],
            )

    low = cut_lineage(d.select("vec_id", "e").mapInArrow(run, "length bigint, n bigint, vec_id bigint, v array<bigint>"))
    top = low.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not top:
        return 0, np.zeros((0, 0), dtype=np.int64)
    rows = low.filter(F.col("length") == top[0]["length"]).orderBy(F.asc_nulls_last("vec_id"), "v").limit(k).collect()
    return top[0]["length"], np.array([r["v"] for r in rows], dtype=np.int64)


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks after `rounds` rounds over all rows; None without rows. At most 256 entries."""
    d = _plain(vectors)
    length, seeds = first_rows(d, scale, parts, entries)
    if not length:
        return None
    width = length // parts
    books = Codebooks(seeds.reshape(len(seeds), parts, width).swapaxes(0, 1))
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], now: Codebooks = books) -> Iterator[pa.RecordBatch]:
            sums = [Sums(now.entries, width) for _ in range(parts)]
            for batch in batches:
                for _, m in whole(batch.column(0), scale, length):
                    codes, _ = now.assign(m)
                    for p in range(parts):
                        sums[p].add(codes[:, p], m[:, p * width : (p + 1) * width])
            for p in range(parts):
                yield sums[p].rows(p * now.entries)

        centres = books.books.reshape(-1, width)
        books = Codebooks(moved(centres, d.select("e").mapInArrow(run, SUMS)).reshape(parts, books.entries, width))
    return books


def encode(vectors: DataFrame, books: Codebooks, scale: int = 4096, label: str | None = "label") -> DataFrame:
    """(vec_id, label, code, error) of every vector of the codebooks' length: two hexadecimal digits a part, and the squared
    distances summed over parts."""
    d = _plain(vectors, label)
    length = books.parts * books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in whole(batch.column(2), scale, length):
                codes, far = books.assign(m)
                hexed = codes.astype(np.uint8).tobytes().hex()
                step, take = 2 * books.parts, pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take),
                        pa.array([hexed[i : i + step] for i in range(0, len(hexed), step)], pa.string()),
                        long_or_null(far.sum(axis=1)),
                    ],
                    names=["vec_id", "label", "code", "error"],
                )

    return d.mapInArrow(run, f"vec_id bigint, label {d.schema['label'].dataType.simpleString()}, code string, error bigint")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, v): the integers that each code stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hexed = bytes.fromhex("".join(batch.column(1).to_pylist()))
            entry = np.frombuffer(hexed, dtype=np.uint8).reshape(batch.num_rows, books.parts)
            v = books.books[np.arange(books.parts), entry].reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v.tolist(), pa.list_(pa.int64()))], names=["vec_id", "v"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id bigint, v array<bigint>")


def code_digest(vectors: DataFrame, **settings) -> DataFrame:
    """One row per vector that takes part: vec_id, code, error, label_error, codebooks_sha256."""
    books = fit(vectors, **settings)
    if books is None:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
        )
    coded = cut_lineage(encode(vectors, books, settings.get("scale", 4096)))
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint"))
    totals = cut_lineage(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")))
    few = totals.limit(LABELS_BROADCAST + 1).count() <= LABELS_BROADCAST
    both = coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _digest_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same by full distances, a common table per round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, part, entry, d FROM (
    SELECT c.r, c.part, b.entry, sum((c.x - b.y) * (c.x - b.y))::BIGINT AS d FROM c JOIN b{k} b USING (part, place) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN (
    SELECT part, entry, place, ((s - ((s % n) + n) % n) // n)::BIGINT AS y FROM (
      SELECT c.part, a.entry, c.place, sum(c.x)::HUGEINT AS s, count(*) AS n FROM a{k} a JOIN c USING (r, part) GROUP BY ALL)
  ) m USING (part, entry, place))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (SELECT len(embedding) AS n FROM v GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1),
k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r) AS r, vec_id, label, embedding, n // {parts} AS width FROM v, l WHERE len(embedding) = n),
c AS MATERIALIZED (
  SELECT r, (j - 1) // width AS part, (j - 1) % width AS place, floor({scale} * embedding[j]::DOUBLE)::BIGINT AS x
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS j FROM k)
), b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, place, x AS y FROM c WHERE r <= {entries}),
{(","+chr(10)).join(steps)},
e AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r
), h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, place)) AS s FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.s AS codebooks_sha256
FROM k JOIN e USING (r), h
"""


DIGEST_SQL = _digest_sql()
