"""Centroid clustering in exact integers, with distances filtered in a PCA-rotated space.

Components become integers, floor(scale * x). Once, the covariance of all vectors is added up in Spark, its leading
eigenvectors are found on the driver (a length x length matrix), and a table is stored: each vector's integers, its leading
rotated coordinates, and the norm of what the rotation leaves over. A rotation keeps distances, and the parts left over are
at least as far apart as their norms differ, so

    |x - c|^2  >=  |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2.

Per vector the centroid with the least bound is measured in integers first; of the others only those whose bound, less a
margin above any rounding, is not above that distance are measured in integers too. So the assignment is exact, ties going
to the smaller number, and the rotation decides only how many centroids are measured.

Each round reads the stored table, a task at a time; tasks return sums per centroid, Spark adds them up, and the driver holds
the centroids alone. Nothing is shuffled by vector, and a lost task is run again from the stored table.

Left out: null vectors, those of another length than `length`, those with null or non-finite components or integers of 2^62
and above. The first centroids are the vectors with the smallest SHA-256 of `<seed>:<vec_id>`; null ids come last, equal ids
in order of their stored bytes; with fewer vectors there are fewer centroids. Empty centroids stay where they are. Repeated rows
count each. A distance that does not fit a long is null, and so is a sum with it or beyond. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rubrica.llm.common import pick
from rubrica.llm.int_vectors import SUMS, Sums, components, exact, long_or_null, moved, whole
from rubrica.session import cut_lineage, shared_dir

SAFE = 1 << 27  # 64 * (2 * SAFE)^2 is 2^62
DIGEST = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


class Rotation:
    """Mean and leading principal axes (length x leading)."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray):
        self.mean, self.axes = mean, axes

    def of(self, m: np.ndarray) -> np.ndarray:
        """Rows of the leading coordinates and, last, the norm of the rest."""
        x = m.astype(np.float64) - self.mean
        lead = x @ self.axes
        rest = np.sqrt(np.maximum((x**2).sum(axis=1) - (lead**2).sum(axis=1), 0))
        return np.concatenate([lead, rest[:, None]], axis=1)


def rotation(d: DataFrame, length: int, scale: int, leading: int) -> Rotation | None:
    """Principal axes of all vectors; None without vectors. Products add up per task and then over tasks."""
    side = length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side))
        for batch in batches:
            for _, m in whole(batch.column(1), scale, length):
                x = np.concatenate([np.ones((len(m), 1)), m], axis=1)
                total += x.T @ x
        cell = np.flatnonzero(np.triu(np.ones((side, side))))
        if total[0, 0]:
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.reshape(-1)[cell])], names=["cell", "total"])

    found = d.mapInArrow(run, "cell bigint, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    if not found:
        return None
    m = np.zeros(side * side)
    m[[r["cell"] for r in found]] = [r["total"] for r in found]
    m = np.triu(m.reshape(side, side))
    m = m + np.triu(m, 1).T
    mean = m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
    if not np.isfinite(cov).all():  # of huge components; any axes do
        return Rotation(np.zeros(length), np.eye(length)[:, :leading])
    _, axes = np.linalg.eigh(cov)
    return Rotation(mean, axes[:, ::-1][:, :leading])


def _packed(m: np.ndarray) -> list[bytes]:
    """Each row's integers as little-endian bytes, four a number where they fit."""
    kind = "<i4" if int(np.abs(m).max(initial=0)) < 1 << 31 else "<i8"
    return [r.tobytes() for r in m.astype(kind)]


def _unpacked(rows: list[bytes], length: int) -> np.ndarray:
    if all(len(r) == 4 * length for r in rows):
        return np.frombuffer(b"".join(rows), dtype="<i4").reshape(-1, length).astype(np.int64)
    return np.stack([np.frombuffer(r, dtype="<i4" if len(r) == 4 * length else "<i8").astype(np.int64) for r in rows])


def stored(d: DataFrame, turn: Rotation, length: int, scale: int) -> DataFrame:
    """(vec_id, v, rotated): integers and rotated coordinates as bytes, in a table of the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in whole(batch.column(1), scale, length):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(_packed(m), pa.binary()), pa.array([r.tobytes() for r in turn.of(m)], pa.binary())],
                    names=["vec_id", "v", "rotated"],
                )

    folder = shared_dir(d.sparkSession, "centroids")
    d.mapInArrow(run, "vec_id bigint, v binary, rotated binary").write.parquet(folder)
    return d.sparkSession.read.parquet(folder)


class Centroids:
    """Centroids (k x length) and the assignment of vectors to them."""

    def __init__(self, centres: np.ndarray, turn: Rotation):
        self.centres, self.turn = centres, turn
        self.rotated = turn.of(centres)

    def assign(self, m: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, distances measured in integers) of each vector."""
        m, centres = exact(m, SAFE), exact(self.centres, SAFE)
        if m.dtype != centres.dtype:
            m, centres = m.astype(object), centres.astype(object)
        if not len(m):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        bound = ((rotated[:, None, :] - self.rotated[None, :, :]) ** 2).sum(axis=2)
        norms = (rotated**2).sum(axis=1)[:, None] + (self.rotated**2).sum(axis=1)[None, :]
        bound -= 1e-9 * norms + 1  # rounding is below 1e-12 of the norms
        every = np.arange(len(m))
        cluster = bound.argmin(axis=1)
        far = ((m - centres[cluster]) ** 2).sum(axis=1)
        left = bound <= far[:, None].astype(np.float64) * (1 + 1e-12)
        left[every, cluster] = False
        row, other = np.nonzero(left)
        measured = ((m[row] - centres[other]) ** 2).sum(axis=1)
        for c in range(len(centres)):  # rising numbers: equal distances keep the smaller one
            mine = other == c
            r, x = row[mine], measured[mine]
            better = (x < far[r]) | ((x == far[r]) & (c < cluster[r]))
            better = better.astype(bool)
            cluster[r[better]], far[r[better]] = c, x[better]
        return cluster, far, len(m) + len(row)

    def sha256(self) -> list[str]:
        return [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in self.centres]


def _batch(batch: pa.RecordBatch, v: int, rotated: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    turned = np.frombuffer(b"".join(batch.column(rotated).to_pylist()), dtype=np.float64)
    return _unpacked(batch.column(v).to_pylist(), length), turned.reshape(batch.num_rows, -1)


def fit(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, length: int = 64, leading: int = 8, seed: str = "3") -> tuple[DataFrame, Centroids] | None:
    """(stored table, final centroids); None without vectors."""
    d = pick(vectors, vec_id="vec_id", e="embedding")
    d = d.select(F.col("vec_id").cast("long").alias("vec_id"), components(F.col("e"), d.schema["e"].dataType.simpleString()).alias("e"))
    turn = rotation(d, length, scale, leading)
    if turn is None:
        return None
    table = stored(d, turn, length, scale)
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    low = table.select(lot.alias("lot"), "v").orderBy(F.asc_nulls_last("lot"), F.hex("v")).limit(k).collect()
    now = Centroids(_unpacked([bytes(r["v"]) for r in low], length), turn)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], now: Centroids = now) -> Iterator[pa.RecordBatch]:
            sums = Sums(len(now.centres), length)
            for batch in batches:
                if batch.num_rows:
                    m, turned = _batch(batch, 0, 1, length)
                    sums.add(now.assign(m, turned)[0], m)
            yield sums.rows()

        now = Centroids(moved(now.centres, table.select("v", "rotated").mapInArrow(run, SUMS)), turn)
    return table, now


def assigned(table: DataFrame, now: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) of a stored table."""
    length = now.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, far, _ = now.assign(*_batch(batch, 1, 2, length))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cluster, pa.int32()), long_or_null(far)], names=["vec_id", "cluster", "distance"]
                )

    return table.select("vec_id", "v", "rotated").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster_digest(vectors: DataFrame, **settings) -> DataFrame:
    """One row per vector that takes part, in the columns of DIGEST."""
    spark = vectors.sparkSession
    fitted = fit(vectors, **settings)
    if fitted is None:
        return spark.createDataFrame([], DIGEST)
    table, now = fitted
    rows = cut_lineage(assigned(table, now))
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(total.alias("s")).collect()}
    fits = lambda x: int(x) if x is not None and x < 1 << 63 else None
    all_ = None if None in sums.values() else sum(sums.values())
    facts = spark.createDataFrame(
        [(c, fits(sums.get(c)), fits(all_), h) for c, h in enumerate(now.sha256())],
        "_cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )  # a row per centroid
    return rows.join(F.broadcast(facts), rows["cluster"] == F.col("_cluster")).drop("_cluster")


def _digest_sql(k: int = 8, rounds: int = 10, scale: int = 1024, length: int = 64, seed: str = "3") -> str:
    """The same by full distances, a common table per round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, entry, d FROM (SELECT c.r, b.entry, sum((c.x - b.y) * (c.x - b.y))::BIGINT AS d FROM c JOIN b{i} b USING (place) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, entry) = 1)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT b.entry, b.place, coalesce(m.y, b.y) AS y FROM b{i} b LEFT JOIN (
    SELECT entry, place, ((s - ((s % n) + n) % n) // n)::BIGINT AS y FROM (
      SELECT a.entry, c.place, sum(c.x)::HUGEINT AS s, count(*) AS n FROM a{i} a JOIN c USING (r) GROUP BY ALL)
  ) m USING (entry, place))""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, embedding) AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS MATERIALIZED (
  SELECT r, j - 1 AS place, floor({scale} * embedding[j]::DOUBLE)::BIGINT AS x FROM (SELECT *, unnest(range(1, {length + 1})) AS j FROM k)
), b0 AS MATERIALIZED (SELECT r - 1 AS entry, place, x AS y FROM c WHERE r <= {k}),
{(","+chr(10)).join(steps)},
h AS (SELECT entry, sha256(string_agg(y::VARCHAR, ',' ORDER BY place)) AS s FROM b{rounds} GROUP BY entry)
SELECT vec_id, a.entry::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.entry))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, h.s AS centroid_sha256
FROM k JOIN a{rounds} a USING (r) JOIN h ON h.entry = a.entry
"""


DIGEST_SQL = _digest_sql()
