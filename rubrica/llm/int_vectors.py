"""Vectors as exact integers, floor(scale * component): reading them from Arrow batches, and sums of them by cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Integers from here on do not fit what is stored and returned; a vector that holds one is left out like a non-finite one.
LARGEST = 1 << 62


def components(column: Column, kind: str) -> Column:
    """The vector column as a list of floats or doubles."""
    return column if kind in ("array<float>", "array<double>") else column.cast("array<double>")


def whole(column: pa.Array, scale: int, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the column, matrix of integers) of the vectors that take part, apart by length; of one `length` if given."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes) if length is None else [length]:
        if n == 0:
            continue
        at = np.flatnonzero(sizes == n)
        if not len(at):
            continue
        m = flat.reshape(-1, n) if len(at) * n == len(flat) else flat[starts[at][:, None] + np.arange(n)]
        with np.errstate(over="ignore", invalid="ignore"):
            m = np.floor(m * scale)
        good = (np.abs(m) < LARGEST).all(axis=1)  # false for NaN too
        yield at[good], m[good].astype(np.int64)


def exact(m: np.ndarray, most: int) -> np.ndarray:
    """The integers as they are while they are below `most`, else as Python integers, which do not overflow."""
    return m if m.dtype == object or not m.size or int(np.abs(m).max()) < most else m.astype(object)


class Sums:
    """Exact sums and counts of rows by cell, over all batches of a task."""

    def __init__(self, cells: int, length: int):
        self.total = np.zeros((cells, length), dtype=object)
        self.n = np.zeros(cells, dtype=np.int64)

    def add(self, cell: np.ndarray, m: np.ndarray) -> None:
        if not len(cell):
            return
        one = np.arange(len(self.n))[:, None] == cell[None, :]
        if int(np.abs(m).max(initial=0)) * len(cell) < 1 << 53:  # sums of integers that doubles hold exactly
            self.total += (one.astype(np.float64) @ m.astype(np.float64)).astype(np.int64)
        else:
            self.total += one.astype(object) @ m.astype(object)
        self.n += one.sum(axis=1)

    def rows(self, first: int = 0) -> pa.RecordBatch:
        """(cell, place, total, n) of the cells that have rows; cells are numbered from `first`."""
        cell, place = np.nonzero(np.repeat(self.n[:, None] > 0, self.total.shape[1], axis=1))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(cell + first, pa.int64()), pa.array(place, pa.int64()),
                pa.array([str(t) for t in self.total[cell, place]], pa.string()).cast(pa.decimal128(38, 0)),
                pa.array(self.n[cell], pa.int64()),
            ],
            names=["cell", "place", "total", "n"],
        )


SUMS = "cell bigint, place bigint, total decimal(38,0), n bigint"


def moved(centres: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Centres (cells x length) after a round: floor(total / n), or as they were where no row fell.

    Only cells x length rows, a number that does not depend on the data, reach the driver.
    """
    new = centres.copy()
    for r in sums.groupBy("cell", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        new[r["cell"], r["place"]] = int(r["total"]) // r["n"]
    return new


def long_or_null(values: np.ndarray) -> pa.Array:
    """As longs, null where a value does not fit."""
    if values.dtype != object:
        return pa.array(values.astype(np.int64))
    return pa.array([int(v) if abs(int(v)) < 1 << 63 else None for v in values], pa.int64())
