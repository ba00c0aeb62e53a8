"""Greedy selection among conflicting marks, and merging of broken strokes.

"Keep a mark unless it conflicts with a better kept one": overlapping marks are decided block by block, in one pass in
order of merit over the pairs that conflict. Strokes are joined block by block too, in the order of their lines. Arrow ends are decided in rounds over the conflict pairs: a line without a
better undecided rival is kept, its rivals are dropped, and the pairs left shrink from round to round. The outcome is that
of one pass in order of merit, but there no block is gathered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rubrica.functions.geometry import with_geometry
from rubrica.operators.spatial import endpoint_pairs
from rubrica.session import cut_lineage


def dropped_by_rivals(pairs: DataFrame, by: str) -> DataFrame:
    """Marks the greedy pass drops: by, id. `pairs`: by, win, lose - each conflict, the better mark first."""
    open_pairs = cut_lineage(pairs.select(by, "win", "lose"))
    dropped = None
    while not open_pairs.isEmpty():
        losers = open_pairs.select(by, F.col("lose").alias("win")).distinct()
        lost = (
            open_pairs.join(losers, [by, "win"], "left_anti").select(by, F.col("lose").alias("id")).distinct()
        )
        lost = cut_lineage(lost)
        gone = lost.select(by, F.col("id").alias("win"))
        gone_lose = lost.select(by, F.col("id").alias("lose"))
        open_pairs = cut_lineage(
            open_pairs.join(gone, [by, "win"], "left_anti").join(gone_lose, [by, "lose"], "left_anti")
        )
        # pairs won by a mark that is now kept are settled: their losers were dropped above
        dropped = lost if dropped is None else dropped.unionByName(lost)
    return dropped if dropped is not None else pairs.select(by, F.col("lose").alias("id"))


def _conflicts(block, y, h, box, iou: float):
    """Pairs of rows of one block, sorted by block and top edge, whose boxes overlap by `iou` or more."""
    x, w = box
    foot, area = y + h, w * h
    upper, step, found = np.arange(len(y)), 0, []
    while len(upper):
        step += 1
        upper = upper[upper + step < len(y)]
        lower = upper + step
        # tops ascend within a block, so a box that starts below this one's foot ends its search
        on = (block[lower] == block[upper]) & (y[lower] < foot[upper])
        upper, lower = upper[on], lower[on]
        iw = np.minimum(x[upper] + w[upper], x[lower] + w[lower]) - np.maximum(x[upper], x[lower])
        ih = np.minimum(foot[upper], foot[lower]) - y[lower]
        inter = np.maximum(iw, 0.0) * np.maximum(ih, 0.0)
        union = area[upper] + area[lower] - inter
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = (inter > 0) & (union > 0) & (inter / union >= iou)
        found.append((upper[hit], lower[hit]))
    return tuple(np.concatenate([np.zeros(0, int), *side]) for side in (zip(*found, strict=True) if found else ((), ())))


def kept_by_merit(ids, confidence, x, y, w, h, iou: float) -> list:
    """Which marks of each block stay: lists of six columns per block to lists of booleans.

    A mark without a whole box or confidence conflicts with none. All blocks are swept at once, and only the pairs that
    conflict are gone through, in the order of the worse mark's merit: what beats it is decided by then.
    """
    sizes = [len(v) for v in ids]
    block = np.repeat(np.arange(len(sizes)), sizes)
    ids = np.concatenate([np.asarray(v) for v in ids]) if sizes else np.zeros(0)
    if ids.dtype == object:
        ids = np.unique(ids, return_inverse=True)[1]
    confidence, x, y, w, h = (
        np.concatenate([np.asarray(v, float) for v in c]) if sizes else np.zeros(0) for c in (confidence, x, y, w, h)
    )
    whole = np.flatnonzero(~np.isnan(confidence + x + y + w + h))
    rows = whole[np.lexsort((y[whole], block[whole]))]
    one, two = (rows[side] for side in _conflicts(block[rows], y[rows], h[rows], (x[rows], w[rows]), iou))
    merit = np.empty(len(ids), int)
    merit[np.lexsort((ids, -confidence, block))] = np.arange(len(ids))
    tied = (confidence[one] == confidence[two]) & (ids[one] == ids[two])
    first = merit[one] < merit[two]
    win, lose = np.where(first, one, two)[~tied], np.where(first, two, one)[~tied]
    order = np.argsort(merit[lose], kind="stable")
    kept = [True] * len(ids)
    for better, worse in zip(win[order].tolist(), lose[order].tolist(), strict=True):
        if kept[better]:
            kept[worse] = False
    ends = np.cumsum([0, *sizes])
    return [kept[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _kept_lists(
    ids: pd.Series, confidence: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, iou: pd.Series
) -> pd.Series:
    return pd.Series(kept_by_merit(ids, confidence, x, y, w, h, iou.iloc[0] if len(iou) else 0.0))


def nms(marks: DataFrame, by: str = "block_id", mark_id: str = "mark_id", iou: float = 0.3) -> DataFrame:
    """Non-maximum suppression: by confidence, keep a mark unless it overlaps a kept one by `iou` or more.

    Marks meet in one row per block, which is one crop of one page; they are shuffled once and never joined. Marks without
    a block are kept.
    """
    rows = F.collect_list(F.struct(*[F.col(c) for c in marks.columns if c != by])).alias("_m")
    blocks = marks.repartition(by).groupBy(by).agg(rows)
    sides = [F.col(f"_m.{mark_id}"), *[F.col(f"_m.{c}").cast("array<double>") for c in ("confidence", "x", "y", "w", "h")]]
    judged = blocks.withColumn("_keep", _kept_lists(*sides, F.lit(float(iou))))
    kept = F.filter("_m", lambda m, i: F.get("_keep", i) | F.col(by).isNull())
    return judged.select(by, F.inline(kept)).select(*marks.columns)


def suppress_endpoints(arrows: DataFrame, by: str = "block_id", line_id: str = "line_no", radius: float = 45.0):
    """Longest first, keep an arrow unless one of its ends lies within `radius` of an end of a kept one."""
    sized = with_geometry(arrows).select(by, F.col(line_id).alias("id"), F.round("length", 6).alias("length"))
    near = endpoint_pairs(arrows, by, line_id, radius)
    joined = near.join(sized.select(by, F.col("id").alias("a"), F.col("length").alias("la")), [by, "a"]).join(
        sized.select(by, F.col("id").alias("b"), F.col("length").alias("lb")), [by, "b"]
    )
    first = F.col("la") >= F.col("lb")
    pairs = joined.select(
        by,
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("win"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("lose"),
    )
    lost = dropped_by_rivals(pairs, by).withColumnRenamed("id", line_id)
    return arrows.join(lost, [by, line_id], "left_anti")


def _packed(cells):
    """Cell numbers with the empty stretches between them shortened to one cell; neighbours stay neighbours."""
    known, place = np.unique(cells, return_inverse=True)
    return np.cumsum(np.minimum(np.diff(known, prepend=known[:1]), 2))[place]


def _near_ends(block, x, y, gap: float):
    """Pairs of points of one block within `gap`, each once. Points meet in square cells at least `gap` wide."""
    none = np.zeros(0, int)
    if not len(x):
        return none, none
    side = gap * 1.000001 if gap > 0 else 1.0
    cx, cy = (_packed(np.floor(np.clip(c / side, -(2.0**40), 2.0**40))).astype(int) + 1 for c in (x, y))
    wide, high = cx.max() + 2, cy.max() + 2
    key = (block * wide + cx) * high + cy
    order = np.argsort(key, kind="stable")
    key, x, y = key[order], x[order], y[order]
    found = []
    # its own cell and four of the eight around it: the other four look into it
    for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)):
        target = key + dx * high + dy
        lo, hi = np.searchsorted(key, target, "left"), np.searchsorted(key, target, "right")
        if (dx, dy) == (0, 0):
            lo = np.arange(1, len(key) + 1)
        n = hi - lo
        one = np.repeat(np.arange(len(key)), n)
        two = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        square, limit = (x[one] - x[two]) ** 2 + (y[one] - y[two]) ** 2, gap * gap
        close = square <= limit
        for i in np.flatnonzero(np.abs(square - limit) <= 1e-9 * limit).tolist():
            close[i] = math.dist((x[one[i]], y[one[i]]), (x[two[i]], y[two[i]])) <= gap
        found.append((order[one[close]], order[two[close]]))
    return tuple(np.concatenate(s) for s in zip(*found, strict=True))


def _heading(x1: float, y1: float, x2: float, y2: float) -> float:
    return math.degrees(math.atan2(y2 - y1, x2 - x1))


def join_strokes(block, x1, y1, x2, y2, angle: float, gap: float) -> tuple[list, list, list]:
    """Join fragments, sorted by block and line: the first line of each stroke, its four coordinates, its number of parts.

    Strokes start at the first line left. Each walks round the lines of its block that are not yet used, taking what
    continues it, and is finished after a full lap without a join. A stroke ends where fragments end, so what can continue
    it is found among the ends near those ends, looked up before the walk.
    """
    n = len(x1)
    px, py = np.column_stack([x1, x2]).ravel(), np.column_stack([y1, y2]).ravel()  # ends 2i and 2i + 1 are those of line i
    one, two = _near_ends(np.repeat(block, 2), px, py, gap)
    other = one >> 1 != two >> 1
    here, there = np.concatenate([one[other], two[other]]), np.concatenate([two[other], one[other]])
    order = np.argsort(here, kind="stable")
    near = (there[order] >> 1).tolist()
    at = np.searchsorted(here[order], np.arange(2 * n + 1)).tolist()
    px, py = px.tolist(), py.tolist()
    headings = list(map(_heading, px[::2], py[::2], px[1::2], py[1::2]))
    used = bytearray(n)
    firsts, strokes, counts = [], [], []
    for first in range(n):
        if used[first]:
            continue
        used[first] = 1
        p, q, heading, last, parts = 2 * first, 2 * first + 1, headings[first], first, 1
        while True:
            nxt = after = None  # the first to continue it behind the line taken last, or from the start on
            for c in near[at[p] : at[p + 1]] + near[at[q] : at[q + 1]]:
                place = c if c > last else c + n
                if used[c] or (after is not None and place >= after):
                    continue
                turn = abs(heading - headings[c])
                if min(turn, 180 - turn) <= angle:
                    nxt, after = c, place
            if nxt is None:
                break
            used[nxt], last, parts = 1, nxt, parts + 1
            # the longest line between two of the four ends, the first found among equals
            ends, far = (p, q, 2 * nxt, 2 * nxt + 1), -1.0
            for i in range(3):
                for j in range(i + 1, 4):
                    a, b = ends[i], ends[j]
                    d = math.dist((px[a], py[a]), (px[b], py[b]))
                    if d > far:
                        far, p, q = d, a, b
            heading = _heading(px[p], py[p], px[q], py[q])
        firsts.append(first)
        strokes.append((px[p], py[p], px[q], py[q]))
        counts.append(parts)
    return firsts, strokes, counts


#: Lines that are joined in one go, in whole blocks: it bounds the pairs of near ends held at a time.
LINES_AT_ONCE = 50_000
_ENDS = ["x1", "y1", "x2", "y2"]


def _joined(by: str, angle: float, gap: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of blocks, their lines in lists, to rows of strokes. Lines without a block, a number or a whole place stay alone."""

    def batch_of(blocks: pa.RecordBatch) -> pa.RecordBatch:
        flat = {c: blocks.column(c).flatten() for c in ("line_no", *_ENDS)}
        block = np.repeat(np.arange(blocks.num_rows), [len(v) for v in blocks.column("line_no")])
        named, numbered = (np.asarray(c.is_valid().to_numpy(zero_copy_only=False), bool) for c in (blocks.column(by), flat["line_no"]))
        no = flat["line_no"].fill_null(0).to_numpy(zero_copy_only=False)
        ends = [flat[c].to_numpy(zero_copy_only=False).astype(float) for c in _ENDS]
        whole = named[block] & numbered & np.isfinite(np.sum(ends, axis=0))
        rows = np.flatnonzero(whole)
        rows = rows[np.lexsort((*[e[rows] for e in reversed(ends)], no[rows], block[rows]))]
        firsts, strokes, counts = join_strokes(block[rows], *[e[rows] for e in ends], angle, gap)
        first, alone = rows[firsts], np.flatnonzero(~whole)
        strokes = np.array(strokes, float).reshape(-1, 4)
        taken = np.concatenate([first, alone]).astype(int)
        out = [blocks.column(by).take(pa.array(block[taken])), flat["line_no"].take(pa.array(taken))]
        out += [pa.concat_arrays([pa.array(strokes[:, i]), flat[c].take(pa.array(alone))]) for i, c in enumerate(_ENDS)]
        out.append(pa.array([*counts, *[1] * len(alone)], pa.int64()))
        return pa.RecordBatch.from_arrays(out, names=[by, "line_no", *_ENDS, "parts"])

    def run(batches):
        for batch in batches:
            start, held = 0, 0
            for i, lines in enumerate(batch.column("line_no")):
                held += len(lines)
                if held >= LINES_AT_ONCE or i + 1 == batch.num_rows:
                    yield batch_of(batch.slice(start, i + 1 - start))
                    start, held = i + 1, 0

    return run


def merge_collinear(lines: DataFrame, by: str = "block_id", angle: float = 8.0, gap: float = 20.0) -> DataFrame:
    """Join fragments of one stroke: by, line_no (of the first fragment), x1, y1, x2, y2, parts.

    The joining depends on order, so the lines of a block meet in one row, which is one crop of one page; they are shuffled
    once and never joined. Lines without a block are strokes already, as are those without a number or a whole place.
    """
    base = lines.select(by, F.col("line_no").cast("bigint").alias("line_no"), *[F.col(c).cast("double").alias(c) for c in _ENDS])
    own = F.when(F.col(by).isNull(), F.col("line_no"))  # so that lines without a block are not gathered
    base = base.withColumn("_own", own).repartition(by, "_own")
    lists = base.groupBy(by, "_own").agg(F.collect_list(F.struct("line_no", *_ENDS)).alias("l"))
    kind = lines.schema[by].dataType.simpleString()
    schema = f"`{by}` {kind}, line_no bigint, {', '.join(f'{c} double' for c in _ENDS)}, parts bigint"
    return lists.select(by, *[F.col(f"l.{c}").alias(c) for c in ("line_no", *_ENDS)]).mapInArrow(_joined(by, angle, gap), schema)
