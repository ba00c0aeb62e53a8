"""Joins on position inside a block.

Every join is an equi-join on the block and a horizontal band of it, so a block that holds a large share of the rows
is spread over many tasks and only boxes in the same band are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.functions.geometry import box, iou

BAND = 256


def _renamed(df: DataFrame, on: list[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c) if c in on else F.col(c).alias(prefix + c) for c in df.columns])


def _banded(df: DataFrame, prefix: str, lo: Column, hi: Column) -> DataFrame:
    first, last = F.floor(lo / BAND), F.floor(hi / BAND)
    return df.withColumn(f"{prefix}_first", first).withColumn("_band", F.explode(F.sequence(first, last)))


def band_pairs(left: DataFrame, right: DataFrame, on: list[str], condition, y_pad: float = 0.0) -> DataFrame:
    """Pairs of boxes of one block whose vertical ranges (right padded) meet and that satisfy `condition`.

    Columns come back prefixed l_ and r_; `condition` is a column over those names. A pair that shares several bands
    is reported in the first of them only.
    """
    a = _renamed(left, on, "l_")
    b = _renamed(right, on, "r_")
    a = _banded(a, "l", F.col("l_y"), F.col("l_y") + F.col("l_h"))
    b = _banded(b, "r", F.col("r_y") - y_pad, F.col("r_y") + F.col("r_h") + y_pad)
    once = F.col("_band") == F.greatest("l_first", "r_first")
    return a.join(b, [*on, "_band"]).where(once & condition).drop("_band", "l_first", "r_first")


def iou_pairs(left: DataFrame, right: DataFrame, on: list[str], min_iou: float = 0.3, extra: Column | None = None):
    """Pairs of boxes of one block with IoU at or above `min_iou`, with the value as `iou`."""
    value = iou(box("l_"), box("r_"))
    condition = value >= min_iou
    if extra is not None:
        condition = extra & condition
    return band_pairs(left, right, on, condition).withColumn("iou", value)


def nearest_within(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, radius: float):
    """Closest right point to each left point within `radius`, ties to the lowest right id.

    Both sides carry cx, cy. Left points look into their own band and its neighbours, bands being one radius high; the
    minimum is a map-side aggregate.
    """
    keep = [c for c in right.columns if c not in on]
    a = left.select(*on, F.col(left_id).alias("l_id"), F.col("cx").alias("l_cx"), F.col("cy").alias("l_cy"))
    b = _renamed(right, on, "r_").withColumn("_band", F.floor(F.col("r_cy") / radius))
    own = F.floor(F.col("l_cy") / radius)
    a = a.withColumn("_band", F.explode(F.array(own - 1, own, own + 1)))
    d = F.hypot(F.col("l_cx") - F.col("r_cx"), F.col("l_cy") - F.col("r_cy"))
    near = a.join(b, [*on, "_band"]).withColumn("distance", d).where(F.col("distance") <= radius)
    best = near.groupBy(*on, "l_id").agg(
        F.min_by(F.struct("distance", *[f"r_{c}" for c in keep]), F.struct("distance", f"r_{right_id}")).alias("n")
    )
    return best.select(
        *on, F.col("l_id").alias(left_id), "n.distance", *[F.col(f"n.r_{c}").alias(f"near_{c}") for c in keep]
    )


def endpoint_pairs(lines: DataFrame, by: str, line_id: str, radius: float) -> DataFrame:
    """Pairs a < b of lines of one block with an endpoint of each within `radius`: by, a, b.

    Endpoints are joined on square cells one radius wide. The right side looks into its own cell and four of the eight
    around it: the other four look into it.
    """
    points = F.array(*[F.struct(F.col(f"x{i}").alias("px"), F.col(f"y{i}").alias("py")) for i in (1, 2)])
    ends = lines.select(by, F.col(line_id).alias("id"), F.explode(points).alias("p")).select(by, "id", "p.px", "p.py")
    cell = [F.floor(F.col("px") / radius), F.floor(F.col("py") / radius)]
    a = ends.select(by, F.col("id").alias("a"), F.col("px").alias("ax"), F.col("py").alias("ay"), cell[0].alias("cx"), cell[1].alias("cy"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    b = (
        ends.select(by, F.col("id").alias("b"), F.col("px").alias("bx"), F.col("py").alias("by_"), cell[0].alias("c0"), cell[1].alias("c1"))
        .withColumn("step", F.explode(steps))
        .select(
            by, "b", "bx", "by_", (F.col("c0") + F.col("step.dx")).alias("cx"), (F.col("c1") + F.col("step.dy")).alias("cy"),
            ((F.col("step.dx") == 0) & (F.col("step.dy") == 0)).alias("own"),
        )
    )
    close = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by_")) <= radius
    once = (F.col("a") < F.col("b")) | (~F.col("own") & (F.col("a") > F.col("b")))
    return a.join(b, [by, "cx", "cy"]).where(once & close).select(by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
