"""Box and line arithmetic as column expressions; boxes are x, y, w, h in crop pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x", "y", "w", "h"))


def iou(a, b) -> Column:
    """Intersection over union of two boxes given as (x, y, w, h); 0 when they do not overlap."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    iw = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    ih = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    inter = iw * ih
    union = aw * ah + bw * bh - inter
    return F.when((inter <= 0) | (union <= 0), F.lit(0.0)).otherwise(inter / union)


def touches(a, b, y_pad: Column | float = 0.0) -> Column:
    """Overlap of two boxes, touching edges included; the second is padded vertically."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    pad = y_pad if isinstance(y_pad, Column) else F.lit(float(y_pad))
    return (ax <= bx + bw) & (bx <= ax + aw) & (ay <= by + bh + pad) & (by - pad <= ay + ah)


def settled(df: DataFrame) -> DataFrame:
    """`df` with its columns computed once a row: a filter above would otherwise be pushed below them, and repeat the
    expressions of every column it names, and of those they are made of."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def with_geometry(lines: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """Append length, angle, midpoint and near-horizontal / near-vertical flags to x1, y1, x2, y2."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    out = lines.withColumns(
        {
            "length": F.hypot(dx, dy),
            "angle": F.degrees(F.atan2(dy, dx)),
            "mid_x": (F.col("x1") + F.col("x2")) / 2,
            "mid_y": (F.col("y1") + F.col("y2")) / 2,
        }
    )
    return out.withColumns(
        {
            "near_h": near_horizontal(F.col("angle"), tolerance),
            "near_v": F.abs(F.abs("angle") - 90) <= tolerance,
        }
    )


def near_horizontal(angle: Column, tolerance: float = 12.0) -> Column:
    a = F.abs(angle)
    return F.least(a, 180 - a) <= tolerance


def mask_rects(marks: DataFrame) -> DataFrame:
    """Rectangles that hide struck text: padded 4 px sideways and 20 px up and down, clipped to the block.

    `marks`: x, y, w, h, block_w, block_h; coordinates are whole pixels.
    """
    x, y, w, h = box()
    return marks.withColumns(
        {
            "mx0": F.greatest(F.lit(0), x.cast("bigint") - 4),
            "my0": F.greatest(F.lit(0), y.cast("bigint") - 20),
            "mx1": F.least(F.col("block_w").cast("bigint"), (x + w).cast("bigint") + 4),
            "my1": F.least(F.col("block_h").cast("bigint"), (y + h).cast("bigint") + 20),
        }
    )
