"""Layout statistics: ink runs, gap thresholds, line pitch, text density, grids, content types, OCR routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rubrica.config import DEFAULTS, Thresholds
from rubrica.functions.geometry import near_horizontal, with_geometry
from rubrica.functions.text import strip

BINS = 256


def ink_runs(profile: DataFrame, by: str = "page_id", min_rows: int = 3) -> DataFrame:
    """Runs of consecutive rows with ink: by, top, bottom (one past the last row); short runs are noise.

    A page's rows are bounded by its height, and so is the window.
    """
    inked = profile.where("ink > 0")
    island = F.col("row") - F.row_number().over(Window.partitionBy(by).orderBy("row"))
    return (
        inked.withColumn("_i", island)
        .groupBy(by, "_i")
        .agg(F.min("row").alias("top"), (F.max("row") + 1).alias("bottom"))
        .where(F.col("bottom") - F.col("top") >= min_rows)
        .drop("_i")
    )


def run_gaps(runs: DataFrame, by: str = "page_id") -> DataFrame:
    """Runs with the gap to the run above, null for the first."""
    above = F.lag("bottom").over(Window.partitionBy(by).orderBy("top"))
    return runs.withColumn("gap", F.col("top") - above)


def pitch(peaks: DataFrame, by: str = "page_id", default: float = 40.0) -> DataFrame:
    """Median distance between consecutive line peaks: by, pitch; a default with fewer than two peaks."""
    step = F.col("row") - F.lag("row").over(Window.partitionBy(by).orderBy("row"))
    return (
        peaks.withColumn("_d", step)
        .groupBy(by)
        .agg(F.coalesce(F.percentile("_d", 0.5), F.lit(default)).alias("pitch"))
    )


def otsu_threshold(values: DataFrame, by: str = "page_id", value: str = "gap") -> DataFrame:
    """Split of each group's values into two populations: by, otsu.

    Values fall into 256 equal bins between the group's extremes; the split is the bin after which the between-class
    variance is largest, the first on ties. Works on bin counts, so a group of any size shrinks before its window.
    """
    known = values.where(F.col(value).isNotNull())
    spans = known.groupBy(by).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    # counting equal values first keeps the join with the extremes small
    counted = known.groupBy(by, value).agg(F.count(F.lit(1)).alias("n")).join(spans, by)
    width = F.col("hi") - F.col("lo")
    bin_no = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) * BINS / F.when(width > 0, width)), F.lit(BINS - 1)))
    binned = (
        counted.withColumn("bin", F.coalesce(bin_no, F.lit(0)))
        .groupBy(by, "lo", "hi", "bin")
        .agg(F.sum("n").alias("n"))
        .withColumn("center", F.col("lo") + (F.col("bin") + 0.5) * width / BINS)
    )
    up = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(by).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    mass = F.col("n") * F.col("center")
    split = binned.withColumns(
        {"w1": F.sum("n").over(up), "s1": F.sum(mass).over(up), "w2": F.sum("n").over(down), "s2": F.sum(mass).over(down)}
    )
    between = F.col("w1") * F.col("w2") * F.pow(F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2"), F.lit(2))
    return (
        split.withColumn("v", F.round(between, 6))
        .groupBy(by, "lo", "hi")
        .agg(F.max_by("center", F.when(F.col("w2").isNotNull(), F.struct("v", -F.col("bin")))).alias("c"))
        .select(by, F.coalesce("c", "lo").alias("otsu"))
    )


def gap_thresholds(gaps: DataFrame, pitches: DataFrame, by: str = "page_id") -> DataFrame:
    """Gap above which a new block starts: by, threshold.

    A page with fewer than two gaps uses 1.6 line pitches; gaps of one size never split; otherwise the two-population
    split decides.
    """
    known = gaps.where("gap IS NOT NULL")
    stats = known.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("gap").cast("double").alias("lo"),
        F.max("gap").cast("double").alias("hi"),
        F.percentile("gap", 0.5).alias("mid"),
    )
    pages = gaps.select(by).distinct()
    joined = pages.join(stats, by, "left").join(otsu_threshold(known, by), by, "left").join(pitches, by, "left")
    few = F.coalesce("n", F.lit(0)) < 2
    return joined.select(
        by,
        F.when(few, F.coalesce("pitch", F.lit(40.0)) * 1.6)
        .when(F.col("hi") - F.col("lo") < F.greatest("mid", F.lit(1.0)), F.col("hi") + 1.0)
        .otherwise(F.col("otsu"))
        .alias("threshold"),
    )


def merge_runs(runs: DataFrame, thresholds: DataFrame, by: str = "page_id") -> DataFrame:
    """Runs whose gap stays within the threshold joined into blocks: by, block_no, top, bottom, lines."""
    w = Window.partitionBy(by).orderBy("top")
    opens = F.coalesce((F.col("gap") > F.col("threshold")).cast("int"), F.lit(0))
    return (
        run_gaps(runs, by)
        .join(thresholds, by)
        .withColumn("block_no", F.sum(opens).over(w))
        .groupBy(by, "block_no")
        .agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("lines"))
    )


def longest_regular_run(peaks: DataFrame, by: str = "page_id", tolerance: float = 0.4, min_lines: int = 5) -> DataFrame:
    """Longest run of line gaps of similar size, and whether it makes the page look like lines of writing."""
    w = Window.partitionBy(by).orderBy("row")
    gaps = peaks.withColumn("gap", F.col("row") - F.lag("row").over(w)).where("gap IS NOT NULL")
    before = F.lag("gap").over(w)
    breaks = F.coalesce((F.abs(F.col("gap") - before) > F.greatest("gap", before) * tolerance).cast("int"), F.lit(0))
    runs = (
        gaps.withColumn("_b", breaks)
        .withColumn("_run", F.sum("_b").over(w))
        .groupBy(by, "_run")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(by)
        .agg(F.max("n").alias("longest"), (F.sum("n") + 1).alias("peaks"))
    )
    return runs.withColumn("regular", (F.col("peaks") >= min_lines) & (F.col("longest") + 1 >= min_lines))


def text_density(components: DataFrame, blocks: DataFrame, by: str = "block_id") -> DataFrame:
    """Share of ink in letter-sized components: by, density, parts, largest_share.

    Long thin rules are neither letters nor drawing, so they count on neither side.
    """
    w, h = F.col("w"), F.col("h")
    rule = ((h <= 6) & (w >= F.col("block_w") * 0.6)) | ((w <= 6) & (h >= F.col("block_h") * 0.6))
    letter = ~rule & (w <= 45) & (h <= 45)
    sums = (
        components.join(blocks.select(by, "block_w", "block_h"), by)
        .groupBy(by)
        .agg(
            F.sum(F.when(letter, F.col("area")).otherwise(0)).alias("letters"),
            F.sum(F.when(rule, 0).otherwise(F.col("area"))).alias("ink"),
            F.sum("area").alias("total"),
            F.max("area").alias("largest"),
            F.count(F.lit(1)).alias("parts"),
        )
    )
    return sums.select(
        by,
        F.when(F.col("ink") > 0, F.col("letters") / F.when(F.col("ink") > 0, F.col("ink"))).otherwise(0.0).alias("density"),
        "parts",
        (F.col("largest") / F.when(F.col("total") > 0, F.col("total"))).alias("largest_share"),
    )


def is_grid(lines: DataFrame, blocks: DataFrame, by: str = "block_id") -> DataFrame:
    """Three long horizontal and three long vertical lines make a table: by, grid."""
    sized = with_geometry(lines).join(blocks.select(by, "block_w", "block_h"), by)
    flat = near_horizontal(F.col("angle"), 10.0)
    upright = ~flat & F.abs("angle").between(80, 100)
    return sized.groupBy(by).agg(
        (
            (F.count_if(flat & (F.col("length") >= F.col("block_w") * 0.4)) >= 3)
            & (F.count_if(upright & (F.col("length") >= F.col("block_h") * 0.4)) >= 3)
        ).alias("grid")
    )


def classify_blocks(
    blocks: DataFrame, components: DataFrame, lines: DataFrame, peaks: DataFrame, t: Thresholds = DEFAULTS, by="block_id"
) -> DataFrame:
    """Content type per block: table, then text, then equation or drawing by how its ink is spread."""
    facts = (
        blocks.select(by)
        .join(is_grid(lines, blocks, by), by, "left")
        .join(text_density(components, blocks, by), by, "left")
        .join(longest_regular_run(peaks, by).select(by, "regular"), by, "left")
    )
    density = F.coalesce("density", F.lit(0.0))
    return facts.select(
        by,
        F.when(F.coalesce("grid", F.lit(False)), "TABLE")
        .when((density >= t.text_density) | F.coalesce("regular", F.lit(False)), "TEXT")
        .when((F.col("largest_share") < 0.5) & (F.col("parts") >= 3), "EQUATION")
        .otherwise("DIAGRAM")
        .alias("content_type"),
    )


def ocr_blocks(words: DataFrame, by: str = "block_id", order: str = "word_no") -> DataFrame:
    """Text and confidence of OCR words per block; blank words and negative confidences do not count."""
    good = (strip("text") != "") & (F.col("conf") >= 0)
    tagged = words.withColumn("_t", F.when(good, strip("text"))).withColumn("_c", F.when(good, F.col("conf")))
    mean = F.sum(F.col("_c").cast("decimal(18,4)")).cast("double") / F.count("_c") / 100
    return tagged.groupBy(by).agg(
        F.coalesce(F.expr(f"listagg(_t, ' ') WITHIN GROUP (ORDER BY {order})"), F.lit("")).alias("text"),
        F.round(F.coalesce(F.when(F.count("_c") > 0, mean), F.lit(0.0)), 4).alias("confidence"),
    )


def quality_score(sharpness: str = "sharpness", contrast: str = "contrast") -> Column:
    """Reading quality from the two measured image metrics."""
    return F.round(
        0.6 * F.least(F.col(sharpness) / 250.0, F.lit(1.0)) + 0.4 * F.least(F.col(contrast) / 20.0, F.lit(1.0)), 4
    )


def route_ocr(blocks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Engine per block: by quality, handed to the vision model when the engine itself is unsure."""
    first = F.when(F.col("quality") >= t.ocr_quality, "TESSERACT_6").otherwise("TESSERACT_11")
    return blocks.withColumn("engine", F.when(F.col("ocr_confidence") < t.ocr_confidence, "VLM").otherwise(first))
