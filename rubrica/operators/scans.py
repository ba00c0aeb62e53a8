"""Ordered scans over keys of any size.

A window over one key runs in one task. These scans cut a key's rows into buckets of their order column first, work
inside (key, bucket), and carry one summary per bucket across, so that a key holding much of the table is read by many
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rubrica.session import cut_lineage

ROWS = 16384


def bucket(order: str, width: int = ROWS) -> Column:
    return F.floor(F.col(order) / width)


def previous_value(df: DataFrame, by: str, order: str, value: str, out: str, width: int = ROWS) -> DataFrame:
    """Append the value of the row before in its key: the lag of an unbounded key. `order` is a unique whole number."""
    b = df.withColumn("_b", bucket(order, width))
    local = F.lag(value).over(Window.partitionBy(by, "_b").orderBy(order))
    ends = b.groupBy(by, "_b").agg(F.max_by(value, order).alias("_last"))
    carried = F.lag("_last").over(Window.partitionBy(by).orderBy("_b"))
    ends = ends.withColumn("_carried", carried).drop("_last")
    first = F.row_number().over(Window.partitionBy(by, "_b").orderBy(order)) == 1
    return (
        b.withColumn("_first", first)
        .withColumn("_local", local)
        .join(ends, [by, "_b"])
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_local")))
        .drop("_b", "_first", "_local", "_carried")
    )


def trailing_count(df: DataFrame, by: str, ts: str, seconds: int = 60, out: str = "trailing") -> DataFrame:
    """Append the number of the key's rows in the `seconds` up to and including each row.

    A row counts as many rows as lie up to it, less those before its window begins: a difference of two ranks in its key.
    Rows of one moment are counted together first. Each moment gives two points, its own place and where its window begins;
    points are dealt to ranges of (key, place), ranks are summed inside a range, and each range's total is carried to those
    after it. So a key that holds most of the table is split over tasks, however short the time, and a task holds one range;
    the carry has one row per range and key. Both ranks of a moment then meet, and the count joins its rows.

    Rows without a time get null; rows without a key are one key.
    """
    spark = df.sparkSession
    span = seconds * 1_000_000
    placed = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    moments = placed.where("_us IS NOT NULL").groupBy(F.col(by).alias("_k"), "_us").agg(F.count(F.lit(1)).alias("_n"))
    # where a window begins sorts before a moment at the same place, which still is inside the window
    begin = F.struct((F.col("_us") - span).alias("place"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"))
    own = F.struct(F.col("_us").alias("place"), F.lit(1).alias("kind"), F.col("_n").alias("n"))
    points = moments.select("_k", "_us", F.explode(F.array(begin, own)).alias("p")).select("_k", "_us", "p.*")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.repartitionByRange(ranges, "_k", "place", "kind").withColumn("_range", F.spark_partition_id())
    dealt = cut_lineage(dealt)  # ranges must not change between the totals and the ranks
    totals = dealt.groupBy("_k", "_range").agg(F.sum("n").alias("_total"))
    earlier = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_k", "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("_range", "_k").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("_rank", F.sum("n").over(inside))
    same = ranked["_range"] == F.col("_r")
    ranked = ranked.join(
        carried.select(F.col("_k").alias("_key"), F.col("_range").alias("_r"), "_carried"), same & ranked["_k"].eqNullSafe(F.col("_key"))
    ).select("_k", "_us", "kind", (F.col("_rank") + F.col("_carried")).alias("_rank"))
    counted = ranked.groupBy("_k", F.col("_us").alias("_at")).agg(
        F.sum(F.when(F.col("kind") == 1, F.col("_rank")).otherwise(-F.col("_rank"))).alias(out)
    )
    met = placed.join(counted, placed[by].eqNullSafe(F.col("_k")) & (placed["_us"] == F.col("_at")), "left")
    return met.drop("_us", "_k", "_at")


def fold_states(
    df: DataFrame, by: str, order: str, symbol: str, table: list[list[int]], start: int, width: int = ROWS
) -> DataFrame:
    """Run a finite state machine over each key's rows in order: appends state_before and state_after.

    `table[state][symbol]` is the next state. What a bucket of rows does is a map from state to state, and maps compose,
    so buckets are folded alone, their maps are chained over three levels of buckets, and each bucket then replays its
    rows from the state it starts in. No task holds more than `width` rows or maps of a key below the top level, where
    one map stands for `width` squared positions of the order.
    """
    states, symbols = len(table), len(table[0])
    flat = F.array(*[F.lit(s) for row in table for s in row])
    identity = F.array(*[F.lit(s) for s in range(states)])
    rest = [c for c in df.columns if c not in (by, order, symbol)]

    level1 = (
        df.withColumn("_b1", bucket(order, width))
        .groupBy(by, "_b1")
        .agg(F.sort_array(F.collect_list(F.struct(order, symbol, *rest))).alias("_rows"))
    )

    def walked(begin: Column, rows: Column) -> Column:
        return F.aggregate(rows, begin, lambda acc, r: F.get(flat, acc * symbols + r[symbol]))

    def chained(maps: Column) -> Column:
        return F.aggregate(maps, identity, lambda acc, m: F.transform(acc, lambda s: F.get(m["m"], s)))

    m1 = level1.select(by, "_b1", F.transform(identity, lambda s: walked(s, F.col("_rows"))).alias("m"))

    def raise_level(maps: DataFrame, low: str, high: str, above: Column) -> tuple[DataFrame, DataFrame]:
        grouped = (
            maps.withColumn(high, above)
            .groupBy(by, high)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(low).alias("b"), "m"))).alias("_maps"))
        )
        return grouped, grouped.select(by, high, chained(F.col("_maps")).alias("m"))

    g2, m2 = raise_level(m1, "_b1", "_b2", F.floor(F.col("_b1") / width))
    g3, _ = raise_level(m2, "_b2", "_b3", F.lit(0))

    def starts(groups: DataFrame, begin: Column, low: str) -> DataFrame:
        """State each child bucket begins in, from the state its parent begins in."""
        zero = F.struct(begin.alias("s"), F.array().cast("array<struct<b:bigint,s:int>>").alias("out"))

        def step(acc: Column, m: Column) -> Column:
            here = F.struct(m["b"].alias("b"), acc["s"].alias("s"))
            return F.struct(F.get(m["m"], acc["s"]).alias("s"), F.array_append(acc["out"], here).alias("out"))

        listed = F.aggregate("_maps", zero, step, lambda acc: acc["out"])
        return groups.select(by, F.explode(listed).alias("c")).select(by, F.col("c.b").alias(low), F.col("c.s").alias("_s"))

    s2 = starts(g3, F.lit(start), "_b2")
    s1 = starts(g2.join(s2, [by, "_b2"]), F.col("_s"), "_b1")

    begun = level1.join(s1, [by, "_b1"])
    shape = begun.schema["_rows"].dataType.elementType.simpleString()
    zero = F.struct(F.col("_s").alias("s"), F.array().cast(f"array<struct<r:{shape},p:int,n:int>>").alias("out"))

    def replay(acc: Column, r: Column) -> Column:
        nxt = F.get(flat, acc["s"] * symbols + r[symbol])
        here = F.struct(r.alias("r"), acc["s"].alias("p"), nxt.alias("n"))
        return F.struct(nxt.alias("s"), F.array_append(acc["out"], here).alias("out"))

    return (
        begun.select(by, F.explode(F.aggregate("_rows", zero, replay, lambda acc: acc["out"])).alias("e"))
        .select(by, "e.r.*", F.col("e.p").alias("state_before"), F.col("e.n").alias("state_after"))
    )
