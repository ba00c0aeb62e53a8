"""Mixing sources to target weights: exact block quotas, split among output shards by a multivariate-hypergeometric tree.

1. Sizes per source give each source's target (`targets`): its share of the mix by weight, at most `cap` times its size,
   what is above the cap shared again by weight. The level at which the rest stops is found by one sort of the sources by
   size over weight.
2. A document's key is a hash of its id; a source's blocks are equal key ranges of about `block_docs` documents. A source
   gives whole passes of all its documents, then the documents with the smallest keys up to its quota; the document at the
   quota's edge gives its first words. The edge is found by prefix sums over the blocks (in two levels, so that no window
   holds all blocks of a source) and inside one block.
3. The blocks a source gives are its exact quota. A binary tree over the shards splits the quotas: at every node the left
   half's blocks are drawn source by source from the hypergeometric distribution of what is left, by inverting its
   cumulative weights around the mean. All shards get the same number of blocks, or one less.
4. Each shard takes the next disjoint range of each source's blocks, in an order permuted by an affine map, and orders its
   documents by a hash (`shard_order`): the local shuffle.

Everything is DataFrame functions. Sources' totals, block sums and the shard plan are the only grouped data; documents
meet them in joins on (source) and (source, block), which split when skewed. Draws depend on the seed alone.

Null sources are one source, sorted last; null or empty texts have size 0 and give nothing; an empty table gives an empty
mix. Repeated rows share a key: they are kept or left together, and share an edge's words evenly, rounded down.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rubrica.llm.common import key60, pick, word_count
from rubrica.session import cut_lineage

WEIGHTS = (5, 2, 1)
COARSE = 1024  # blocks summed together in the upper level of the prefix sums
_PRIMES = (1000003, 999983, 99991, 10007, 7919, 4099, 2053, 1009, 101, 11, 3)


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, size, key) of each document; names of the input are `doc_id`, `source`, `text`."""
    d = pick(docs, doc_id="doc_id", source="source", text="text")
    return d.select("doc_id", "source", word_count(F.col("text")).alias("size"), key60(seed, F.col("doc_id")).alias("key"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: number (by code point, null last), n_docs, source_size, weight, target."""
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    numbered = by_source.withColumn("number", (F.row_number().over(ordered) - 1).cast("long")).withColumn("weight", w)
    numbered = numbered.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn(
        "stops_at", F.col("most") / F.col("weight")
    )
    # sources in the order in which a rising level meets their caps
    rising = Window.orderBy("stops_at", "number")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # the level of the rest is right at the first source that it leaves under its cap
    levelled = numbered.withColumn("level", level).withColumn(
        "final", F.min(F.when(F.col("level") <= F.col("stops_at"), F.col("number"))).over(everything)
    )
    free = F.first(F.when(F.col("level") <= F.col("stops_at"), F.col("level")), ignorenulls=True).over(
        rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(free.isNull() | (F.col("stops_at") < free), F.col("most")).otherwise(free * F.col("weight"))
    return levelled.select("source", "number", "n_docs", "source_size", "weight", target.alias("target"))


def _rank(key: Column, n_blocks: Column) -> Column:
    """Block of a 60-bit key among n equal ranges."""
    return F.shiftright(F.shiftright(key, 28) * n_blocks, 32)


def _quotas(sizes: DataFrame, goals: DataFrame, block_docs: int) -> DataFrame:
    """Per source: whole passes, blocks, and the edge (key, doc_id, size, words) of the last pass."""
    quota = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    plan = goals.withColumn("passes", passes).withColumn("rest", quota - F.col("passes") * F.col("source_size"))
    plan = plan.withColumn("n_blocks", F.ceil(F.col("n_docs") / F.lit(block_docs)).cast("long"))
    rows = sizes.join(plan.select("source", "number", "n_blocks", "rest"), sizes["source"].eqNullSafe(plan["source"])).select(
        "number", "doc_id", "size", "key", "rest", _rank(F.col("key"), F.col("n_blocks")).alias("rank")
    )
    blocks = rows.groupBy("number", "rank").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("coarse", F.expr(f"rank div {COARSE}"))
    coarse = blocks.groupBy("number", "coarse").agg(F.sum("words").alias("coarse_words"))
    upto = Window.partitionBy("number").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("coarse_before", F.coalesce(F.sum("coarse_words").over(upto), F.lit(0)))
    inner = Window.partitionBy("number", "coarse").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(coarse.drop("coarse_words"), ["number", "coarse"]).withColumn(
        "before", F.col("coarse_before") + F.coalesce(F.sum("words").over(inner), F.lit(0))
    )
    edge = blocks.filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words"))).select(
        "number", "rank", "before"
    )
    inside = Window.partitionBy("number").orderBy("key", "doc_id", "size")
    last = (
        rows.join(edge, ["number", "rank"])
        .groupBy("number", "key", "doc_id", "size", "rank", "before", "rest")
        .agg(F.count("*").alias("rows"))
        .withColumn("upto", F.col("before") + F.sum(F.col("rows") * F.col("size")).over(inside))
        .withColumn("start", F.col("upto") - F.col("rows") * F.col("size"))
        .filter((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
        .select(
            "number",
            F.col("rank").alias("edge_rank"),
            F.struct("key", "doc_id", "size").alias("edge"),
            F.expr("(rest - start) div rows").alias("edge_words"),
        )
    )
    return plan.join(last, "number", "left")


def _log_factorial(n: Column) -> Column:
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = n.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 16, F.get(table, n.cast("int"))).otherwise(series)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Number of `good` items among `drawn` of `total`, for a uniform number u: the inverse of the cumulative weights.

    Weights are taken within 12 standard deviations of the mean, beyond which they vanish in double precision.
    """
    low, high = F.greatest(F.lit(0), drawn + good - total), F.least(drawn, good)
    mean = drawn.cast("double") * good / F.greatest(total, F.lit(1))
    spread = F.sqrt(mean * (1 - good.cast("double") / F.greatest(total, F.lit(1))) + 1) * 12 + 3
    first = F.greatest(low, F.floor(mean - spread)).cast("long")
    last = F.least(high, F.ceil(mean + spread)).cast("long")

    def weight(k: Column) -> Column:
        return (
            -_log_factorial(k) - _log_factorial(good - k) - _log_factorial(drawn - k) - _log_factorial(total - good - drawn + k)
        )

    def count_below(masses: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))

        def step(acc, x):
            return _let(
                acc["sum"] + x,
                lambda up: F.struct(up.alias("sum"), (acc["below"] + F.when(up < u, 1).otherwise(0)).alias("below")),
            )

        return F.aggregate(masses, start, step, lambda a: a["below"])

    def scaled(logs: Column) -> Column:
        """Weights from logarithms, summing to 1."""
        masses = _let(F.array_max(logs), lambda top: F.transform(logs, lambda x: F.exp(x - top)))
        return _let(masses, lambda m: _let(F.aggregate(m, F.lit(0.0), lambda t, x: t + x), lambda t: F.transform(m, lambda x: x / t)))

    below = _let(F.transform(F.sequence(first, last), weight), lambda logs: count_below(scaled(logs)))
    return F.least(first + below, last)


def split_quotas(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """(number, shard, first, last): each shard's range of each source's blocks. `quotas` has (number, units).

    A node of the tree is one row: its first shard, its number of shards and its blocks by source.
    """
    root = quotas.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("number", "units"))), lambda x: x["units"]).alias("units")
    ).select(F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("width"), "units")

    def halved(node: DataFrame) -> DataFrame:
        left = F.expr("width div 2")
        total = F.aggregate("units", F.lit(0).cast("long"), lambda a, x: a + x)
        node = node.withColumn("total", total).withColumn("goal", F.expr("(total * (width div 2)) div width"))
        start = F.struct(
            F.col("total").alias("total"), F.col("goal").alias("goal"), F.array().cast("array<bigint>").alias("got"), F.lit(0).alias("i")
        )

        def step(acc, units):
            u = (F.pmod(F.xxhash64(F.lit(seed), F.col("shard"), F.col("width"), acc["i"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            return _let(
                hypergeometric(acc["total"], units, acc["goal"], u),
                lambda k: F.struct(
                    (acc["total"] - units).alias("total"),
                    (acc["goal"] - k).alias("goal"),
                    F.concat(acc["got"], F.array(k)).alias("got"),
                    (acc["i"] + 1).alias("i"),
                ),
            )

        node = node.withColumn("got", F.aggregate("units", start, step, lambda a: a["got"]))
        a = F.struct(F.col("shard"), left.alias("width"), F.col("got").alias("units"))
        b = F.struct(
            (F.col("shard") + left).alias("shard"),
            (F.col("width") - left).alias("width"),
            F.zip_with("units", "got", lambda x, y: x - y).alias("units"),
        )
        whole = F.struct("shard", "width", "units")
        return node.select(F.explode(F.when(F.col("width") > 1, F.array(a, b)).otherwise(F.array(whole))).alias("n")).select("n.*")

    node = root
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        node = halved(node)
    leaves = node.select("shard", F.posexplode("units").alias("number", "units")).withColumn("number", F.col("number").cast("long"))
    upto = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return leaves.withColumn("last", F.sum("units").over(upto)).select(
        "number", "shard", (F.col("last") - F.col("units")).alias("first"), "last"
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    shards: int = 16,
    block_docs: int = 256,
    seed: str = "mix",
) -> DataFrame:
    """`docs` plus size, source_size, target, and `copies`: an array of (copy, shard, taken) of what the mix takes of each.

    Columns of `docs` with these names are replaced. Lists are empty for documents the mix leaves out.
    """
    narrow = cut_lineage(sized(docs, seed))
    plan = cut_lineage(_quotas(narrow, targets(narrow, weights, share, cap), block_docs))
    units = F.col("passes") * F.col("n_blocks") + F.coalesce(F.col("edge_rank") + 1, F.lit(0))
    quotas = plan.select("number", "n_blocks", units.alias("units"))
    a = F.coalesce(*[F.when(F.col("units") % p != 0, F.lit(p)) for p in _PRIMES], F.lit(1)).cast("long")
    placed = (
        split_quotas(quotas.select("number", "units"), shards, seed)
        .filter(F.col("last") > F.col("first"))
        .join(quotas, "number")
        .select("number", "n_blocks", "shard", "units", a.alias("a"), F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("v"))
        .withColumn("unit", (F.col("v") * F.col("a") + F.col("number")) % F.col("units"))
        .groupBy("number", (F.col("unit") % F.col("n_blocks")).alias("rank"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.expr("unit div n_blocks").alias("copy"), "shard")))).alias("shards"))
    )
    added = {"size", "source_size", "target", "copies"}
    d = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    d = d.withColumn("size", word_count(F.col("text"))).withColumn("_mix", F.struct(key60(seed, F.col("doc_id")).alias("key")))
    p = plan.select(F.struct("*").alias("_plan"))
    d = d.join(p, F.col("source").eqNullSafe(F.col("_plan.source")))
    m = placed.select(F.col("number").alias("_number"), F.col("rank").alias("_rank"), F.col("shards").alias("_shards"))
    d = d.withColumn("_at", F.struct(F.col("_plan.number").alias("number"), _rank(F.col("_mix.key"), F.col("_plan.n_blocks")).alias("rank")))
    d = d.join(m, (F.col("_at.number") == F.col("_number")) & (F.col("_at.rank") == F.col("_rank")), "left")
    me, edge = F.struct(F.col("_mix.key").alias("key"), F.col("doc_id"), F.col("size")), F.col("_plan.edge")
    part = F.when(edge.isNull(), 0).when(me < edge, F.col("size")).when(me == edge, F.col("_plan.edge_words")).otherwise(0).cast("long")
    passes = F.col("_plan.passes")
    numbers = F.sequence(F.lit(0).cast("long"), passes)
    copies = F.filter(
        F.transform(
            numbers,
            lambda i: F.struct(
                i.cast("int").alias("copy"),
                F.element_at("_shards", i).cast("int").alias("shard"),
                F.when(i < passes, F.col("size")).otherwise(part).alias("taken"),
            ),
        ),
        lambda c: c["taken"] > 0,
    )
    return d.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added],
        "size",
        F.col("_plan.source_size").alias("source_size"),
        F.col("_plan.target").alias("target"),
        copies.alias("copies"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: a row of `docs`' columns per copy, cut to the words taken, with `shard` and `shard_order`."""
    seed = settings.get("seed", "mix")
    full = mix(docs, **settings)
    rows = full.select(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"], F.col("size").alias("_size"), F.explode("copies").alias("_c"))
    text = F.when(F.col("_c.taken") < F.col("_size"), first_words(F.col("text"), F.col("_c.taken"))).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "copies"],
        F.col("_c.shard").alias("shard"),
        F.xxhash64(F.lit(seed), F.col("_c.shard"), F.col("doc_id"), F.col("_c.copy")).alias("shard_order"),
    )


def write_shards(mixed: DataFrame, path: str) -> None:
    """Each shard as its own folder, documents in shuffled order."""
    mixed.repartition("shard").sortWithinPartitions("shard", "shard_order").write.partitionBy("shard").parquet(path)


def mix_digest(docs: DataFrame) -> DataFrame:
    narrow = pick(docs, doc_id="doc_id", source="source", text="text")
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["taken"])
    return mix(narrow).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: The same rows in plain SQL: one sort of the documents of a source by key instead of blocks.
DIGEST_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS number
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS most
  FROM s
), o AS (
  SELECT *, most / weight AS stops_at,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(most) OVER (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER ()
            - coalesce(sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w
), f AS (SELECT arg_min(level, (stops_at, number)) AS free FROM o WHERE level <= stops_at),
t AS (
  SELECT source, source_size,
         CASE WHEN free IS NULL OR stops_at < free THEN most ELSE free * weight END AS target
  FROM o, f
), q AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS passes
  FROM t
), c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.passes,
         floor(q.target)::BIGINT - q.passes * q.source_size
         - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, room)))::BIGINT AS taken FROM c
"""
