"""Exact self-join of documents by Jaccard similarity of word shingles, filtered under several global token orders.

Tokens are the 64-bit hashes of a document's distinct shingles. With n tokens and the least similarity t, any partner shares
at least a = ceil(t * n) of them. Hence, under any order of all tokens that is the same for all documents,

1. of a document's first m tokens, some are among the first m' of any partner: with o tokens in common, at least
   o - max(n - m, n' - m'), as the common tokens past either cut are at most those that the cut leaves off. The first order
   is the hash itself and m about `lead` of the tokens; documents that share fewer than the least of this over all sizes n'
   that a partner can have (`least_met`) have no partner and leave. Tokens are counted in packed blocks: a task sends each
   of its tokens once per block (those that several of its documents hold are settled at home), so a token that is
   everywhere is one entry a block.
2. Documents with the same set are one from here on (its smallest id).
3. two partners share a token among their first n - a + 1. Further orders put rare tokens first, by powers of two of their
   frequency, and differ within a frequency class: tokens that one document alone holds use up places and yield nothing.
   Under the first of these orders documents meet, where the tokens left to each from the meeting place on suffice for the
   similarity; a pair goes on only if its prefixes meet under every other order too.
4. pairs are verified on the whole sets.

A large group of near copies is not expanded into pairs. Documents that meet at a token are first compared with the token's
leader (smallest under a hash), each with the few leaders whose sketches are nearest to its own; links give components; tokens
whose documents are in one component by then are left alone. The pairs still ahead are counted before they are made: while
they are many, such rounds go on, each under a hash of its own. Then come the pairs of documents that still are in different
components. As long as they are many, a round verifies a few of each two components, whose other pairs fall away when one of
them links. The pairs left in the end are verified all, which makes the components exact. Documents meet only if sketches of
their sets, which differ in no more bits than the sets do in tokens, allow the similarity, and not at a token where one of the
few tokens before it is common to both already: at the first token in common, none is, and the tokens left are most.

Words are runs of characters other than ASCII white space, A-Z in lower case. Fewer words than a shingle make one shingle.
Null texts and texts without words have no tokens, link with nothing and are components of their own. Every row is a
document; rows with one id are one component's member each. A row with a null id links and bridges like any other; its
component is the smallest id that it reaches, null if it reaches none. Empty tables give no rows. Other columns are not read. The input is a stored table: its
rows are read again in the same order if a task is repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from rubrica.llm.common import pick
from rubrica.llm.shingles import shingle_set
from rubrica.session import cut_lineage, shuffles_dropped

BLOCK_TOKENS = 2_000_000
BUCKETS, BUCKET_BYTES = 64, 16 << 20  # buckets of packed tokens at least, and text behind one at most
BROADCAST_ROWS = 2_000_000  # of two numbers each, at most
TRIED = 12  # pairs of two components that a round verifies
LEADERS = 3  # leaders that a round compares a document with
BEFORE = 4  # tokens before a meeting place that are kept with it
SKETCH = 8  # 64-bit numbers that a set is sketched in
_SEVERAL = 0xFFFF
_PACKED = "bucket bigint, block bigint, tokens binary, rows binary, docs binary, needs binary, sizes binary, valid binary"
_FIELDS = ("bucket", "block", "tokens", "rows", "docs", "needs", "sizes", "valid")
_SCHEMA = pa.schema([("bucket", pa.int64()), ("block", pa.int64())] + [(f, pa.binary()) for f in _FIELDS[2:]])


def least_shared(n: np.ndarray | int, percent: int):
    """Tokens a document of n shares with any partner: the ceiling of percent/100 * n."""
    return -(-n * percent // 100)


def leading(n: np.ndarray, percent: int, lead: float) -> np.ndarray:
    """How many of its first tokens a document of n sends."""
    return np.minimum(n, np.maximum(n - least_shared(n, percent) + 1, np.ceil(lead * n).astype(np.int64)))


def least_met(n: int, percent: int, lead: float) -> int:
    """Tokens that a document of n > 0 and any partner, of whatever size, both send: 1 at least."""
    other = np.arange(least_shared(n, percent), 100 * n // percent + 1)
    common = -(-percent * (n + other) // (100 + percent))
    ends = np.maximum(n - leading(np.int64(n), percent, lead), other - leading(other, percent, lead))
    return int((common - ends).min())


def _packed_blocks(docs: DataFrame, percent: int, lead: float, width: int, buckets: int) -> DataFrame:
    """Per block and bucket the leading tokens; per block its documents with the number of shared tokens they still need."""

    def flush(held: list, block: int) -> Iterator[pa.RecordBatch]:
        docs_, sets = [h[0] for h in held], [h[1] for h in held]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        first = leading(sizes, percent, lead)
        tokens = np.concatenate([s[:m] for s, m in zip(sets, first, strict=True)])
        rows = np.repeat(np.arange(len(sets)), first)
        order = np.argsort(tokens, kind="stable")
        tokens, rows = tokens[order], rows[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(tokens)))
        several = np.repeat(counts > 1, counts)
        each, of_size = np.unique(sizes, return_inverse=True)
        least = np.array([least_met(int(n), percent, lead) if n else 1 for n in each], dtype=np.int64)
        needs = least[of_size] - np.bincount(rows[several], minlength=len(sets))
        sent, whose = tokens[starts], np.where(counts > 1, _SEVERAL, rows[starts])
        bucket = (sent % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        valid = np.array([d is not None for d in docs_])
        out = {f: [] for f in _FIELDS}
        for b, (begin, end) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
            mine = order[begin:end]
            heads = b == block % buckets
            if len(mine) or heads:
                packed = (
                    sent[mine].tobytes(),
                    whose[mine].astype("<u2").tobytes(),
                    np.array([d or 0 for d in docs_], dtype="<i8").tobytes() if heads else b"",
                    needs.astype("<i4").tobytes() if heads else b"",
                    sizes.astype("<i4").tobytes() if heads else b"",
                    valid.tobytes() if heads else b"",
                )
                for f, v in zip(_FIELDS, (b, block, *packed), strict=True):
                    out[f].append(v)
        yield pa.RecordBatch.from_pydict(out, _SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, width)
                held.append((doc, s))
                size += len(s)
                if size >= BLOCK_TOKENS or len(held) >= _SEVERAL - 1:
                    yield from flush(held, block)
                    held, size, block = [], 0, block + 1
        if held:
            yield from flush(held, block)

    return docs.mapInArrow(run, _PACKED)


def _settle(table):
    """One bucket: a token that two blocks sent is shared. Gives (block, row, shared) and the blocks' documents."""
    blocks = table.column("block").to_numpy()
    tokens = [np.frombuffer(b, dtype=np.uint64) for b in table.column("tokens").to_pylist()]
    rows = [np.frombuffer(b, dtype="<u2") for b in table.column("rows").to_pylist()]
    n = np.array([len(t) for t in tokens])
    t, r, b = np.concatenate(tokens), np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(n)), n)
    order = np.argsort(t, kind="stable")
    same = t[order][1:] == t[order][:-1]
    shared = np.zeros(len(t), dtype=bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    # a token that several documents of a block hold makes it shared for the other blocks, and is counted at home already
    hit = shared & (r != _SEVERAL)
    key, counts = np.unique(b[hit] * (1 << 16) + r[hit], return_counts=True)
    parts = [(blocks[key >> 16], key & 0xFFFF, counts.astype(np.int64), None, None)]
    for block, docs, needs, sizes, valid in zip(blocks, *(table.column(f).to_pylist() for f in ("docs", "needs", "sizes", "valid")), strict=True):
        if docs:
            ids = np.frombuffer(docs, dtype="<i8")
            known = pa.array(ids, mask=~np.frombuffer(valid, dtype=bool))
            parts.append((np.full(len(ids), block), np.arange(len(ids)), -np.frombuffer(needs, dtype="<i4").astype(np.int64), known, np.frombuffer(sizes, dtype="<i4").astype(np.int64)))
    tables = []
    for block, row, score, ids, size in parts:
        tables.append(
            pa.table(
                {
                    "block": pa.array(block, pa.int64()),
                    "row": pa.array(row, pa.int64()),
                    "score": pa.array(score, pa.int64()),
                    "doc_id": ids if ids is not None else pa.nulls(len(row), pa.int64()),
                    "n": pa.array(size, pa.int64()) if size is not None else pa.nulls(len(row), pa.int64()),
                }
            )
        )
    return pa.concat_tables(tables)


def survivors(docs: DataFrame, percent: int, lead: float, width: int) -> DataFrame:
    """(doc_id, n, alive) per row: `alive` if enough of its leading tokens under the hash order are shared."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # as few as their size allows: a document answers once for each bucket that holds tokens of it
    buckets = max(BUCKETS, math.ceil(size / BUCKET_BYTES))
    blocks = _packed_blocks(docs, percent, lead, width, buckets)
    settled = blocks.groupBy("bucket").applyInArrow(_settle, "block bigint, row bigint, score bigint, doc_id bigint, n bigint")
    return (
        settled.groupBy("block", "row")
        .agg(F.sum("score").alias("score"), F.max("doc_id").alias("doc_id"), F.max("n").alias("n"))
        .select("doc_id", "n", (F.col("score") >= 0).alias("alive"))
    )


def by_small(df: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`df` joined with a table already computed: broadcast if it has at most BROADCAST_ROWS rows, else as Spark plans it."""
    return df.join(F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, key, how)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """A set as bits, each the parity of the tokens that a part of the hash sends there.

    A token changes one bit, so two sets differ in at least as many tokens as their sketches differ in bits.
    """
    bits = 64 * SKETCH
    place = tokens.view(np.uint64) >> np.uint64(64 - (bits.bit_length() - 1))
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(bool)).view("<i8")


#: Bits in which two sides' sketches differ.
_DIFFER = "(" + " + ".join(f"bit_count(sketch[{i}] ^ sketch_b[{i}])" for i in range(SKETCH)) + ")"


def _alike(percent: int) -> str:
    """Condition on two sides' sketches and sizes that no pair similar enough fails: such sets differ in few tokens."""
    return f"{100 + percent} * {_DIFFER} <= {100 - percent} * (n + n_b)"


def _near(percent: int) -> str:
    """Condition on two documents that meet at a token: of different components, and similar enough for all that is known."""
    return f"comp <> comp_b AND {100 + percent} * least(reach, reach_b) >= {percent} * (n + n_b) AND {_alike(percent)}"


def _beside(where: DataFrame) -> DataFrame:
    """The other side of a pair that meets at a token."""
    return where.select("token", *[F.col(c).alias(f"{c}_b") for c in where.columns if c != "token"]).withColumnRenamed("row_b", "b")


def _met(where: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of different components, and how unlike their sketches are.

    A pair meets at its first common token, and again only where none of the BEFORE tokens before are common to both.
    """
    first = f"a < b AND {_near(percent)} AND NOT arrays_overlap(before, before_b)"
    met = where.withColumnRenamed("row", "a").join(_beside(where), "token").filter(first)
    return met.groupBy("a", "b", "comp", "comp_b").agg(F.min(F.expr(f"{_DIFFER} / (n + n_b)")).alias("unlike"))


def with_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, tokens, mark, row, sketch): token sets, a 128-bit mark of each, a number of each row, a sketch."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            sets = [shingle_set(t, width).view(np.int64) for t in batch.column(1).to_pylist()]
            row += len(sets)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            flat = pa.array(np.concatenate(sets)) if sets else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(offsets, flat),
                    pa.array([hashlib.md5(s.tobytes()).digest() for s in sets]),
                    pa.array(np.arange(row - len(sets), row)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH), pa.array(np.concatenate([np.zeros(0, np.int64), *map(sketch, sets)]))
                    ),
                ],
                names=["doc_id", "n", "tokens", "mark", "row", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, tokens array<bigint>, mark binary, row bigint, sketch array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over edges (a, b), for every id that has an edge to another.

    Alternates linking larger and smaller neighbours with the least one, until no edge changes; neighbours meet in
    aggregates and joins, never in lists.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(low, "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
        new = cut_lineage(small.filter("a <> b").distinct())
        changed = new.exceptAll(e).limit(1).count() + e.exceptAll(new).limit(1).count()
        e = new
        if not changed:
            centres = e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
            return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp")).unionByName(centres)


def _prefixes(sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """(row, n, shared, prefixes, sketch): each document's first tokens under each order, and how many of its tokens others hold too.

    Documents without a partner possible are left out.
    """
    tokens = sets.select("row", "n", F.explode("tokens").alias("token"))
    frequent = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(frequent, "token").select("row", "n", "token", F.floor(F.log2("df")).cast("int").alias("class"))
    need = F.ceil(F.col("n") * percent / 100).cast("long")
    listed = shared.groupBy("row", "n").agg(F.collect_list(F.struct("class", "token")).alias("held"))  # a document's own tokens
    room = (F.size("held") - need + 1).cast("int")

    def prefix(k: int) -> Column:
        ranked = F.transform(
            "held", lambda x: F.struct(x["class"].alias("class"), F.xxhash64(F.lit(k), x["token"]).alias("h"), x["token"].alias("token"))
        )
        return F.transform(F.slice(F.array_sort(ranked), F.lit(1), room), lambda x: x["token"])

    firsts = listed.filter(room >= 1).select(
        "row", "n", F.size("held").alias("shared"), F.array(*[prefix(k) for k in range(orders)]).alias("prefixes")
    )
    return firsts.join(sets.select("row", "sketch"), "row")


def _verified(pairs: DataFrame, sets: DataFrame, prefixes: DataFrame, percent: int, orders: int) -> DataFrame:
    """Pairs (a, b) that meet under every order and are similar enough."""

    def beside(pairs: DataFrame, table: DataFrame, value: Column) -> DataFrame:
        """Pairs with a value of either side; rows of `table` that no pair names do not reach the shuffle."""
        left = by_small(table.select(F.col("row").alias("a"), value.alias("va")), pairs, "a")
        named = cut_lineage(pairs.select("b").distinct())
        right = by_small(table.select(F.col("row").alias("b"), value.alias("vb")), named, "b", "left_semi")
        return left.join(right, "b")

    # the prefixes beyond the first order travel as 32-bit hashes: equal tokens stay equal, and what meets is verified anyway
    narrow = F.transform(F.slice("prefixes", 2, max(orders - 1, 1)), lambda p: F.transform(p, lambda x: F.hash(x)))
    meet = F.lit(True)
    for k in range(orders - 1):
        meet = meet & F.arrays_overlap(F.get("va", F.lit(k)), F.get("vb", F.lit(k)))
    met = cut_lineage(beside(cut_lineage(pairs), prefixes, narrow).filter(meet).select("a", "b"))
    both = beside(met, sets, F.col("tokens")).withColumn("common", F.size(F.array_intersect("va", "vb")))
    return both.filter(100 * F.col("common") >= percent * (F.size("va") + F.size("vb") - F.col("common"))).select("a", "b")


def _pairs_ahead(where: DataFrame) -> float:
    """Pairs of documents in different components that share a token, counted once a token: what joining them all would make."""
    held = where.groupBy("token", "comp").agg(F.count("*").cast("double").alias("c"))
    each = held.groupBy("token").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))
    return each.agg(F.sum("pairs")).first()[0] or 0.0


def linked(docs: DataFrame, percent: int = 75, width: int = 5, lead: float = 0.35, orders: int = 3, spare: float = 8.0) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text).

    Rounds with leaders go on while more than `spare` pairs a document are ahead, as long as a round takes a tenth of them off.
    """
    with shuffles_dropped(docs.sparkSession):
        return _linked(docs, percent, width, lead, orders, spare)


def _linked(docs: DataFrame, percent: int, width: int, lead: float, orders: int, spare: float) -> DataFrame:
    d = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    named_docs = d.filter("doc_id IS NOT NULL")
    tallied = cut_lineage(survivors(d, percent, lead, width)).filter("doc_id IS NOT NULL")
    alive = tallied.filter("alive").select("doc_id").distinct()
    # rows without an id are told apart by their numbers in this table, so all of them go on
    chosen = by_small(named_docs, cut_lineage(alive), "doc_id", "left_semi").unionByName(d.filter("doc_id IS NULL"))
    known = cut_lineage(with_sets(chosen, width))
    sets = known.filter("n > 0")
    # of equal sets one row stands for all, that of the smallest id; nodes from here on are such rows
    first = sets.groupBy("mark").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("same"))
    member = sets.select(F.col("row").alias("me"), "doc_id", "mark").join(first, "mark").select("me", "doc_id", F.col("same.row").alias("row"))
    member = cut_lineage(member)
    sets = by_small(sets, member.select("row").distinct(), "row", "left_semi").select("row", "n", "tokens", "sketch")
    prefixes = cut_lineage(_prefixes(sets, percent, orders))
    # `reach`: how many tokens a document can have in common with another whose first common token is this one
    meeting = prefixes.withColumn("p", F.get("prefixes", F.lit(0))).select("row", "n", "shared", "sketch", "p", F.posexplode("p").alias("at", "token"))
    before = F.slice("p", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE)))
    meeting = meeting.select("row", "n", "token", (F.col("shared") - F.col("at")).alias("reach"), "sketch", before.alias("before"))

    links = None
    where = meeting.withColumn("comp", F.col("row"))

    def joined(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All links so far, and the documents at each token with their components, where they are of several."""
        every = cut_lineage(found if links is None else links.unionByName(found))
        comps = cut_lineage(components(every).withColumnRenamed("id", "row"))
        placed = by_small(meeting, comps, "row", "left")
        placed = placed.select("token", "row", "n", "reach", "sketch", "before", F.coalesce("comp", "row").alias("comp"))
        open_ = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
        return every, cut_lineage(placed.join(open_, "token", "left_semi"))

    enough, ahead, k = spare * max(prefixes.count(), 1), _pairs_ahead(where), 0
    while ahead > enough:
        lot = F.xxhash64(F.lit(f"leader{k}"), "row")
        leaders = where.groupBy("token").agg(F.min(F.struct(lot.alias("lot"), "row", "comp", "n", "reach", "sketch")).alias("l"))
        met = where.join(_beside(leaders.select("token", "l.*").drop("lot")), "token").filter(_near(percent))
        # a document has at most as many leaders as tokens
        each = met.groupBy(F.col("row").alias("a")).agg(F.collect_set(F.struct(F.expr(f"{_DIFFER} / (n + n_b)").alias("unlike"), "b")).alias("l"))
        best = each.select("a", F.explode(F.slice(F.array_sort("l"), 1, LEADERS)).alias("l")).select("a", "l.b")
        links, where = joined(_verified(best, sets, prefixes, percent, orders))
        before, ahead, k = ahead, _pairs_ahead(where), k + 1
        if ahead > 0.9 * before:
            break
    left = cut_lineage(_met(where, percent))
    n_left, k = left.count(), 0
    while n_left > enough:
        # two components need one link: of the pairs between them the likeliest and some at random are tried first
        best = F.min_by(F.struct("a", "b"), F.struct("unlike", "a", "b"))
        lots = [F.max_by(F.struct("a", "b"), F.xxhash64(F.lit(f"pair{k}.{i}"), "a", "b")) for i in range(TRIED - 1)]
        between = (F.least("comp", "comp_b"), F.greatest("comp", "comp_b"))
        tried = left.groupBy(*between).agg(F.array_distinct(F.array(best, *lots)).alias("p")).select(F.explode("p").alias("p"))
        tried = cut_lineage(tried.select("p.a", "p.b"))
        found = _verified(tried, sets, prefixes, percent, orders)
        links = cut_lineage(found if links is None else links.unionByName(found))
        comps = cut_lineage(components(links).withColumnRenamed("id", "row"))
        rest = left.drop("comp", "comp_b").join(tried, ["a", "b"], "left_anti")
        for side, name in (("a", "comp"), ("b", "comp_b")):
            rest = by_small(rest, comps.select(F.col("row").alias(side), F.col("comp").alias(name)), side, "left").withColumn(name, F.coalesce(name, side))
        left = cut_lineage(rest.filter("comp <> comp_b"))
        before, n_left, k = n_left, left.count(), k + 1
        if n_left > 0.9 * before:
            break
    found = _verified(left.select("a", "b"), sets, prefixes, percent, orders)
    links = cut_lineage(found if links is None else links.unionByName(found))

    # back from rows to ids: an id may stand for several sets, whose components it joins
    comps = cut_lineage(components(links).withColumnRenamed("id", "row"))
    placed = cut_lineage(by_small(member, comps, "row", "left").select("me", "doc_id", F.coalesce("comp", "row").alias("comp")))
    lowest = cut_lineage(placed.groupBy("comp").agg(F.min("doc_id").alias("b")))
    edges = by_small(placed.filter("doc_id IS NOT NULL"), lowest, "comp").select(F.col("doc_id").alias("a"), "b")
    named = cut_lineage(components(edges).withColumnRenamed("id", "doc_id"))
    out = by_small(tallied.select("doc_id", "n"), named, "doc_id", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
    nameless = known.filter("doc_id IS NULL").select(F.col("row").alias("me"), "n")
    theirs = placed.filter("doc_id IS NULL").join(lowest, "comp").select("me", F.col("b").alias("id"))
    theirs = theirs.join(named.select(F.col("doc_id").alias("id"), "comp"), "id", "left").select("me", F.coalesce("comp", "id").alias("component_id"))
    nameless = nameless.join(theirs, "me", "left").select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(nameless)


def jaccard_digest(docs: DataFrame) -> DataFrame:
    return linked(docs)


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` whose document is the smallest id of its component; rows with a null id stay."""
    gone = linked(docs, **settings).filter("component_id <> doc_id").select("doc_id").distinct()
    return by_small(docs, cut_lineage(gone), "doc_id", "left_anti")
