"""Exact top-k by inner product with dual-tree search over cover trees, in blocks.

Vectors become integers, floor(scale * x). They are dealt to cells around pivots (a documented sample of at most `pivots`
vectors, as many as there are blocks) and each cell is cut into blocks of about `block_rows` by a hash, so that a cell or a
value that is very common is many blocks. In each block a cover tree is built over the distinct vectors; rows with equal
vectors hang on one point, smallest ids first. Queries are blocked and indexed alike.

A first round searches every query block against a block of its own cell, which gives each query a score that k candidates
reach: its floor. Then query blocks and data blocks are dealt to a grid, so that each pair meets in one cell and a cell holds
at most SIDE of either; this is the query set against all rows, in blocks. In a cell each query block takes the data blocks
in order of their bound and leaves those whose bound is below the floor of all its queries. A pair of blocks is searched by
descending both trees together: a pair of nodes is dropped when the bound
<q,p> <= <cq,cp> + rq*|cp| + rp*|cq| + rq*rp, with centres c and covering radii r, is below the worst k-th score among the
node's queries. Scores are integers below 2^53, exact in doubles.

At most k rows of a query leave a cell, and their ranks are limited before and after the shuffle by query.

Vectors that are null or hold null or non-finite components take no part. Every row is a candidate of every query but of
itself: rows that repeat an id, also with the same vector, are rows of their own, and a repeated query id gives an answer per
row. Vectors of different lengths are compared with their own length only. Ties go to the smaller id. Fewer than k
candidates give fewer rows; an empty table gives none. Null ids are ids like others that come last among ties. Other columns
are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rubrica.llm.common import pick
from rubrica.session import cut_lineage

LEAF = 192  # distinct vectors in a leaf
SIDE = 16  # blocks of queries, and of data, in a cell of the grid
NO_ID = np.iinfo(np.int64).max


class Tree:
    """A cover tree over distinct vectors. Node arrays: centre, covering radius, its points' range, children's range.

    The children of a node are a net of its points at half the node's radius: every point lies within that distance of its
    child's centre, and centres are further apart than that. The first child keeps the node's own centre.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, numbers: np.ndarray | None = None):
        """`numbers` tell rows apart (by default their ids do)."""
        numbers = ids if numbers is None else numbers
        order = np.lexsort((numbers, ids))
        points, inverse = np.unique(vectors[order], axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        self.perm = np.arange(len(points))
        self.points = points.astype(np.float64)
        centre, radius, spans, kids = [], [], [], []

        def add(c: int, begin: int, end: int) -> int:
            far = np.sqrt(((self.points[self.perm[begin:end]] - self.points[c]) ** 2).sum(axis=1))
            centre.append(c)
            radius.append(float(far.max()))
            spans.append((begin, end))
            kids.append((0, 0))
            return len(centre) - 1

        todo = [add(0, 0, len(points))] if len(points) else []
        while todo:
            node = todo.pop()
            (begin, end), r = spans[node], radius[node] / 2
            if end - begin <= LEAF or r == 0:
                continue
            parts, left, c = [], self.perm[begin:end], centre[node]
            while len(left):
                near = ((self.points[left] - self.points[c]) ** 2).sum(axis=1) <= r * r
                near |= left == c
                parts.append((c, left[near]))
                left = left[~near]
                c = left[0] if len(left) else -1
            at, first = begin, len(centre)
            for c, part in parts:
                self.perm[at : at + len(part)] = part
                at += len(part)
            at = begin
            for c, part in parts:
                todo.append(add(c, at, at + len(part)))
                at += len(part)
            kids[node] = (first, len(centre))
        self.centre, self.radius = np.array(centre, dtype=np.int64), np.array(radius)
        self.spans, self.kids = np.array(spans, dtype=np.int64).reshape(-1, 2), np.array(kids, dtype=np.int64).reshape(-1, 2)
        self.norm = np.sqrt((self.points**2).sum(axis=1))
        # rows of each point, ids ascending
        rows = np.argsort(inverse, kind="stable")
        self.ids, self.numbers = ids[order][rows], numbers[order][rows]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(points)))]).astype(np.int64)


def bound(q: Tree, d: Tree, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest inner product any pair of points under the nodes a[i] and b[i] can have, with room for rounding."""
    ca, cb = q.centre[a], d.centre[b]
    dot = np.einsum("ij,ij->i", q.points[ca], d.points[cb])
    rq, rd = q.radius[a], d.radius[b]
    return (dot + rq * d.norm[cb] + rd * q.norm[ca] + rq * rd) * (1 + 1e-9) + 1


class Best:
    """The k best (score, id) of each query row; `worst` is the score a newcomer must reach."""

    def __init__(self, q: Tree, k: int, floor: np.ndarray):
        self.q, self.k, self.floor = q, k, floor
        self.scores = np.full((len(q.ids), k), -np.inf)
        self.ids = np.full((len(q.ids), k), NO_ID)
        self.numbers = np.full((len(q.ids), k), -1, dtype=np.int64)
        self.worst = floor.copy()

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
        """Candidates (columns) for the query rows `at`, all merged in one sort; a row is no candidate of its own."""
        r, c = np.nonzero((scores >= self.worst[at][:, None]) & (numbers[None, :] != self.q.numbers[at][:, None]))
        if not len(r):
            return
        rows = np.unique(r)
        mine = at[rows]
        r = np.concatenate([np.repeat(rows, self.k), r])
        s = np.concatenate([self.scores[mine].reshape(-1), scores[r[len(mine) * self.k :], c]])
        i, n = np.concatenate([self.ids[mine].reshape(-1), ids[c]]), np.concatenate([self.numbers[mine].reshape(-1), numbers[c]])
        order = np.lexsort((n, i, -s, r))
        r = r[order]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        keep = order[(starts[:, None] + np.arange(self.k)).reshape(-1)]  # every row holds k entries already
        for held, new in ((self.scores, s), (self.ids, i), (self.numbers, n)):
            held[mine] = new[keep].reshape(-1, self.k)
        self.worst[mine] = np.maximum(self.floor[mine], self.scores[mine, -1])


def search(q: Tree, d: Tree, k: int, floor: np.ndarray, best: Best | None = None) -> Best:
    """Dual-tree descent. `floor`: per query row, a score already known to be reached by k candidates (-inf if none);
    `best` goes on with what earlier blocks gave."""
    best = best or Best(q, k, floor)
    if not len(q.centre) or not len(d.centre):
        return best
    # rows of query points in tree order, so that a node's rows are one slice
    starts, ends = q.first[q.perm], q.first[q.perm + 1]
    tree_rows = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)])
    point = np.repeat(q.perm, ends - starts)
    offset = np.concatenate([[0], np.cumsum(ends - starts)])
    of = lambda node: slice(offset[q.spans[node, 0]], offset[q.spans[node, 1]])
    stack = [(0, 0, float(bound(q, d, np.array([0]), np.array([0]))[0]))]
    while stack:
        a, b, reach = stack.pop()
        mine = tree_rows[of(a)]
        if reach < best.worst[mine].min():
            continue
        leaf_a, leaf_b = q.kids[a, 0] == q.kids[a, 1], d.kids[b, 0] == d.kids[b, 1]
        if leaf_a and leaf_b:
            theirs = d.perm[d.spans[b, 0] : d.spans[b, 1]]
            scores = q.points[point[of(a)]] @ d.points[theirs].T
            n = np.minimum(d.first[theirs + 1] - d.first[theirs], k + 1)  # of equal vectors the k + 1 smallest ids can matter
            if (n > 1).any():
                rows = np.concatenate([np.arange(s, s + m) for s, m in zip(d.first[theirs], n, strict=True)])
                scores = np.repeat(scores, n, axis=1)
            else:
                rows = d.first[theirs]
            best.offer(mine, scores, d.ids[rows], d.numbers[rows])
            continue
        # split the wider node; the most promising child is searched first
        if leaf_b or (not leaf_a and q.radius[a] > d.radius[b]):
            pairs = [(x, b) for x in range(*q.kids[a])]
        else:
            pairs = [(a, x) for x in range(*d.kids[b])]
        reach = bound(q, d, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        stack += [(*pairs[i], float(reach[i])) for i in np.argsort(reach, kind="stable")]
    return best


def search_blocks(queries: list[tuple[Tree, np.ndarray]], data: list[Tree], k: int) -> Iterator[Best]:
    """Each query block (tree, floors) against all data blocks, those of the highest bound first."""
    zero = np.zeros(1, dtype=np.int64)
    for q, floor in queries:
        best = Best(q, k, floor)
        reach = np.array([bound(q, d, zero, zero)[0] for d in data])
        for i in np.argsort(-reach, kind="stable"):
            if reach[i] < best.worst.min():
                break
            search(q, data[i], k, floor, best)
        yield best


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(id, number, v): vectors as arrays of integers in doubles, each row with a number; rows that take no part are left out."""
    d = pick(vectors, id="vec_id", e="embedding").withColumn("e", F.col("e").cast("array<double>"))
    usable = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("e") > 0)
    return d.filter(F.col("e").isNotNull() & usable).select(
        F.col("id").cast("long").alias("id"), F.monotonically_increasing_id().alias("number"),
        F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("v"),
    )


def _matrix(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def celled(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds `cell`: the nearest pivot among those of the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = _matrix(batch.column(2))
            sizes = np.array([len(v) for v in vs])
            cell = np.zeros(len(vs), dtype=np.int64)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                p = pivots.get(int(n))
                if p is not None:
                    m = np.stack([vs[i] for i in at])
                    cell[at] = ((p**2).sum(axis=1)[None, :] - 2 * m @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(sizes)], names=["id", "number", "v", "cell", "dim"])

    return rows.mapInArrow(run, "id bigint, number bigint, v array<double>, cell bigint, dim bigint")


def parted(rows: DataFrame, block_rows: int) -> DataFrame:
    """Adds `part`: a block of about `block_rows` rows of a cell, by a hash of the row."""
    sizes = rows.groupBy(F.col("dim").alias("_d"), F.col("cell").alias("_c")).agg(F.count("*").alias("n"))
    met = rows.join(F.broadcast(sizes), (rows["dim"] == F.col("_d")) & (rows["cell"] == F.col("_c")))  # a row per pivot at most
    return met.withColumn("part", F.pmod(F.xxhash64("number"), F.ceil(F.col("n") / F.lit(block_rows)).cast("long"))).drop("n", "_d", "_c")


def indexed(rows: DataFrame) -> DataFrame:
    """(dim, cell, part, tree): one cover tree per block."""

    def build(key, table):
        v = np.stack(_matrix(table.column("v").combine_chunks()))
        ids = table.column("id").fill_null(NO_ID - 1).to_numpy()
        tree = Tree(v, ids, table.column("number").to_numpy())
        d, c, p = (x.as_py() for x in key)
        return pa.table({"dim": [d], "cell": [c], "part": [p], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return rows.select("dim", "cell", "part", "id", "number", "v").groupBy("dim", "cell", "part").applyInArrow(
        build, "dim bigint, cell bigint, part bigint, tree binary"
    )


FOUND = "number bigint, query_id bigint, vec_id bigint, score bigint"


def _found(best: Best) -> pa.Table:
    row, place = np.nonzero(best.scores > -np.inf)
    ids = lambda x: pa.array(x, mask=x == NO_ID - 1)
    return pa.table(
        {
            "number": best.q.numbers[row],
            "query_id": ids(best.q.ids[row]),
            "vec_id": ids(best.ids[row, place]),
            "score": best.scores[row, place].astype(np.int64),
        }
    )


def _floored(tree: bytes, floors: list) -> tuple[Tree, np.ndarray]:
    q = pickle.loads(tree)
    known = dict(floors or [])
    return q, np.array([known.get(i, -np.inf) for i in q.numbers.tolist()], dtype=np.float64)


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    scale: int = 1024,
    pivots: int = 64,
    block_rows: int = 4096,
    query_rows: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest integer inner products with all other rows.

    `is_query` is a condition on `id`. At most `pivots` rows, those with the smallest hashes, are sampled to lay out cells;
    every row is indexed and searched.
    """
    rows = cut_lineage(quantised(vectors, scale))
    n_pivots = max(1, min(pivots, rows.count() // block_rows))
    sample = rows.orderBy(F.xxhash64(F.lit("pivot"), "id"), "id", "number").limit(n_pivots).collect()
    dims: dict[int, list] = {}
    for r in sample:
        dims.setdefault(len(r["v"]), []).append(r["v"])
    placed = cut_lineage(celled(rows, {n: np.unique(np.array(v), axis=0) for n, v in dims.items()}))
    asked = cut_lineage(parted(placed.filter(is_query), query_rows))
    trees = cut_lineage(indexed(parted(placed, block_rows)))
    queries = cut_lineage(indexed(asked))
    data = trees.select("dim", F.col("cell").alias("d_cell"), F.col("part").alias("d_part"), F.col("tree").alias("d_tree"))
    q = queries.select("dim", F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("tree").alias("q_tree"))
    per_query = Window.partitionBy("number").orderBy(F.col("score").desc(), F.asc_nulls_last("vec_id"))

    # round 1: the first block of the query's own cell gives every query k candidates to beat
    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_raw, d_raw in zip(batch.column(0), batch.column(1), strict=True):
                for best in search_blocks([_floored(q_raw.as_py(), [])], [pickle.loads(d_raw.as_py())], k):
                    yield from _found(best).cast(schema).to_batches()

    schema = pa.schema([("number", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    near = q.join(data.filter("d_part = 0"), (q["dim"] == data["dim"]) & (q["q_cell"] == data["d_cell"])).select("q_tree", "d_tree")
    first = near.mapInArrow(home, FOUND).withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") == k)
    floors = first.select(F.col("number").alias("_n"), F.col("score").cast("double").alias("floor"))
    # a query block's floors travel with it: at most about `query_rows` of them
    known = asked.select("number", "dim", F.col("cell").alias("q_cell"), F.col("part").alias("q_part")).join(floors, F.col("number") == F.col("_n"))
    known = known.groupBy("dim", "q_cell", "q_part").agg(F.collect_list(F.struct("number", "floor")).alias("floors"))
    q = cut_lineage(q.join(known, ["dim", "q_cell", "q_part"], "left"))

    # round 2: query blocks against all blocks of their length, on a grid
    across, down = -(-q.count() // SIDE), -(-trees.count() // SIDE)
    lot = lambda n, *key: F.pmod(F.xxhash64(*key), F.lit(max(1, n)))
    # keys of one type on both sides: a co-group hashes whole numbers of different widths apart
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n) - 1).cast("long")))
    data = data.select("dim", "d_tree", lot(down, "d_cell", "d_part").alias("i"), copies(across).alias("j"))
    q = q.select("dim", "q_tree", "floors", lot(across, "q_cell", "q_part").alias("j"), copies(down).alias("i"))

    def cell(left, right):
        held = [pickle.loads(t) for t in right.column("d_tree").to_pylist()]
        asked_ = (_floored(t, [(x['number'], x['floor']) for x in f or []]) for t, f in zip(left.column("q_tree").to_pylist(), left.column("floors").to_pylist(), strict=True))
        found = [_found(best).cast(schema) for best in search_blocks(asked_, held, k)] if held else []
        return pa.concat_tables(found) if found else schema.empty_table()

    kinds = F.col("floors").cast("array<struct<number:bigint,floor:double>>")
    left, right = q.withColumn("floors", kinds).groupBy("dim", "i", "j"), data.groupBy("dim", "i", "j")
    found = left.cogroup(right).applyInArrow(cell, FOUND)
    ranked = found.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
