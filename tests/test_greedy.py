"""Greedy operators against one pass in order of merit, on random blocks including one large block."""

import math
import random


from rubrica.operators import greedy, spatial


def boxes(seed, blocks):
    rng = random.Random(seed)
    return [
        (b, i, round(rng.random(), 2), float(rng.randrange(300)), float(rng.randrange(600)), float(rng.randrange(5, 90)), float(rng.randrange(5, 60)))
        for b, n in enumerate(blocks)
        for i in range(n)
    ]


def iou(a, b):
    ax, ay, aw, ah = a[3:]
    bx, by, bw, bh = b[3:]
    iw, ih = min(ax + aw, bx + bw) - max(ax, bx), min(ay + ah, by + bh) - max(ay, by)
    if iw <= 0 or ih <= 0:
        return 0.0
    return iw * ih / (aw * ah + bw * bh - iw * ih)


def test_iou_pairs_report_each_pair_once(spark):
    rows = boxes(3, [40, 60])
    df = spark.createDataFrame(rows, "block_id int, mark_id int, confidence double, x double, y double, w double, h double")
    got = sorted((r["block_id"], r["l_mark_id"], r["r_mark_id"]) for r in spatial.iou_pairs(df, df, ["block_id"], 0.1).collect())
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and iou(a, b) >= 0.1)
    assert got == want


def test_nms(spark):
    rows = boxes(1, [30, 1, 200, 0, 25])
    df = spark.createDataFrame(rows, "block_id int, mark_id int, confidence double, x double, y double, w double, h double")
    got = sorted((r["block_id"], r["mark_id"]) for r in greedy.nms(df).collect())
    kept = []
    for c in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        if not any(k[0] == c[0] and iou(c, k) >= 0.3 for k in kept):
            kept.append(c)
    assert got == sorted((k[0], k[1]) for k in kept)
    assert len(got) < len(rows)


def segments(seed, blocks):
    rng = random.Random(seed)
    out = []
    for b, n in enumerate(blocks):
        for i in range(n):
            x, y, a, r = rng.randrange(500), rng.randrange(300), rng.choice((0, 0.05, 1.5)), rng.randrange(20, 160)
            out.append((b, i, float(x), float(y), float(int(x + r * math.cos(a))), float(int(y + r * math.sin(a)))))
    return out


LINES = "block_id bigint, line_no bigint, x1 double, y1 double, x2 double, y2 double"


def near(a, b):
    return min(math.dist(p, q) for p in (a[2:4], a[4:6]) for q in (b[2:4], b[4:6]))


def test_suppress_endpoints(spark):
    rows = segments(5, [25, 60])
    got = sorted((r["block_id"], r["line_no"]) for r in greedy.suppress_endpoints(spark.createDataFrame(rows, LINES)).collect())
    kept = []
    for c in sorted(rows, key=lambda r: (r[0], -round(math.dist(r[2:4], r[4:6]), 6), r[1])):
        if not any(k[0] == c[0] and near(c, k) <= 45 for k in kept):
            kept.append(c)
    assert got == sorted((k[0], k[1]) for k in kept)


def fold(lines, angle=8.0, gap=20.0):
    """Sweeps of the whole list until one changes nothing."""

    def turn(a, b):
        d = abs(math.degrees(math.atan2(a[3] - a[1], a[2] - a[0])) - math.degrees(math.atan2(b[3] - b[1], b[2] - b[0])))
        return min(d, 180 - d)

    left, out = [r[1:] for r in lines], []
    while left:
        no, cur, parts, hit = left[0][0], left[0][1:], 1, True
        left = left[1:]
        while hit:
            hit = False
            for o in list(left):
                close = min(math.dist(p, q) for p in (cur[:2], cur[2:]) for q in (o[1:3], o[3:5])) <= gap
                if close and turn(cur, o[1:]) <= angle:
                    pts = [cur[:2], cur[2:], o[1:3], o[3:5]]
                    p, q = max(((p, q) for p in pts for q in pts), key=lambda pq: math.dist(*pq))
                    cur, parts, hit = (*p, *q), parts + 1, True
                    left.remove(o)
        out.append((no, *cur, parts))
    return out


def test_merge_collinear(spark):
    rows = segments(7, [40, 12, 90, 1])
    df = spark.createDataFrame(rows, LINES)
    got = sorted(tuple(r) for r in greedy.merge_collinear(df).select("block_id", "line_no", "x1", "y1", "x2", "y2", "parts").collect())
    want = sorted((b, *m) for b in range(4) for m in fold([r for r in rows if r[0] == b]))
    assert got == want
    assert len(got) < len(rows)


def test_nms_shuffles_marks_once_and_leaves_odd_marks(spark):
    schema = "block_id int, mark_id int, confidence double, x double, y double, w double, h double"
    rows = boxes(2, [40, 15]) + [(0, 100, None, 1.0, 1.0, 90.0, 60.0), (1, 101, 0.99, None, 1.0, 90.0, 60.0)]
    rows += [(None, i, 0.5, 1.0, 1.0, 9.0, 9.0) for i in range(2)]
    rows += [(2, 7, 0.9, 1.0, 1.0, 9.0, 9.0), (2, 7, 0.8, 1.0, 1.0, 9.0, 9.0)]  # one id twice: the better stays
    out = greedy.nms(spark.createDataFrame(rows, schema))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = {tuple(r) for r in out.collect()}
    assert {r for r in rows if r[1] >= 100 or r[0] is None} <= got
    assert [r for r in got if r[0] == 2] == [(2, 7, 0.9, 1.0, 1.0, 9.0, 9.0)]


def test_nms_of_text_ids_and_empty_tables(spark):
    schema = "block_id int, mark_id string, confidence double, x double, y double, w double, h double"
    rows = [(1, "b", 0.5, 1.0, 1.0, 9.0, 9.0), (1, "a", 0.5, 1.0, 1.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, schema)
    assert [r["mark_id"] for r in greedy.nms(df).collect()] == ["a"]
    assert greedy.nms(df.where("false")).collect() == []


def test_strokes_are_joined_in_one_shuffle_and_odd_lines_stay(spark):
    rows = [(b, i, *[v / 8 for v in r]) for b, i, *r in segments(3, [400, 7, 0, 60])]
    odd = [(None, 1, 0.0, 0.0, 9.0, 0.0), (None, 1, 9.0, 0.0, 18.0, 0.0), (3, 900, None, 0.0, 9.0, 0.0), (3, None, 0.0, 0.0, 9.0, 0.0)]
    out = greedy.merge_collinear(spark.createDataFrame(rows + odd, LINES))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = [tuple(r) for r in out.select("block_id", "line_no", "x1", "y1", "x2", "y2", "parts").collect()]
    want = [(b, *m) for b in range(4) for m in fold([r for r in rows if r[0] == b])] + [(*r, 1) for r in odd]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_strokes_of_a_batch_are_joined_in_bounded_steps():
    import pyarrow as pa

    rows = segments(9, [30, 40, 50])
    lists = [[[r[i] for r in rows if r[0] == b] for b in range(3)] for i in range(1, 6)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), *map(pa.array, lists)], names=["b", "line_no", "x1", "y1", "x2", "y2"])
    before, greedy.LINES_AT_ONCE = greedy.LINES_AT_ONCE, 60
    try:
        out = list(greedy._joined("b", 8.0, 20.0)([batch]))
    finally:
        greedy.LINES_AT_ONCE = before
    assert [sorted(set(o.column("b").to_pylist())) for o in out] == [[0, 1], [2]]
    got = sorted(tuple(r.values()) for o in out for r in o.to_pylist())
    assert got == sorted((b, *m) for b in range(3) for m in fold([r for r in rows if r[0] == b]))
