"""Scans with small buckets against plain loops, with one key holding most of the rows."""

import random
from datetime import datetime, timedelta

from rubrica.operators import retrieval, scans
from rubrica.streaming import states
from pyspark.sql import functions as F


def log(n=3000, seed=2):
    rng = random.Random(seed)
    return [(7 if rng.random() < 0.6 else rng.randrange(5), i, rng.choice(states.COMMANDS)) for i in range(n)]


def replay(rows):
    status, out = {}, []
    for sheet, seq, command in rows:
        before = status.get(sheet, "QUEUED")
        after, ok = states.transition(before, command)
        status[sheet] = after
        out.append((sheet, seq, before, after, ok))
    return sorted(out)


def test_replay_over_three_levels_of_buckets(spark):
    rows = log()
    df = spark.createDataFrame(rows, "sheet_id bigint, seq bigint, command string")
    got = states.replay_states(df, width=16).select("sheet_id", "seq", "status_before", "status", "accepted").collect()
    assert sorted(tuple(r) for r in got) == replay(rows)


def test_transitions():
    assert states.transition("QUEUED", "run") == ("RUNNING", True)
    assert states.transition("APPROVED", "retry") == ("APPROVED", False)
    assert states.transition("RUNNING", "approve") == ("RUNNING", False)
    # a result that arrives after a cancel is ignored
    assert states.transition(states.transition("RUNNING", "cancel")[0], "finish") == ("FAILED", False)


def test_previous_value(spark):
    rows = log()
    df = spark.createDataFrame(rows, "k bigint, seq bigint, v string")
    got = {(r["k"], r["seq"]): r["p"] for r in scans.previous_value(df, "k", "seq", "v", "p", width=50).collect()}
    last, want = {}, {}
    for k, seq, v in rows:
        want[k, seq] = last.get(k)
        last[k] = v
    assert got == want


def test_trailing_count(spark):
    rng, at, rows = random.Random(4), datetime(2024, 1, 1), []
    for i in range(800):
        at += timedelta(milliseconds=rng.randrange(0, 9000))
        rows.append((1 if rng.random() < 0.7 else 2, i, at))
    df = spark.createDataFrame(rows, "account int, id int, ts timestamp_ntz")
    got = {r["id"]: r["trailing"] for r in scans.trailing_count(df, "account", "ts", 60).collect()}
    want = {i: sum(1 for b, _, u in rows if a == b and t - timedelta(seconds=60) <= u <= t) for a, i, t in rows}
    assert got == want


def test_trailing_count_splits_a_key(spark, monkeypatch):
    """Half of the rows are one account's in an hour, many at one moment; some have no account or no time."""
    rng, at, rows = random.Random(6), datetime(2024, 1, 1), []
    for i in range(6000):
        hot = i % 2 == 0
        t = at + timedelta(milliseconds=rng.randrange(0, 3_600_000, 500) if hot else rng.randrange(0, 900_000_000))
        rows.append((1 if hot else rng.choice([None, *range(2, 30)]), i, None if i % 501 == 0 else t))
    kept, cut = [], scans.cut_lineage
    monkeypatch.setattr(scans, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    df = spark.createDataFrame(rows, "account int, id int, ts timestamp_ntz")
    got = {r["id"]: r["trailing"] for r in scans.trailing_count(df, "account", "ts", 60).collect()}
    by = {}
    for a, _, t in rows:
        by.setdefault(a, []).append(t)
    want = {i: None if t is None else sum(1 for u in by[a] if u and t - timedelta(seconds=60) <= u <= t) for a, i, t in rows}
    assert got == want
    hot = [r["count"] for r in kept[0].where("_k = 1").groupBy("_range").count().collect()]
    assert len(hot) >= 4 and max(hot) < 0.4 * sum(hot)


def test_batches_number_a_key_across_buckets(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold"))
    df = df.withColumn("bucket", F.floor(F.col("id") / 64))
    rows = retrieval.batch_no(df, ["k"], "id", "bucket", 100).orderBy("id").collect()
    for key in ("hot", "cold"):
        assert [r["row_no"] for r in rows if r["k"] == key] == list(range(sum(r["k"] == key for r in rows)))
    assert all(r["batch_no"] == r["row_no"] // 100 for r in rows)


def test_stream_of_several_batches_equals_replay(spark, tmp_path):
    from rubrica.streaming import jobs

    rows = log(600, 9)
    for part in range(3):
        chunk = spark.createDataFrame(rows[part * 200 : part * 200 + 200], "sheet_id bigint, seq bigint, command string")
        chunk = chunk.withColumn("ts", F.timestamp_seconds(F.col("seq") + 1))
        chunk.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = jobs.read_table_stream(spark, str(tmp_path / "in"), "*.parquet", chunk.schema, 1)
    got = jobs.run_available(states.sheet_states(source)).select("sheet_id", "seq", "status_before", "status", "accepted")
    assert sorted(tuple(r) for r in got.collect()) == replay(rows)
