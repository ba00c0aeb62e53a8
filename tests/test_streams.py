"""Streams over several micro-batches and restarts: order, lateness, the end of state, retractions, the concept job."""

from pyspark.sql import functions as F

from rubrica.streaming import jobs, states

LOG = "sheet_id bigint, seq bigint, at bigint, command string"


class Feed:
    """A folder that takes one file a step, and a stream over it that is started anew for each."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0

    def add(self, rows):
        df = self.spark.createDataFrame(rows, self.schema).withColumn("ts", F.timestamp_seconds("at")).drop("at")
        df.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.shape, self.n = df.schema, self.n + 1
        return self

    def stream(self):
        return jobs.read_table_stream(self.spark, f"{self.folder}/in", "*.parquet", self.shape, 1)

    def run(self, make):
        return jobs.run_available(make(self.stream()), out=f"{self.folder}/out", mark=f"{self.folder}/mark")

    def held(self, variable):
        store = self.spark.read.format("statestore").option("stateVarName", variable)
        if variable == "waiting":
            store = store.option("flattenCollectionTypes", True)
        return store.load(f"{self.folder}/mark")


def test_sheets_across_restarts(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), LOG)
    make = lambda s: states.sheet_states(s, delay="10 seconds", keep="5 seconds")
    # sheet 1 is approved, sheet 2 stays open; commands of a sheet are out of order within the delay
    feed.add([(1, 2, 2, "finish"), (1, 1, 1, "run"), (2, 4, 4, "run"), (2, 5, 5, "pause"), (2, 6, 6, None), (1, 3, 3, "approve"), (None, 9, 9, "run"), (2, None, 9, "run")])
    assert feed.run(make).count() == 0  # all of it waits: the watermark is before the newest row by the delay
    assert feed.held("waiting").count() == 6
    feed.add([(3, 20, 40, "run")])
    got = {(r["sheet_id"], r["seq"]): (r["status"], r["accepted"], r["late"]) for r in feed.run(make).collect()}
    assert got == {
        (1, 1): ("RUNNING", True, False), (1, 2): ("DONE", True, False), (1, 3): ("APPROVED", True, False),
        (2, 4): ("RUNNING", True, False), (2, 5): ("RUNNING", False, False), (2, 6): ("RUNNING", False, False),
    }
    # the watermark (30) has passed the approval by more than 5 seconds: only the open sheet is held, the newest waits
    assert [r["key"]["sheet_id"] for r in feed.held("now").collect()] == [2]
    # after a restart: a row behind the watermark does not open sheet 1 again, one with an old seq is rejected as late
    feed.add([(1, 30, 7, "run"), (2, 3, 41, "finish"), (2, 31, 42, "finish"), (4, 50, 90, "run")])
    got = {(r["sheet_id"], r["seq"]): (r["status"], r["accepted"], r["late"]) for r in feed.run(make).collect()}
    assert (1, 30) not in got and got[2, 3] == ("RUNNING", False, True) and got[2, 31] == ("DONE", True, False)
    assert got[3, 20] == ("RUNNING", True, False)
    assert {r["key"]["sheet_id"] for r in feed.held("now").collect()} == {3}  # sheet 2 was done at 42, the watermark is at 80


def test_stuck_sheets_leave_no_state(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "sheet_id bigint, at bigint, status string")
    feed.add([(1, 100, "QUEUED"), (2, 100, "QUEUED"), (2, 105, "RUNNING"), (3, 100, "QUEUED"), (3, 101, "DONE"), (4, 2000, "QUEUED")])
    got = [(r["sheet_id"], r["since"].timestamp()) for r in feed.run(lambda s: states.stuck_stream(s)).collect()]
    assert got == [(1, 100.0)]
    assert {r["key"]["sheet_id"] for r in feed.held("now").collect()} == {2, 4}


def test_counts_after_each_trigger(spark, tmp_path):
    schema = "sheet_id bigint, seq bigint, at bigint, stage string"
    feed, path, seen = Feed(spark, str(tmp_path), schema), f"{tmp_path}/counts", []
    batches = [
        [(1, 1, 1, "queued"), (2, 2, 2, "queued"), (3, 3, 3, "ocr")],
        [(1, 5, 5, "ocr"), (1, 4, 5, "scoring"), (2, 6, 6, "queued")],
        [(3, 7, 7, "done"), (1, 2, 8, "queued"), (4, 8, 8, "queued"), (4, 9, 9, "done"), (2, 10, 10, "segmentation")],
    ]
    for n, rows in enumerate(batches):
        feed.add(rows)
        seen += rows
        jobs.follow_stages(feed.stream(), path, f"{tmp_path}/mark")
        batch = states.stage_counts(spark.createDataFrame(seen, schema), "stage")
        assert sorted(map(tuple, jobs.newest_counts(spark, path).collect())) == sorted(map(tuple, batch.collect())), n


def test_older_versions_do_not_replace_newer_ones(spark, tmp_path):
    feed, path = Feed(spark, str(tmp_path), "question_id bigint, seq bigint, at bigint, question string, model_answer string"), f"{tmp_path}/index"
    run = lambda: jobs.reindex_on_change(feed.stream(), path, f"{tmp_path}/mark", per_bucket=2)
    concepts = lambda: sorted((r["question_id"], r["text"]) for r in spark.read.parquet(f"{path}/concepts").collect())
    feed.add([(1, 5, 1, "q", "Water boils when it is hot."), (1, 4, 1, "q", "Ice melts when it is warm."), (2, 1, 1, "q", "Iron rusts when it is wet.")])
    run()
    first = concepts()
    assert first == [(1, "Water boils when it is hot."), (2, "Iron rusts when it is wet.")]
    stamps = {r["question_id"]: r["concepts_indexed_at"] for r in spark.read.parquet(f"{path}/concepts").collect()}
    feed.add([(1, 3, 2, "q", "Steam is a kind of gas too."), (2, 2, 2, "q", " Iron rusts when it is wet. "), (3, 1, 2, "q", "Salt dissolves in any water.")])
    run()
    assert concepts() == [*first, (3, "Salt dissolves in any water.")]
    again = {r["question_id"]: r["concepts_indexed_at"] for r in spark.read.parquet(f"{path}/concepts").collect()}
    assert again[1] == stamps[1] and again[2] == stamps[2]  # an older version, and the same answer, index nothing
    marks = {r["question_id"]: r["seq"] for r in spark.read.parquet(f"{path}/indexed").collect()}
    assert marks == {1: 5, 2: 2, 3: 1}


def test_sheets_that_share_a_state_entry(spark, tmp_path):
    """A range of sheets in one entry gives what an entry per sheet gives, over several micro-batches."""
    batches = [
        [(1, 1, 1, "QUEUED"), (2, 2, 2, "QUEUED"), (3, 3, 3, "DONE"), (9, 4, 4, "RUNNING")],
        [(1, 6, 6, "QUEUED"), (1, 5, 5, "RUNNING"), (2, 7, 7, "FAILED"), (3, 8, 8, "QUEUED"), (9, 9, 9, "RUNNING")],
        [(2, 11, 1900, "QUEUED"), (4, 12, 2000, "QUEUED"), (9, 13, 5000, "DONE")],
    ]
    got = {}
    for width in (1, 4):
        feed = Feed(spark, f"{tmp_path}/c{width}", "sheet_id bigint, seq bigint, at bigint, status string")
        stuck = Feed(spark, f"{tmp_path}/s{width}", "sheet_id bigint, seq bigint, at bigint, status string")
        for rows in batches:
            a = feed.add(rows).run(lambda s: states.status_changes(s, keep="5 seconds", width=width))  # noqa: B023
            b = stuck.add(rows).run(lambda s: states.stuck_stream(s, width=width))  # noqa: B023
        held = feed.held("now").count()
        got[width] = sorted(map(tuple, a.collect())), sorted((r["sheet_id"], r["since"].timestamp()) for r in b.collect())
    assert got[1] == got[4]
    assert got[4][1] == [(1, 6.0), (2, 1900.0), (3, 8.0), (4, 2000.0)]
    assert held == 3  # sheets 1, 4 and 9, in ranges 0, 1 and 2


def test_a_range_of_sheets_keeps_one_element_a_batch(spark, tmp_path):
    """Each element of a list state is converted alone, so a range's rows go into arrays and not into elements."""
    feed = Feed(spark, str(tmp_path), "sheet_id bigint, seq bigint, at bigint, status string")
    feed.add([(i, i, i, None if i == 5 else "RUNNING") for i in range(1, 9)])
    feed.run(lambda s: states.status_changes(s, keep="5 seconds", width=100))
    flat = lambda name: spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", True).load(f"{tmp_path}/mark")
    assert [len(r["list_element"]["id"]) for r in flat("now").collect()] == [8]
    feed.add([(i, 20 + i, 20 + i, "QUEUED") for i in range(1, 9)])
    out = feed.run(lambda s: states.status_changes(s, keep="5 seconds", width=100))
    assert out.where("status = 'QUEUED'").count() == 8 and out.where("status IS NULL").count() == 1


def test_a_range_of_queued_sheets_keeps_one_element(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "sheet_id bigint, at bigint, status string")
    feed.add([(i, 10, "RUNNING") for i in range(1, 7)] + [(i, 10, "QUEUED") for i in (7, 8)] + [(7, 9, "DONE"), (8, 10, "DONE"), (6, 5000, "RUNNING")])
    out = feed.run(lambda s: states.stuck_stream(s, width=100))
    assert sorted((r["sheet_id"], r["since"].timestamp()) for r in out.collect()) == [(7, 10.0), (8, 10.0)]  # the first of one time counts
    held = spark.read.format("statestore").option("stateVarName", "now").option("flattenCollectionTypes", True).load(f"{tmp_path}/mark")
    assert [sorted(r["list_element"]["id"]) for r in held.collect()] == [[1, 2, 3, 4, 5, 6]]
