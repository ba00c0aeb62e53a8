"""Logs and streams: sheet states, status feed, stuck sheets, quotas, re-index triggers, grading on arrival."""

from pyspark.sql import functions as F

from rubrica.config import STAGES as STAGE_LIST
from rubrica.operators import scans
from rubrica.session import shared_dir
from rubrica.streaming import jobs, states
from workload.registry import query, view

view(
    "v_command",
    """
SELECT user_id AS sheet_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'run' WHEN 'purchase' THEN 'finish'
  WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'approve' ELSE CASE WHEN value < 10 THEN 'cancel' ELSE 'retry' END END AS command
FROM events
""",
)
view(
    "v_status_event",
    """
SELECT user_id + 100000 * CAST(floor(event_id / 700) AS BIGINT) AS sheet_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING'
  WHEN 'purchase' THEN 'RUNNING' WHEN 'signup' THEN CASE WHEN value > 30 THEN 'DONE' ELSE 'RUNNING' END
  ELSE CASE WHEN value > 30 THEN 'FAILED' ELSE 'QUEUED' END END AS status
FROM events
""",
)
view("v_call", "SELECT user_id % 5 AS account, event_id AS call_id, ts FROM events")


#: Ids that share a state entry where they are dense, with a few events each.
WIDTH = 256
#: Ids that share a state entry in the status log: its sheets have one or two events each, and the ids that 700 events in a
#: row can name span 100,000, so that an entry holds about as many events however many users there are.
SPARSE = 100_000


def _stream(t, columns):
    events = jobs.read_table_stream(t.spark, t.sf_dir, "events.parquet", t("events").schema)
    return events.selectExpr(*columns)


# The log is replayed in the oracle by recursion over each sheet's commands in order.
view(
    "s_replay",
    """
SELECT sheet_id, seq, command, status_before, status FROM (
  SELECT sheet_id, unnest(list_transform(range(1, len(cmds) + 1), lambda i: struct_pack(seq := seqs[i], command := cmds[i],
    status_before := CASE WHEN i = 1 THEN 'QUEUED' ELSE st[i - 1] END, status := st[i])), recursive := true)
  FROM (SELECT sheet_id, cmds, seqs, string_split(substr(list_reduce(list_prepend('|QUEUED', cmds), lambda acc, c: acc || '|' || CASE
      WHEN acc LIKE '%|QUEUED' AND c = 'run' THEN 'RUNNING' WHEN acc LIKE '%|RUNNING' AND c = 'finish' THEN 'DONE'
      WHEN acc LIKE '%|RUNNING' AND c IN ('fail', 'cancel') THEN 'FAILED' WHEN acc LIKE '%|QUEUED' AND c = 'cancel' THEN 'FAILED'
      WHEN (acc LIKE '%|DONE' OR acc LIKE '%|FAILED') AND c = 'retry' THEN 'QUEUED'
      WHEN (acc LIKE '%|DONE' OR acc LIKE '%|APPROVED') AND c = 'approve' THEN 'APPROVED'
      ELSE regexp_extract(acc, '[A-Z]+$') END), 9), '|') AS st
    FROM (SELECT sheet_id, list(command ORDER BY seq) AS cmds, list(seq ORDER BY seq) AS seqs FROM v_command GROUP BY sheet_id)))
""",
)
STATES = """SELECT sheet_id, seq, command, status_before, status, a AS accepted,
  CASE WHEN a AND command = 'cancel' THEN 'Cancelled by teacher.' ELSE '' END AS message
  FROM (SELECT *, status <> status_before OR (status = 'APPROVED' AND command = 'approve') AS a FROM s_replay)"""


@query("replay_sheet_states", STATES)
def _(t):
    return states.replay_states(t("v_command").select("sheet_id", "seq", "command"))


@query("sheet_states_stream", STATES)
def _(t):
    commands = _stream(
        t,
        ["user_id AS sheet_id", "event_id AS seq", "CAST(ts AS timestamp) AS ts", "CASE event_type WHEN 'view' THEN 'run' WHEN 'purchase' THEN 'finish' "
         "WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'approve' ELSE CASE WHEN value < 10 THEN 'cancel' ELSE 'retry' END END AS command"],
    )
    return jobs.run_available(states.sheet_states(commands)).drop("late")


view(
    "s_change",
    """
SELECT sheet_id, seq, status FROM (
  SELECT *, lag(status) OVER (PARTITION BY sheet_id ORDER BY seq) AS p,
    coalesce(max(CASE WHEN status IN ('DONE', 'FAILED', 'APPROVED') THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM v_status_event)
WHERE closed = 0 AND status IS DISTINCT FROM p
""",
)


@query("status_changes", "SELECT sheet_id, seq, status FROM s_change")
def _(t):
    return states.status_changes_batch(t("v_status_event").select("sheet_id", "seq", "status")).drop("before")


STATUS_COLUMNS = [
    "user_id + 100000 * CAST(floor(event_id / 700) AS BIGINT) AS sheet_id",
    "event_id AS seq",
    "CAST(ts AS timestamp) AS ts",
    "CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'RUNNING' "
    "WHEN 'signup' THEN CASE WHEN value > 30 THEN 'DONE' ELSE 'RUNNING' END "
    "ELSE CASE WHEN value > 30 THEN 'FAILED' ELSE 'QUEUED' END END AS status",
]


@query("status_changes_stream", "SELECT sheet_id, seq, status FROM s_change")
def _(t):
    return jobs.run_available(states.status_changes(_stream(t, STATUS_COLUMNS), width=SPARSE))


STAGES = """SELECT status, count(*) AS sheets FROM (SELECT * FROM v_status_event QUALIFY row_number() OVER (
  PARTITION BY sheet_id ORDER BY seq DESC) = 1) GROUP BY status"""


view(
    "v_stage_event",
    f"""
SELECT user_id % 500 AS sheet_id, event_id AS seq, ts, split_part('{",".join(STAGE_LIST)}', ',', 1 + CAST((event_id * 7 + user_id) % 13 AS INT)) AS stage
FROM events
""",
)
STAGE_NOW = """SELECT stage, count(*) AS sheets FROM (SELECT * FROM v_stage_event QUALIFY row_number() OVER (
  PARTITION BY sheet_id ORDER BY seq DESC) = 1) GROUP BY stage"""


@query("stage_counts", STAGES)
def _(t):
    return states.stage_counts(t("v_status_event"))


@query("stage_counts_stream", STAGE_NOW)
def _(t):
    """Counts by stage, kept by adding each change's retraction and addition as the log arrives."""
    path = shared_dir(t.spark, "stage-counts")
    events = _stream(
        t,
        ["user_id % 500 AS sheet_id", "event_id AS seq", "CAST(ts AS timestamp) AS ts",
         f"split_part('{','.join(STAGE_LIST)}', ',', 1 + CAST((event_id * 7 + user_id) % 13 AS INT)) AS stage"],
    )
    jobs.follow_stages(events, path, shared_dir(t.spark, "stream-mark"))
    return jobs.newest_counts(t.spark, path)


@query("stage_counts_by_stage", STAGE_NOW)
def _(t):
    return states.stage_counts(t("v_stage_event"), "stage")


@query(
    "stuck_stream",
    """SELECT sheet_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS since,
         'Task automatically reset: queued for longer than 15 minutes with no worker picking it up.' AS error_message
       FROM (SELECT * FROM v_status_event QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY seq DESC) = 1)
       WHERE status = 'QUEUED' AND date_trunc('millisecond', ts) + INTERVAL 15 MINUTE
         <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""",
)
def _(t):
    out = jobs.run_available(states.stuck_stream(_stream(t, STATUS_COLUMNS), width=SPARSE))
    return out.withColumn("since", F.date_format("since", "yyyy-MM-dd HH:mm:ss"))


@query(
    "trailing_calls",
    """SELECT account, call_id, count(*) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)
         AS in_minute, count(*) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_hour
       FROM v_call""",
)
def _(t):
    minute = scans.trailing_count(t("v_call"), "account", "ts", 60, "in_minute")
    return scans.trailing_count(minute, "account", "ts", 3600, "in_hour").drop("ts")


@query(
    "quota_stream",
    """SELECT account, epoch(s)::BIGINT AS start_s, epoch(s)::BIGINT + 60 AS end_s, count(*) AS calls FROM (
         SELECT account, ts, unnest(list_transform(range(0, 6), lambda k: time_bucket(INTERVAL 10 SECONDS, ts) - to_seconds(10 * k))) AS s
         FROM v_call) GROUP BY account, s
       HAVING count(*) > 1 AND s + INTERVAL 60 SECONDS <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""",
)
def _(t):
    calls = _stream(t, ["user_id % 5 AS account", "CAST(ts AS timestamp) AS ts"])
    out = jobs.run_available(states.quota_stream(calls, 1))
    zero = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    at = {c: F.timestamp_diff("SECOND", zero, F.col(c).cast("timestamp_ntz")).alias(f"{c}_s") for c in ("start", "end")}
    return out.select("account", *at.values(), "calls")


view("v_question_version", "SELECT user_id AS question_id, event_id AS seq, sha256(event_type) AS hash FROM events")


@query(
    "reindex_stream",
    """SELECT question_id, seq, hash FROM (SELECT *, lag(hash) OVER (PARTITION BY question_id ORDER BY seq) AS p FROM v_question_version)
       WHERE hash IS DISTINCT FROM p""",
)
def _(t):
    versions = _stream(t, ["user_id AS question_id", "event_id AS seq", "CAST(ts AS timestamp) AS ts", "sha2(event_type, 256) AS hash"])
    return jobs.run_available(states.reindex_stream(versions))


@query(
    "reindex_concepts_stream",
    """SELECT question_id, seq, CAST(ord AS BIGINT) AS ord, CASE ord WHEN 0 THEN 'The answer names every ' || event_type || ' event.'
         ELSE 'It counts ' || (seq % 7) || ' of these events.' END AS text, 0.5::DOUBLE AS weight
       FROM (SELECT user_id AS question_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id),
         (SELECT unnest(range(0, 2)) AS ord)""",
)
def _(t):
    """Versions of questions arrive over several batches; the concepts stored at the end are those of the newest."""
    inbox, path = shared_dir(t.spark, "inbox"), shared_dir(t.spark, "reindexed")
    text = "concat('The answer names every ', event_type, ' event. It counts ', event_id % 7, ' of these events.')"
    versions = t("events").selectExpr("user_id AS question_id", "event_id AS seq", "'q' AS question", f"{text} AS model_answer")
    versions.repartition(3, "seq").write.parquet(inbox)
    source = jobs.read_table_stream(t.spark, inbox, "*.parquet", versions.schema, 1)
    for _ in range(2):  # the second run finds nothing new
        jobs.reindex_on_change(source, path, f"{path}/mark", per_bucket=1000)
    concepts = t.spark.read.parquet(f"{path}/concepts").select("question_id", "ord", "text", "weight")
    return concepts.join(t.spark.read.parquet(f"{path}/indexed").select("question_id", "seq"), "question_id")


@query(
    "open_sheets_stream",
    """SELECT sheet_id, arg_max(status, seq) AS status, max(seq) AS last FROM (
         SELECT *, event_id // 3 AS sheet_id, event_id AS seq FROM (SELECT event_id, status FROM v_status_event JOIN events ON seq = event_id))
       GROUP BY sheet_id HAVING count_if(status IN ('DONE', 'FAILED', 'APPROVED')) = 0""",
)
def _(t):
    """What the status feed still holds when the watermark has passed all of the log: the sheets that are not closed."""
    mark = shared_dir(t.spark, "stream-mark")
    events = _stream(t, ["event_id DIV 3 AS sheet_id", *STATUS_COLUMNS[1:]])
    jobs.run_available(states.status_changes(events, keep="0 seconds", width=WIDTH), mark=mark)
    held = t.spark.read.format("statestore").option("stateVarName", "now").option("flattenCollectionTypes", True).load(mark)
    kept = held.select(F.explode(F.arrays_zip(*[F.col(f"list_element.{c}").alias(c) for c in ("id", "value", "last")])).alias("sheet"))
    return kept.select(F.col("sheet.id").alias("sheet_id"), F.col("sheet.value").alias("status"), "sheet.last")
