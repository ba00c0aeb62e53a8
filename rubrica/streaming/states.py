"""The life of a sheet: one transition table for batch replay and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rubrica.config import CANCELLED_MESSAGE, STATUSES, STUCK_QUEUED_MESSAGE, TERMINAL_STATUSES
from rubrica.operators.scans import fold_states, previous_value
from rubrica.streaming.keyed import InOrder, Waiting, millis, over_keys

# --- fixed values: which command moves a sheet from which status to which -----------------------------
COMMANDS = ("run", "finish", "fail", "retry", "cancel", "approve")
MOVES = {
    ("QUEUED", "run"): "RUNNING",
    ("RUNNING", "finish"): "DONE",
    ("RUNNING", "fail"): "FAILED",
    ("FAILED", "retry"): "QUEUED",
    ("DONE", "retry"): "QUEUED",
    ("QUEUED", "cancel"): "FAILED",
    ("RUNNING", "cancel"): "FAILED",
    ("DONE", "approve"): "APPROVED",
    ("APPROVED", "approve"): "APPROVED",
}


def transition(status: str, command: str) -> tuple[str, bool]:
    """(next status, accepted). A command the status does not allow changes nothing."""
    nxt = MOVES.get((status, command))
    return (nxt, True) if nxt else (status, False)


def _with_outcome(df: DataFrame) -> DataFrame:
    allowed = F.array(*[F.lit(f"{s}:{c}") for s, c in MOVES])
    return df.withColumn(
        "accepted", F.coalesce(F.array_contains(allowed, F.concat(F.col("status_before"), F.lit(":"), F.col("command"))), F.lit(False))
    ).withColumn(
        "message", F.when(F.col("accepted") & (F.col("command") == "cancel"), CANCELLED_MESSAGE).otherwise("")
    )


def replay_states(commands: DataFrame, width: int = 16384) -> DataFrame:
    """Every command with the status before and after it, from a complete log.

    `commands`: sheet_id, seq (unique, rising), command. Sheets start as QUEUED.
    """
    # the last symbol stands for null and for commands nobody knows: they change nothing
    table = [[STATUSES.index(transition(s, c)[0]) for c in (*COMMANDS, "")] for s in STATUSES]
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in COMMANDS]), F.col("command")), F.lit(0)).cast("int")
    symbol = F.when(place == 0, len(COMMANDS)).otherwise(place - 1)
    rows = commands.select("sheet_id", "seq", "command", symbol.alias("symbol"))
    folded = fold_states(rows, "sheet_id", "seq", "symbol", table, STATUSES.index("QUEUED"), width)
    names = F.array(*[F.lit(s) for s in STATUSES])
    return _with_outcome(
        folded.select(
            "sheet_id",
            "seq",
            "command",
            F.get(names, F.col("state_before")).alias("status_before"),
            F.get(names, F.col("state_after")).alias("status"),
        )
    )


class _Sheets(InOrder):
    """Applies commands; a sheet is closed when it is done, failed or approved."""

    columns = ("seq", "command", "status_before", "status", "late")
    start = "QUEUED"

    def take(self, status, seq, command, late):
        nxt = status if late else transition(status, command)[0]
        return nxt, [(seq, command, status, nxt, late)]

    def closed(self, status):
        return status in TERMINAL_STATUSES


def sheet_states(commands: DataFrame, delay: str = "0 seconds", keep: str = "30 days") -> DataFrame:
    """The same over a stream: `commands` has sheet_id, seq, ts, command; adds status_before, status, late, accepted, message.

    Commands wait until the watermark, `delay` behind the newest time seen, has passed them, and are then applied in seq
    order, so that a log that is out of order within the delay gives what the batch gives. A command whose seq is not above
    the last one applied is rejected as late; one older than the watermark is dropped by the stream and counted in its
    progress. A sheet closed for `keep` of event time leaves no state behind: what comes after that begins a new life.
    Rows without a sheet, seq or time take no part.
    """
    schema = "sheet_id bigint, seq bigint, command string, status_before string, status string, late boolean"
    out = over_keys(commands, "sheet_id", "command", _Sheets(millis(keep)), schema, delay)
    judged = _with_outcome(out)
    return judged.withColumn("accepted", F.col("accepted") & ~F.col("late")).withColumn(
        "message", F.when(F.col("accepted"), F.col("message")).otherwise("")
    )


def status_changes_batch(events: DataFrame, width: int = 16384) -> DataFrame:
    """Rows of a status log where a sheet's status differs from the one before, up to its first final status."""
    seen = previous_value(events, "sheet_id", "seq", "status", "before", width)
    ends = (
        events.where(F.col("status").isin(*TERMINAL_STATUSES))
        .groupBy("sheet_id")
        .agg(F.min("seq").alias("_end"))
    )
    open_feed = F.col("_end").isNull() | (F.col("seq") <= F.col("_end"))
    return seen.join(ends, "sheet_id", "left").where(open_feed & ~F.col("before").eqNullSafe(F.col("status"))).drop(
        "_end"
    )


class _Feed(InOrder):
    """Emits a status that differs from the one before, up to the first final one."""

    columns = ("seq", "status")
    start = ""

    def take(self, last, seq, status, late):
        if late or status == last or self.closed(last):
            return last, []
        return status, [(seq, status)]

    def closed(self, status):
        return status in TERMINAL_STATUSES


def status_changes(events: DataFrame, delay: str = "0 seconds", keep: str = "30 days", width: int = 1) -> DataFrame:
    """The same over a stream: sheet_id, seq, status of each change. `events`: sheet_id, seq, ts, status.

    Order, late rows and the end of state are those of `sheet_states`. `width` consecutive sheets share a state entry.
    """
    return over_keys(events, "sheet_id", "status", _Feed(millis(keep)), "sheet_id bigint, seq bigint, status string", delay, width)


def stage_counts(events: DataFrame, by: str = "status") -> DataFrame:
    """Sheets per status (or per `by`) now: the newest event of each sheet, counted. `events`: sheet_id, seq and `by`."""
    now = events.groupBy("sheet_id").agg(F.max_by(by, "seq").alias(by))
    return now.groupBy(by).agg(F.count(F.lit(1)).alias("sheets"))


class _Moves(InOrder):
    """Emits a retraction of the stage a sheet leaves and an addition of the one it enters."""

    columns = ("seq", "stage", "delta")
    start = None

    def take(self, stage, seq, new, late):
        if late or new == stage:
            return stage, []
        left = [] if stage is None else [(seq, stage, -1)]
        return new, left + ([] if new is None else [(seq, new, 1)])

    def closed(self, stage):
        return False  # a finished sheet still counts in its stage


def stage_moves(events: DataFrame, by: str = "stage", delay: str = "0 seconds") -> DataFrame:
    """Change log of a stream of stages: sheet_id, seq, stage, delta (-1 for the stage left, +1 for the one entered).

    `events`: sheet_id, seq, ts and `by`. Rows count at once, without waiting for the watermark, and a row whose seq is not
    above its sheet's last one is passed over; so the deltas of all batches so far sum to `stage_counts` of all rows so far.
    State is a stage and a seq per sheet, as every sheet counts somewhere.
    """
    schema = "sheet_id bigint, seq bigint, stage string, delta bigint"
    return over_keys(events, "sheet_id", by, _Moves(None), schema, delay)


class _Stuck(Waiting):
    """Fires when a sheet's newest status has been QUEUED for `minutes`."""

    state = "status string, at bigint"

    def __init__(self, minutes: int, message: str):
        self.minutes, self.message = minutes, message

    def _due(self, status: str, at: int) -> int | None:
        return at + self.minutes * 60_000 if status == "QUEUED" else at if status in TERMINAL_STATUSES else None

    def handleInputRows(self, key, rows, timerValues):
        now = {r[0]: r[1:] for r in self.held(self.now)}
        due = []
        for pdf in rows:
            newest: dict = {}
            for id, status, at in zip(pdf["id"].tolist(), pdf["value"].tolist(), pdf["at"].tolist(), strict=True):
                # of a sheet's rows of one time the first counts, as does a new row over an old one
                if id not in newest or at > newest[id][1]:
                    newest[id] = (status, at)
            for id, (status, at) in newest.items():
                if at >= now.get(id, ("", -1))[1]:
                    now[id] = (status, at)
                    due.append(self._due(status, at))
        self.hold(self.now, [(id, *v) for id, v in now.items()])
        due = [d for d in due if d is not None]
        if due:
            self.ring(min(due), timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, passed = {r[0]: r[1:] for r in self.held(self.now)}, timerValues.getCurrentWatermarkInMs()
        due = {id: self._due(*v) for id, v in now.items()}
        over = [id for id, d in due.items() if d is not None and d <= passed]
        stuck = [(id, now[id][1], self.message) for id in over if now[id][0] == "QUEUED"]
        if over:
            gone = set(over)
            self.hold(self.now, [(id, *v) for id, v in now.items() if id not in gone])
        later = [d for d in due.values() if d is not None and d > passed]
        if later:
            self.ring(min(later), timerValues)
        if stuck:
            yield self.frame(stuck, ("since_ms", "error_message"))


def stuck_stream(events: DataFrame, minutes: int = 15, delay: str = "0 seconds", width: int = 1) -> DataFrame:
    """Sheets left QUEUED for longer than `minutes` of event time: sheet_id, since, error_message.

    `events`: sheet_id, ts (timestamp), status. The timer of a sheet is set by its newest event and fires when the
    watermark passes it. A sheet that was reported, or whose final status the watermark has passed, leaves no state.
    `width` consecutive sheets share a state entry.
    """
    message = STUCK_QUEUED_MESSAGE.format(minutes=minutes)
    schema = "sheet_id bigint, since_ms bigint, error_message string"
    out = over_keys(events.withColumn("seq", F.lit(0).cast("long")), "sheet_id", "status", _Stuck(minutes, message), schema, delay, width)
    return out.select("sheet_id", F.timestamp_millis("since_ms").alias("since"), "error_message")


def quota_stream(calls: DataFrame, limit: int, delay: str = "0 seconds") -> DataFrame:
    """Minutes, sliding by ten seconds, in which an account made more than `limit` calls.

    `calls`: account, ts (timestamp). Windows close with the watermark, so state stays as long as a window.
    """
    return (
        calls.withWatermark("ts", delay)
        .groupBy("account", F.window("ts", "60 seconds", "10 seconds"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .where(F.col("calls") > limit)
        .select("account", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "calls")
    )


class _Versions(InOrder):
    """Emits a question's hash when it differs from the one before."""

    columns = ("seq", "hash")
    start = None

    def take(self, last, seq, digest, late):
        return (last, []) if late or digest == last else (digest, [(seq, digest)])

    def closed(self, digest):
        return False


def reindex_stream(questions: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Question versions whose answer hash differs from the one before: question_id, seq, hash.

    `questions`: question_id, seq, ts, hash. State is the last hash of each question, kept as long as questions can change.
    `jobs.reindex_on_change` drives the concept job from the versions themselves.
    """
    return over_keys(questions, "question_id", "hash", _Versions(millis("0 seconds")), "question_id bigint, seq bigint, hash string", delay)
