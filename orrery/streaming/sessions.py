"""Chat sessions, steps and visits as streams, each with the same result for a finite table.

A session's events carry a number, ``seq``, from 1. They may come in any order and more than once: an early one that comes
late waits for nothing, a late one that comes early waits for those before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

SESSION = "session string, message string, n_events long, n_missing long, ttft_ms long, thinking_ms long, outcome string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ENDS = ("done", "error")


class _Rebuild(StatefulProcessor):
    """Progress, the pieces of the message, and events that wait for earlier ones."""

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "following long, n long, missing long, started long, text_at long, thinking_at long, last long, until long, ended boolean, timer long")
        self.pieces = handle.getListState("pieces", "text string")
        self.waiting = handle.getMapState("waiting", "seq long", "type string, payload string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        p = self._load()
        held = {k[0]: v for k, v in self.waiting.iterator()} if not p["ended"] and self.waiting.exists() else {}
        stored, outcome = set(held), None
        for part in rows:
            at = (part["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            for seq, kind, payload, t in zip(part["seq"].tolist(), part["type"].tolist(), part["payload"].tolist(), at):
                p["last"] = max(p["last"], t)
                if not p["ended"] and seq >= p["following"] and seq not in held:
                    held[int(seq)] = (kind, payload, t)
        new: list[str] = []
        while not p["ended"] and p["following"] in held:
            outcome = self._take(p, held.pop(p["following"]), new)
        if outcome:
            yield self._row(key, p, new, outcome)
            self.pieces.clear()
            self.waiting.clear()
        elif not p["ended"]:
            if new:
                self.pieces.appendList([(x,) for x in new])
            for seq in stored - set(held):
                self.waiting.removeKey((seq,))
            for seq in set(held) - stored:
                self.waiting.updateValue((seq,), held[seq])
        due = max(p["last"], timerValues.getCurrentWatermarkInMs()) + self.minutes * 60_000
        if due != p["timer"]:
            if p["timer"] >= 0:
                self.handle.deleteTimer(p["timer"])
            self.handle.registerTimer(due)
            p["timer"] = due
        self.progress.update(tuple(p.values()))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What waits is taken in its order; nothing more is expected. A session that had ended is forgotten."""
        p = self._load()
        if not p["ended"]:
            new: list[str] = []
            outcome = None
            for seq, event in sorted((k[0], v) for k, v in self.waiting.iterator()):
                if not p["ended"]:
                    p["missing"] += seq - p["following"]
                    p["following"] = seq
                    outcome = self._take(p, event, new)
            yield self._row(key, p, new, outcome or "cancelled")
        self.progress.clear()
        self.pieces.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        names = ("following", "n", "missing", "started", "text_at", "thinking_at", "last", "until", "ended", "timer")
        return dict(zip(names, self.progress.get() if self.progress.exists() else (1, 0, 0, -1, -1, -1, 0, 0, False, -1)))

    @staticmethod
    def _take(p: dict, event: tuple, new: list[str]) -> str | None:
        """Counts an event in; what it ends the session with, if it does."""
        kind, payload, at = event
        p["following"] += 1
        p["n"] += 1
        p["started"] = at if p["started"] < 0 else p["started"]
        if kind == "delta":
            new.append(payload or "")
            p["text_at"] = at if p["text_at"] < 0 else p["text_at"]
        elif kind == "reasoning" and p["thinking_at"] < 0:
            p["thinking_at"] = at
        p["until"] = at
        if kind in ENDS:
            p["ended"] = True
            return kind
        return None

    def _row(self, key: tuple, p: dict, new: list[str], outcome: str | None) -> pd.DataFrame:
        wait = max(0, p["text_at"] - p["started"]) if p["text_at"] >= 0 else None
        thought = max(0, (p["text_at"] if p["text_at"] >= 0 else p["until"]) - p["thinking_at"]) if p["thinking_at"] >= 0 else None
        text = "".join([*(x[0] for x in self.pieces.get()), *new] if self.pieces.exists() else new)
        numbers = {"n_events": p["n"], "n_missing": p["missing"], "ttft_ms": wait, "thinking_ms": thought}
        return pd.DataFrame({"session": [key[0]], "message": [text], **{k: pd.array([v], "Int64") for k, v in numbers.items()}, "outcome": [outcome]})


def sessions(rows: DataFrame, minutes: int = 15) -> DataFrame:
    """One row for each session of rows (session, seq, type, payload, ts) once it ends: its text, and the waits for thought and text.

    A session ends with the first done or error event, when all before it have come, or when the watermark has moved on
    by ``minutes`` past its last event; then what has come counts, the numbers that lack are told, and one
    without an end counts as cancelled. Events of a session that has ended are dropped while it is remembered, as long again.
    Chooses RocksDB as the session's state store, which timers and maps need.
    """
    rows.sparkSession.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = rows.where("session is not null and seq is not null and ts is not null").select("session", "seq", "type", "payload", "ts").withWatermark("ts", f"{minutes} minutes")
    return timed.groupBy("session").transformWithStateInPandas(_Rebuild(minutes), SESSION, "append", "eventTime")


def sessions_batch(rows: DataFrame) -> DataFrame:
    """The same of a finite table, in which every session is over. Of events with one number the earliest counts."""
    known = rows.where("session is not null and seq >= 1 and ts is not null")
    once = known.groupBy("session", "seq").agg(F.min(F.struct("ts", "type", "payload")).alias("e")).select("session", "seq", "e.*")
    by = Window.partitionBy("session")
    once = once.withColumn("end", F.min(F.when(F.col("type").isin(*ENDS), F.col("seq"))).over(by)).where("end is null or seq <= end")
    ms = F.expr("timestampdiff(MILLISECOND, timestamp'1970-01-01', ts)") if dict(rows.dtypes)["ts"] == "timestamp" else F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)")
    once = once.withColumn("at", ms)
    first = lambda kind: F.min_by("at", F.when(F.col("type") == kind, F.col("seq")))
    found = once.groupBy("session").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "delta", F.struct("seq", F.coalesce("payload", F.lit("")).alias("payload"))))), lambda x: x["payload"]), "").alias("message"),
        F.count("*").alias("n_events"), (F.max("seq") - F.count("*")).alias("n_missing"), F.min_by("at", "seq").alias("started"), F.max_by("at", "seq").alias("until"),
        first("delta").alias("text_at"), first("reasoning").alias("thinking_at"), F.coalesce(F.min_by("type", F.when(F.col("seq") == F.col("end"), F.col("seq"))), F.lit("cancelled")).alias("outcome"),
    )
    zero = lambda c: F.greatest(F.lit(0).cast("long"), c)
    wait = F.when(F.col("text_at").isNotNull(), zero(F.col("text_at") - F.col("started")))
    thought = F.when(F.col("thinking_at").isNotNull(), zero(F.coalesce("text_at", "until") - F.col("thinking_at")))
    return found.select("session", "message", "n_events", "n_missing", wait.alias("ttft_ms"), thought.alias("thinking_ms"), "outcome")


def paired_steps(rows: DataFrame, longest: str = "1 hour", late: str = "15 minutes") -> DataFrame:
    """(request, step_id, started, finished, cost_ms) of steps (request, step_id, kind, ts): each start with its first finish from then on.

    Starts meet finishes in a join that keeps either side only for ``longest`` and the watermark; a step without a finish
    in that time has none. A start that comes twice counts once.
    """
    timed = rows.where("request is not null and step_id is not null and ts is not null")
    starts = timed.where("kind = 'start'").select("request", "step_id", F.col("ts").alias("started")).withWatermark("started", late).dropDuplicatesWithinWatermark(["request", "step_id"])
    ends = timed.where("kind = 'finish'").select(F.col("request").alias("r"), F.col("step_id").alias("s"), F.col("ts").alias("finished")).withWatermark("finished", late)
    met = starts.join(ends, F.expr(f"request = r and step_id = s and finished >= started and finished <= started + interval {longest}"), "left")
    found = met.groupBy("request", "step_id", "started").agg(F.min("finished").alias("finished"))
    return found.withColumn("cost_ms", F.expr("timestampdiff(MILLISECOND, started, finished)"))


def visits(rows: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, started, n_events, total_tokens): a user's events with less than ``gap`` between neighbours. ``late`` is for streams."""
    timed = rows if late is None else rows.withWatermark("ts", late)
    found = timed.where("user_id is not null").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.sum("tokens").alias("total_tokens"))
    return found.select("user_id", F.col("w.start").alias("started"), "n_events", "total_tokens")
