"""Stateful gates and running reports with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COOLDOWN_SECONDS = 10.0


def admit(rows: pd.DataFrame, free_at: float, cooldown: float) -> tuple[pd.DataFrame, float]:
    """A user's requests (``event_id, at, took``, seconds) in order: admitted where none runs and the cooldown since the last finish is over.

    Rejected requests don't count. Returns the verdicts and when the user is free again.
    """
    verdicts = []
    for at, took in zip(rows["at"], rows["took"]):
        good = at >= free_at
        verdicts.append(good)
        if good:
            free_at = at + took + cooldown
    return rows.assign(admitted=verdicts), free_at


def cooldown_gate(requests: DataFrame, cooldown: float = COOLDOWN_SECONDS) -> DataFrame:
    """A stream of requests (``user_id, event_id, ts, value`` as duration in seconds) with ``admitted``.

    State is one number a user. Rows of a micro-batch are taken in order of time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out, free_at = admit(rows, state.get[0] if state.exists else float("-inf"), cooldown)
        state.update((free_at,))
        yield out.assign(user_id=key[0])[["user_id", "event_id", "admitted"]]

    asked = requests.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("value").alias("took"))
    return asked.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, admitted boolean", "free_at double", "append", GroupStateTimeout.NoTimeout)


def replayed_gate(requests: DataFrame, cooldown: float = COOLDOWN_SECONDS) -> DataFrame:
    """cooldown_gate over a table: what the stream gives when it sees all rows in order. Rows are streamed, not gathered by user; null users take no part."""

    def run(batches):
        user, free_at = None, float("-inf")
        for pdf in batches:
            for key, rows in pdf.groupby("user_id", sort=False):
                free_at = free_at if key == user else float("-inf")
                user = key
                out, free_at = admit(rows, free_at, cooldown)
                yield out[["user_id", "event_id", "admitted"]]

    asked = requests.where("user_id is not null").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("value").alias("took"))
    dealt = asked.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return dealt.mapInPandas(run, "user_id long, event_id long, admitted boolean")


def windowed_log(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and mean durations of a stream (or table) of the query log by window and path."""
    timed = events.withWatermark("asked_at", late) if events.isStreaming else events
    return timed.groupBy(F.window("asked_at", width).alias("w"), "path").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 6).alias("mean_ms")).select(F.col("w.start").alias("started"), "path", "n", "mean_ms")


def latest_feedback(events: DataFrame) -> DataFrame:
    """A stream of feedback (``kind, ref, at``) with each (kind, ref) once within the watermark."""
    return events.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["kind", "ref"])


def within_daily_cap(admitted: DataFrame, cap: int) -> DataFrame:
    """``event_id, day, place``: the first cap requests of each UTC day (``event_id, ts``) over all users; only so many of a day reach one task.

    It follows the cooldown gate. A request that the cap turns away should not start a cooldown; here it does, which
    matters only to a user's first request of the next day.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("day").orderBy("ts", "event_id")
    return admitted.withColumn("day", F.to_date("ts")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap).select("event_id", "day", "place")


def kept_questions(turns: DataFrame, cap: int) -> DataFrame:
    """``conv_id, turn, text, age``: the newest cap questions of each conversation (``conv_id, turn, role, text``)."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.where("role = 'user'").withColumn("age", F.row_number().over(w)).where(F.col("age") <= cap).select("conv_id", "turn", "text", "age")


def repeats(findings: DataFrame) -> DataFrame:
    """``rule, n, last``: how often each rule was broken and when last, by findings (``day, rules``); a finding counts for each of its rules."""
    return findings.select("day", F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.max("day").alias("last"))


def decided(findings: DataFrame, decision: str) -> DataFrame:
    """Findings (``day, decision``) of one decision; the newest are shown first."""
    return findings.where(F.col("decision") == decision)
