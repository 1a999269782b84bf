"""State with timers: a gate for rooms with a cap across users, and the store of running conversations.

The processors need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). Each rule is a plain
class that the stream's processor and the replay over a table share, so both give the same verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400
ADMITTED, RUNNING, COOLING, CAPPED = "admitted", "running", "cooldown", "cap"
#: Users that a replay remembers before those whose time is over are dropped.
REMEMBERED = 100_000


class Gate:
    """One room's gate: each user has one running request and a pause after it, all together so many requests a UTC day.

    What is turned away starts nothing and counts for nothing, so neither does it pause the user.
    """

    def __init__(self, cooldown: float, cap: int, day: int = -1, n: int = 0):
        self.cooldown, self.cap, self.day, self.n = cooldown, cap, day, n
        self.users: dict[int, tuple[float, float]] = {}  # when the request ends, and when the pause does

    def ask(self, user: int, at: float, took: float) -> str:
        day = int(at // DAY)
        if day != self.day:
            self.day, self.n = day, 0
        ends, free = self.users.get(user, (float("-inf"), float("-inf")))
        if at < ends:
            return RUNNING
        if at < free:
            return COOLING
        if self.n >= self.cap:
            return CAPPED
        self.n += 1
        self.users[user] = (at + took, at + took + self.cooldown)
        return ADMITTED

    def forget(self, now: float) -> None:
        self.users = {u: t for u, t in self.users.items() if t[1] > now}


def _asked(requests: DataFrame) -> DataFrame:
    return requests.where("room is not null and user_id is not null").select("room", "user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("took").cast("double").alias("took"), F.col("ts").cast("timestamp").alias("ts"))


VERDICTS = "room long, event_id long, verdict string"


class RoomGate(StatefulProcessor):
    """A user's times are dropped when the watermark has passed them."""

    def __init__(self, cooldown: float, cap: int):
        self.cooldown, self.cap = cooldown, cap

    def init(self, handle) -> None:
        self.handle = handle
        self.users = handle.getMapState("users", "user_id long", "ends double, free double")
        self.day = handle.getValueState("day", "day long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["at", "event_id"])
        gate = Gate(self.cooldown, self.cap, *(self.day.get() if self.day.exists() else ()))
        for u in asked["user_id"].unique().tolist():
            if self.users.containsKey((u,)):
                gate.users[u] = tuple(self.users.getValue((u,)))
        before = dict(gate.users)
        verdicts = [gate.ask(*r) for r in zip(asked["user_id"].tolist(), asked["at"].tolist(), asked["took"].tolist())]
        for u, times in gate.users.items():
            if before.get(u) != times:
                self.users.updateValue((u,), times)
        self.day.update((gate.day, gate.n))
        latest = max((t[1] for t in gate.users.values()), default=0.0)
        for old in list(self.handle.listTimers()):
            latest = max(latest, old / 1000)
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(latest * 1000) + 1)
        yield pd.DataFrame({"room": key[0], "event_id": asked["event_id"], "verdict": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        for (user,), (_, free) in list(self.users.iterator()):
            if free <= now:
                self.users.removeKey((user,))
        if not list(self.users.iterator()):
            self.users.clear()
            if self.day.exists() and self.day.get()[0] < now // DAY:
                self.day.clear()
        yield pd.DataFrame({"room": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "verdict": pd.Series(dtype=object)})

    def close(self) -> None:
        pass


def room_gate(requests: DataFrame, cooldown: float = 10.0, cap: int = 100, late: str = "10 minutes") -> DataFrame:
    """A stream of requests (``room, user_id, event_id, ts, took`` in seconds) with their verdicts; those of a room are taken in order of time within a micro-batch."""
    asked = _asked(requests).withWatermark("ts", late)
    return asked.groupBy("room").transformWithStateInPandas(RoomGate(cooldown, cap), VERDICTS, "Append", "EventTime")


def replayed_room_gate(requests: DataFrame, cooldown: float = 10.0, cap: int = 100) -> DataFrame:
    """room_gate over a table: what the stream gives when it sees all rows in order. Rows stream through; rows without room or user take no part."""

    def run(batches):
        room, gate = None, None
        for pdf in batches:
            verdicts = []
            for key, user, at, took in zip(pdf["room"].tolist(), pdf["user_id"].tolist(), pdf["at"].tolist(), pdf["took"].tolist()):
                if key != room:
                    room, gate = key, Gate(cooldown, cap)
                elif len(gate.users) > REMEMBERED:
                    gate.forget(at)
                verdicts.append(gate.ask(user, at, took))
            yield pd.DataFrame({"room": pdf["room"], "event_id": pdf["event_id"], "verdict": verdicts})

    dealt = _asked(requests).drop("ts").repartition("room").sortWithinPartitions("room", "at", "event_id")
    return dealt.mapInPandas(run, VERDICTS)


class Conversations(StatefulProcessor):
    """Question and answer pairs of a conversation, the newest that fit; all of it goes when nothing was said for so long."""

    def __init__(self, most: int, chars: int, idle_seconds: int):
        self.most, self.chars, self.idle_ms = most, chars, 1000 * idle_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.pairs = handle.getListState("pairs", "turn long, question string, answer string")
        self.open = handle.getValueState("open", "turn long, question string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        said = pd.concat(list(rows)).sort_values("turn")
        pairs = [tuple(p) for p in self.pairs.get()] if self.pairs.exists() else []
        asked = tuple(self.open.get()) if self.open.exists() else None
        for turn, role, text in zip(said["turn"].tolist(), said["role"].tolist(), said["text"].fillna("").tolist()):
            if role == "user":
                asked = (turn, text)
            elif asked is not None:
                pairs, asked = kept([*pairs, (*asked, text)], self.most, self.chars), None
        self.pairs.put(pairs) if pairs else self.pairs.clear()
        self.open.update(asked) if asked is not None else self.open.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(said["at_ms"].max()) + self.idle_ms)
        yield pd.DataFrame({"conv_id": key[0], "turns": [[p[0] for p in pairs]], "chars": sum(len(p[1]) + len(p[2]) for p in pairs), "live": True})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.pairs.clear()
        self.open.clear()
        yield pd.DataFrame({"conv_id": key[0], "turns": [[]], "chars": 0, "live": False})

    def close(self) -> None:
        pass


def kept(pairs: list[tuple], most: int, chars: int) -> list[tuple]:
    """The newest pairs (turn, question, answer) that hold at most so many messages and characters; the newest one always stays."""
    size = sum(len(p[1]) + len(p[2]) for p in pairs)
    at = 0
    while at < len(pairs) - 1 and (2 * (len(pairs) - at) > most or size > chars):
        size -= len(pairs[at][1]) + len(pairs[at][2])
        at += 1
    return pairs[at:]


def conversation_store(messages: DataFrame, most: int = 12, chars: int = 24_000, idle_seconds: int = DAY, late: str = "0 seconds") -> DataFrame:
    """A stream of messages (``conv_id, turn, role, text, at`` as timestamp) with what each conversation holds after a micro-batch: ``conv_id, turns, chars, live``.

    turns are those of the questions. Nothing said for idle_seconds by the watermark: the state is cleared and a row
    with live = false tells so. A question without an answer waits for it.
    """
    timed = messages.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).select("conv_id", "turn", "role", "text", "at", F.unix_millis("at").alias("at_ms"))
    return timed.groupBy("conv_id").transformWithStateInPandas(Conversations(most, chars, idle_seconds), "conv_id long, turns array<long>, chars long, live boolean", "Append", "EventTime")


def kept_pairs(messages: DataFrame, most: int = 12, chars: int = 24_000) -> DataFrame:
    """``conv_id, turn, age``: the pairs that conversation_store holds in the end, over a table; age 1 is the newest."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    asked = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumns({"_role": F.lag("role").over(order), "_turn": F.lag("turn").over(order), "_text": F.lag("text").over(order)})
    pairs = asked.where("role <> 'user' and _role = 'user'").select("conv_id", F.col("_turn").alias("turn"), (F.length("_text") + F.length("text")).alias("size"))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    aged = pairs.withColumns({"age": F.row_number().over(newest), "upto": F.sum("size").over(newest.rowsBetween(Window.unboundedPreceding, 0))})
    return aged.where((F.col("age") == 1) | (2 * F.col("age") <= most) & (F.col("upto") <= chars)).select("conv_id", "turn", "age")
