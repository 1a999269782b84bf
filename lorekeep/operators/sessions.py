"""Conversations and gates on tables: history turns, time-boxed sessions, character budgets, lockouts, cooldowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turns(messages: DataFrame) -> DataFrame:
    """``conv_id, pair, question, answer``: consecutive messages of one role are joined, then questions meet the answers that follow."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    change = messages.withColumn("c", (F.col("role") != F.coalesce(F.lag("role").over(w), F.lit(""))).cast("int"))
    islands = change.withColumn("island", F.sum("c").over(w)).groupBy("conv_id", "island", "role").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    v = Window.partitionBy("conv_id").orderBy("island")
    met = islands.withColumn("next_role", F.lead("role").over(v)).withColumn("answer", F.lead("text").over(v))
    pairs = met.where("role = 'user' AND next_role = 'assistant'")
    return pairs.select("conv_id", F.row_number().over(v).alias("pair"), F.col("text").alias("question"), "answer")


def within_budget(messages: DataFrame, max_messages: int, max_chars: int) -> DataFrame:
    """The newest messages of each conversation that fit both limits: ``conv_id, turn, age, chars_upto``."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    aged = messages.select("conv_id", "turn", F.row_number().over(w).alias("age"), F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("chars_upto"))
    return aged.where((F.col("age") <= max_messages) & (F.col("chars_upto") <= max_chars))


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """``user_id, session, started, ended, n``: a user's events with no longer gap between them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > gap_seconds * 1_000_000).cast("int")
    marked = events.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(w))
    return marked.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def locked(events: DataFrame, failures: int, seconds: int) -> DataFrame:
    """``event_id, user_id, recent``: failures that complete a user's limit within the seconds before them."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.where("event_type = 'error'").withColumn("recent", F.count("*").over(w)).where(F.col("recent") >= failures).select("event_id", "user_id", "recent")


def live_conversations(turns: DataFrame, now, idle_hours: int = 24, most: int = 200) -> DataFrame:
    """``conv_id, last``: conversations (turns: ``conv_id, at``) that were active within idle_hours before now (a timestamp column), the most recent ones, at most so many; only those reach one task."""
    last = turns.groupBy("conv_id").agg(F.max("at").alias("last")).where(F.col("last") > now - F.make_dt_interval(hours=F.lit(idle_hours)))
    return last.orderBy(F.desc("last"), "conv_id").limit(most)


def mark_kind(mark):
    """A feedback mark without variation selectors and skin tones."""
    return F.regexp_replace(mark, "[\\x{FE0E}\\x{FE0F}\\x{1F3FB}-\\x{1F3FF}]", "")


def still_marked(events: DataFrame) -> DataFrame:
    """``ref, kind, users``: marks that someone still sets: of each user's events (``ref, user_id, mark, at, event_id, added``) on a reference and kind the last one counts."""
    w = Window.partitionBy("ref", "kind", "user_id").orderBy(F.desc("at"), F.desc("event_id"))
    newest = events.withColumn("kind", mark_kind(F.col("mark"))).withColumn("n", F.row_number().over(w)).where("n = 1 and added")
    return newest.groupBy("ref", "kind").agg(F.count("*").alias("users"))


def newest_with_rest(rows: DataFrame, by: str, order: list, keep: int) -> DataFrame:
    """rows, the first keep of each group, with ``rest``: how many of the group aren't shown."""
    counted = rows.groupBy(by).agg((F.greatest(F.count("*") - keep, F.lit(0))).alias("rest"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= keep).drop("_n").join(counted, by)
