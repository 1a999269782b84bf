"""Streams with state against the same rules over tables; state is dropped after idle time."""

import pytest
from pyspark.sql import functions as F

from lorekeep.plans import state_queries
from lorekeep.streaming import stores


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, stores.ROCKSDB)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def streamed(spark, tmp_path, parts, schema, operator):
    """Rows of a stream that reads each of parts in a micro-batch of its own, and rows of state after each."""
    source, out = tmp_path / "in", []
    source.mkdir(exist_ok=True)
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(source))
        writer = operator(frame).writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).outputMode("append")
        q = writer.trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        yield out, q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_gate_of_rooms_equals_its_replay(spark, sf, tmp_path, rocksdb):
    asked = state_queries.requests(spark, sf).where("event_id < 400")
    want = sorted(map(tuple, stores.replayed_room_gate(asked, 1800.0, 5).collect()))
    assert {v for *_, v in want} == {"admitted", "running", "cooldown", "cap"}
    parts = [asked.where(f"event_id >= {a} and event_id < {a + 100}") for a in range(0, 400, 100)]
    after = [(list(out), n) for out, n in streamed(spark, tmp_path, parts, asked.schema, lambda df: stores.room_gate(df, 1800.0, 5))]
    assert sorted(after[-1][0]) == want
    # a request long after: whoever is free by then is forgotten
    late = asked.limit(1).withColumn("ts", F.col("ts") + F.expr("interval 90 days")).withColumn("event_id", F.lit(10**6).cast("long"))
    rest = [n for _, n in streamed(spark, tmp_path, [late, late.withColumn("event_id", F.col("event_id") + 1).withColumn("ts", F.col("ts") + F.expr("interval 1 day"))], asked.schema, lambda df: stores.room_gate(df, 1800.0, 5))]
    assert rest[-1] < after[-1][1]


def test_conversations_keep_pairs_and_expire(spark, sf, tmp_path, rocksdb):
    said = spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id < 12").withColumn("at", F.timestamp_seconds(F.col("turn") + 1000))
    want = {}
    for r in stores.kept_pairs(said, 4, 700).collect():
        want.setdefault(r.conv_id, []).append(r.turn)
    parts = [said.where("turn < 3"), said.where("turn >= 3")]
    steps = [(list(out), n) for out, n in streamed(spark, tmp_path, parts, said.schema, lambda df: stores.conversation_store(df, 4, 700, 3600))]
    last = {}
    for conv, turns, chars, live in steps[-1][0]:
        last[conv] = turns
    assert {c: t for c, t in last.items() if t} == {c: sorted(t) for c, t in want.items()}
    later = said.limit(1).withColumns({"conv_id": F.lit(99).cast("long"), "at": F.timestamp_seconds(F.lit(10**7))})
    more = [(list(out), n) for out, n in streamed(spark, tmp_path, [later, later.withColumn("at", F.timestamp_seconds(F.lit(10**7 + 60)))], said.schema, lambda df: stores.conversation_store(df, 4, 700, 3600))]
    gone = {r[0] for r in more[-1][0] if not r[3]}
    assert gone == {r.conv_id for r in said.select("conv_id").distinct().collect()} and more[-1][1] < steps[-1][1]


def test_what_is_turned_away_starts_nothing():
    gate = stores.Gate(10, 1)
    day = stores.DAY
    assert [gate.ask(1, day - 30, 5), gate.ask(2, day - 2, 5), gate.ask(2, day + 1, 5), gate.ask(1, day + 2, 1)] == ["admitted", "cap", "admitted", "cap"]
    gate = stores.Gate(10, 9)
    assert [gate.ask(1, 0, 5), gate.ask(1, 4, 5), gate.ask(1, 14, 5), gate.ask(1, 15, 5)] == ["admitted", "running", "cooldown", "admitted"]
    gate.forget(100)
    assert gate.users == {}


def test_the_newest_pair_always_stays():
    assert stores.kept([(0, "a", "b"), (1, "x" * 50, "y")], 4, 10) == [(1, "x" * 50, "y")]
    assert stores.kept([(i, "q", "a") for i in range(5)], 4, 100) == [(3, "q", "a"), (4, "q", "a")]
