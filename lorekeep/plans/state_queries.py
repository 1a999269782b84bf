"""Registered queries over gates and stores with state, as replayed over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.corpus import table
from ..streaming import stores
from .registry import query


def requests(spark, sf_dir):
    """Events as requests in seven rooms; durations in minutes."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 7).alias("room"), "user_id", "event_id", "ts", (F.col("value") * 60).alias("took"))


@query("""WITH RECURSIVE e AS (SELECT user_id % 7 AS room, user_id, event_id, epoch_us(ts) / 1e6 AS asked, value * 60 AS took FROM events),
o AS (SELECT *, CAST(floor(asked / 86400) AS BIGINT) AS day, row_number() OVER (PARTITION BY room ORDER BY asked, event_id) AS n FROM e),
g AS (SELECT 0::BIGINT AS n, room, 0::BIGINT AS event_id, '' AS verdict, -1::BIGINT AS day, 0 AS used, MAP([0::BIGINT], [[0.0::DOUBLE, 0.0::DOUBLE]]) AS users FROM (SELECT DISTINCT room FROM e) UNION ALL
SELECT n, room, event_id, verdict, day, used + CASE WHEN verdict = 'admitted' THEN 1 ELSE 0 END, CASE WHEN verdict = 'admitted' THEN map_concat(users, MAP([user_id], [[asked + took, asked + took + 1800.0]])) ELSE users END FROM (
  SELECT o.n, o.room, o.event_id, o.day, o.user_id, o.asked, o.took, users, CASE WHEN g.day = o.day THEN used ELSE 0 END AS used,
    CASE WHEN o.asked < coalesce(users[o.user_id][1], 0) THEN 'running' WHEN o.asked < coalesce(users[o.user_id][2], 0) THEN 'cooldown' WHEN CASE WHEN g.day = o.day THEN used ELSE 0 END >= 40 THEN 'cap' ELSE 'admitted' END AS verdict
  FROM g JOIN o ON o.room = g.room AND o.n = g.n + 1))
SELECT room, event_id, verdict FROM g WHERE n > 0""")
def room_gate(spark, sf_dir):
    return stores.replayed_room_gate(requests(spark, sf_dir), 1800.0, 40)


@query("""WITH o AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(role) OVER w AS r, lag(turn) OVER w AS t, lag(coalesce(text, '')) OVER w AS q FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, t AS turn, row_number() OVER w AS age, sum(length(q) + length(text)) OVER w AS upto FROM o WHERE role <> 'user' AND r = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, CAST(age AS INTEGER) AS age FROM p WHERE age = 1 OR 2 * age <= 4 AND upto <= 700""")
def conversation_pairs(spark, sf_dir):
    return stores.kept_pairs(table(spark, sf_dir, "conversations"), 4, 700)
