"""Queries over command logs and stateful folds: events play the commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import playqueue
from ..streaming import delays, rooms
from .registry import Tables, query


@query()
def q_queue_fold(t: Tables) -> DataFrame:
    ops = {"click": "add", "view": "next", "purchase": "finish", "error": "remove_track", "signup": "skip"}
    op = F.create_map(*[F.lit(x) for pair in ops.items() for x in pair])[F.col("event_type")]
    commands = t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 11).alias("track"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("to"), F.lit(1).cast("long").alias("delta"))
    return playqueue.fold(commands)


@query(
    """WITH RECURSIVE k AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS now_ms, event_type <> 'error' AS good, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
    w AS (
        SELECT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS now_ms, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS until, CAST(-1 AS BIGINT) AS seen, '' AS verdict FROM k GROUP BY 1
        UNION ALL
        SELECT user_id, event_id, now_ms, i, CASE verdict WHEN 'closed' THEN wrong WHEN 'wrong' THEN CASE WHEN wrong >= 4 THEN 0 ELSE wrong + 1 END ELSE 0 END, CASE WHEN verdict = 'wrong' AND wrong >= 4 THEN now_ms + 10000 ELSE until END,
            CASE WHEN verdict IN ('back', 'joined') THEN now_ms ELSE seen END, verdict
        FROM (SELECT k.*, w.wrong, w.until, w.seen, CASE WHEN good AND w.seen >= 0 AND k.now_ms - w.seen <= 120000 THEN 'back' WHEN k.now_ms < w.until THEN 'closed' WHEN good THEN 'joined' ELSE 'wrong' END AS verdict FROM w JOIN k ON k.user_id = w.user_id AND k.i = w.i + 1)
    ) SELECT user_id, event_id, now_ms, verdict FROM w WHERE i > 0"""
)
def q_room_sessions(t: Tables) -> DataFrame:
    joins = t.events.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"), "event_id", (F.col("event_type") != "error").alias("good_code"))
    return rooms.admissions(joins)


@query()
def q_jitter(t: Tables) -> DataFrame:
    frames = t.events.select(F.col("user_id").cast("string").alias("phone"), F.col("event_id").alias("seq"), (F.unix_millis(F.col("ts").cast("timestamp")) % 86400000 / 1000.0).alias("arrive_ms"), F.col("value").alias("length_ms"))
    return delays.delays(frames)
