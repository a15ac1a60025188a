"""Queries over pasted links and over what becomes of requests: events and parts play both."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import links
from ..operators import outcomes
from .registry import Tables, query

_FORMS = """SELECT event_id, event_id % 10 AS form, 'x' || event_id AS v FROM events"""


def _pasted(t: Tables) -> DataFrame:
    v = F.concat(F.lit("x"), F.col("event_id").cast("string"))
    forms = ["youtu.be/{}?t=3", " https://m.YouTube.com/watch?list=a&v={} ", "http://youtube.com/shorts/{}/", "https://www.bilibili.com/video/{}/?spm=1&p=2", "https://open.spotify.com/track/{}", "files.example.com/a/{}.MP3", "https://example.org:8443/{}?q=1#top", "two words {}", "word{}", "https://localhost/{}"]
    text = F.element_at(F.array(*[F.concat(F.lit(f.split("{}")[0]), v, F.lit(f.split("{}")[1])) for f in forms]), (F.col("event_id") % 10 + 1).cast("int"))
    return t.events.select("event_id", text.alias("text"))


@query(
    f"""SELECT event_id, CASE form WHEN 0 THEN 'https://www.youtube.com/watch?v=' || v WHEN 1 THEN 'https://www.youtube.com/watch?v=' || v WHEN 2 THEN 'https://www.youtube.com/watch?v=' || v WHEN 3 THEN 'https://www.bilibili.com/video/' || v || '?p=2'
        WHEN 4 THEN 'https://open.spotify.com/track/' || v WHEN 5 THEN 'https://files.example.com/a/' || v || '.MP3' WHEN 6 THEN 'https://example.org:8443/' || v || '?q=1#top' END AS canonical,
        CASE WHEN form < 4 THEN 'extractable' WHEN form = 4 THEN 'streaming' WHEN form = 5 THEN 'audio file' WHEN form = 6 THEN 'unsupported' END AS verdict, CASE form WHEN 4 THEN 'linkStreaming' WHEN 6 THEN 'linkUnsupported' END AS problem FROM ({_FORMS})"""
)
def q_pasted_links(t: Tables) -> DataFrame:
    return _pasted(t).select("event_id", links.details(F.col("text")).alias("d")).select("event_id", "d.canonical", "d.verdict", "d.problem")


@query(
    f"""SELECT event_id, CASE WHEN form IN (4, 6) THEN 'rejected' WHEN form < 6 THEN 'link' ELSE 'text' END AS kind, CASE form WHEN 0 THEN 'youtu.be' WHEN 1 THEN 'm.youtube.com' WHEN 2 THEN 'youtube.com' WHEN 3 THEN 'bilibili.com' WHEN 4 THEN 'spotify.com' WHEN 5 THEN 'files.example.com' WHEN 6 THEN 'example.org' END AS host,
        form = 4 AS streaming FROM ({_FORMS})"""
)
def q_search_box(t: Tables) -> DataFrame:
    return _pasted(t).select("event_id", links.meant(F.col("text")).alias("m")).select("event_id", "m.kind", "m.host", F.coalesce("m.streaming", F.lit(False)).alias("streaming"))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 AND f.message IS NOT NULL THEN 'failed' ELSE 'ready' END AS status, CASE WHEN p_size % 2 = 0 THEN f.message END AS error
    FROM part LEFT JOIN (SELECT user_id, arg_max('error ' || event_id, event_id) AS message FROM events WHERE event_type = 'error' GROUP BY 1) f ON f.user_id = p_partkey"""
)
def q_note_failures(t: Tables) -> DataFrame:
    sources = t.part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("track_id"), (F.col("p_size") % 2 == 0).alias("selected"), F.lit("ready").alias("status"), F.lit(None).cast("string").alias("error"))
    failures = t.events.where("event_type = 'error'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("track_id"), F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("message"), F.lit("download").alias("problem"))
    return outcomes.note_failures(sources, failures).sources.select("id", "status", "error")


@query(
    """WITH m AS (SELECT user_id AS guest, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'player' WHEN event_type = 'error' THEN 'lyricsChanged' ELSE 'clock' END AS kind, CASE WHEN event_id % 9 > 0 THEN CAST(floor(value) AS BIGINT) % 3 END AS track_id FROM events),
    w AS (SELECT *, last_value(CASE WHEN kind = 'player' THEN track_id END IGNORE NULLS) OVER b AS asked, last_value(CASE WHEN kind = 'player' THEN {t: track_id} END IGNORE NULLS) OVER b AS now FROM m WINDOW b AS (PARTITION BY guest ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT guest, seq, track_id FROM w WHERE (kind = 'player' AND track_id IS NOT NULL AND track_id IS DISTINCT FROM asked) OR (kind = 'lyricsChanged' AND track_id = now.t)"""
)
def q_ask_once(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "player").when(F.col("event_type") == "error", "lyricsChanged").otherwise("clock")
    rows = t.events.select(F.col("user_id").alias("guest"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 9 > 0, F.floor("value") % 3).alias("track_id"))
    return outcomes.ask_once(rows)


@query(
    """SELECT vec_id AS track_id, label AS index, CASE WHEN vec_id % 5 = 0 THEN 'notPrepared' WHEN vec_id % 5 = 1 THEN 'partNotReady' END AS problem, CASE WHEN vec_id % 5 > 1 THEN round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) + 0.0 END AS total, CASE WHEN vec_id % 5 > 1 THEN 128 END AS n FROM embeddings"""
)
def q_parts_of(t: Tables) -> DataFrame:
    """Vectors as chunks: half of each is the vocals."""
    e = t.embeddings.withColumn("v", F.col("embedding").cast("array<double>")).withColumn("hash", F.concat(F.lit("h"), F.col("vec_id").cast("string")))
    wanted = e.select(F.col("vec_id").alias("track_id"), F.col("label").alias("index"))
    sources = e.select(F.col("vec_id").alias("track_id"), F.lit(True).alias("selected"), F.col("hash").alias("audio_hash"))
    half = F.transform("v", lambda x: x * 0.5)
    chunks = e.select(F.col("hash").alias("audio_hash"), F.when(F.col("vec_id") % 5 == 1, -1).otherwise(F.col("label")).alias("index"), half.alias("left"), half.alias("right"))
    mixes = e.select(F.col("hash").alias("audio_hash"), F.col("label").alias("index"), F.col("v").alias("left"), F.col("v").alias("right"))
    separations = e.select(F.when(F.col("vec_id") % 5 > 0, F.col("hash")).alias("audio_hash"))
    found = outcomes.parts_of(wanted, sources, separations, chunks, mixes)
    return found.select("track_id", "index", "problem", (F.round(F.aggregate("instrumental", F.lit(0.0), lambda a, x: a + x), 4) + 0.0).alias("total"), F.size("vocals").alias("n")).withColumn("n", F.when(F.col("n") > 0, F.col("n")))
