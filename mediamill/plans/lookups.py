"""Queries over nested payloads, lookups in turn, aligned series and presence in rooms: events, orders and parts play the payloads and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import alignment, fallback, nested, search
from ..operators.lineage import spread
from ..streaming import presence
from .registry import Tables, query
from .series import millis, seconds


def _in_sections(node: Column, depth: Column) -> Column:
    """A JSON node within so many sections, each an object with a list."""
    return F.concat(F.repeat(F.lit('{"about":{"n":1},"section":{"contents":[null,'), depth), node, F.repeat(F.lit("]}}"), depth))


def video_pages(events: DataFrame) -> DataFrame:
    """(page, body): search responses of up to 200 events each, as nested JSON: live and coming videos, repeated addresses, videos inside videos, cut-off bodies."""
    e, i = F.col, F.col("event_id")
    text = lambda c: F.struct(c.alias("simpleText"))
    runs = F.array(F.struct(e("event_type").alias("text")), F.struct(F.concat(F.lit(" "), i.cast("string")).alias("text")))
    title = F.struct(F.when(i % 2 == 0, F.concat_ws(" ", "event_type", i.cast("string"))).alias("simpleText"), F.when(i % 2 == 1, runs).alias("runs"))
    name = F.concat(F.lit("user "), e("user_id").cast("string"))
    length = F.concat(F.floor(i % 3600 / 60).cast("string"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"))
    video = F.struct(
        F.when(i % 13 != 0, F.concat(F.lit("v"), (i * 7 % 90).cast("string"))).alias("videoId"),
        title.alias("title"),
        F.when(i % 5 != 0, text(name)).alias("ownerText"),
        text(F.concat(F.lit("by "), name)).alias("longBylineText"),
        F.when(i % 11 != 0, text(length)).alias("lengthText"),
        F.struct(F.array(F.struct(F.concat(F.lit("http://pictures.example.com/"), i.cast("string")).alias("url"))).alias("thumbnails")).alias("thumbnail"),
        F.when(e("event_type") == "error", F.array(F.struct(F.struct(F.lit("BADGE_STYLE_TYPE_LIVE_NOW").alias("style")).alias("metadataBadgeRenderer")))).alias("badges"),
        F.when(e("event_type") == "signup", F.struct(F.lit("1").alias("startTime"))).alias("upcomingEventData"),
        F.when(i % 7 == 0, F.struct(F.struct(F.lit("inner").alias("videoId"), text(F.lit("inner")).alias("title")).alias("videoRenderer"))).alias("menu"),
    )
    node = _in_sections(F.concat(F.lit('{"videoRenderer":'), F.to_json(video), F.lit("}")), (i % 6).cast("int"))
    # nodes are made in rows dealt by page, above a generator: inside the aggregate they would be worked out expression by expression
    made = spread(events.select(F.floor(i / 200).alias("page"), "event_id", "event_type", "user_id"), "page").select("page", F.inline(F.array(F.struct("event_id", node.alias("node")))))
    pages = made.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "node"))), lambda n: n.node), ",").alias("nodes"))
    body = F.concat(F.lit('{"contents":{"primary":['), F.col("nodes"), F.lit("]}}"))
    return pages.select("page", F.when(F.col("page") % 10 == 9, F.substring(body, 1, 500)).otherwise(body).alias("body"))


@query(
    """WITH v AS (SELECT event_id // 200 AS page, 'https://www.youtube.com/watch?v=v' || (event_id * 7 % 90) AS url, min(event_id) AS i FROM events
        WHERE event_type NOT IN ('error', 'signup') AND event_id % 13 <> 0 AND event_id // 200 % 10 <> 9 GROUP BY 1, 2)
    SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY i) AS INTEGER) AS ord, url, event_type || ' ' || i AS title, CASE WHEN i % 5 = 0 THEN 'by ' ELSE '' END || 'user ' || user_id AS channel,
        CASE WHEN i % 11 <> 0 THEN CAST(i % 3600 * 1000 AS BIGINT) END AS duration_ms, 'http://pictures.example.com/' || i AS thumbnail FROM v JOIN events ON event_id = i"""
)
def q_nested_videos(t: Tables) -> DataFrame:
    return nested.videos(video_pages(t.events), "page", "body")


#: Of the log's slow events: six hours of silence, a day until a guest is gone.
_SILENT, _GONE = 21_600_000, 86_400_000


def messages(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "join").when(F.col("event_type") == "purchase", "leave").when((F.col("event_type") == "error") & (F.col("event_id") % 40 == 0), "kick").otherwise("frame")
    return events.select(F.col("user_id").alias("phone"), F.col("ts").cast("timestamp").alias("at"), millis().alias("at_ms"), F.col("event_id").alias("seq"), kind.alias("kind"))


@query(
    f"""WITH RECURSIVE m AS (
        SELECT user_id AS phone, epoch_us(ts) // 1000 AS t, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'join' WHEN event_type = 'purchase' THEN 'leave' WHEN event_type = 'error' AND event_id % 40 = 0 THEN 'kick' ELSE 'frame' END AS kind,
            row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events
        UNION ALL SELECT user_id, CAST(1152921504606846976 AS BIGINT), NULL, 'end', count(*) + 1 FROM events GROUP BY 1
    ), w AS (
        SELECT phone, CAST(0 AS BIGINT) AS i, 'away' AS status, CAST(0 AS BIGINT) AS since, false AS removed, CAST([] AS STRUCT(t BIGINT, seq BIGINT, what VARCHAR)[]) AS told FROM m GROUP BY phone
        UNION ALL
        SELECT phone, i, CASE kind WHEN 'join' THEN CASE WHEN removed THEN st ELSE 'live' END WHEN 'kick' THEN 'away' WHEN 'leave' THEN 'away' ELSE st END,
            CASE WHEN kind = 'join' AND NOT removed OR kind = 'frame' AND st = 'live' THEN t ELSE dropped END, removed OR kind = 'kick',
            list_filter([{{t: quiet, seq: NULL, what: CASE WHEN quiet <= t THEN 'silent' END}}, {{t: leaves, seq: NULL, what: CASE WHEN leaves <= t THEN 'gone' END}},
                {{t: t, seq: seq, what: CASE kind WHEN 'join' THEN CASE WHEN removed THEN 'refused' WHEN st = 'away' THEN 'joined' ELSE 'back' END WHEN 'kick' THEN CASE WHEN NOT removed THEN 'kicked' END WHEN 'leave' THEN CASE WHEN st <> 'away' THEN 'left' END END}}], lambda x: x.what IS NOT NULL)
        FROM (SELECT *, CASE WHEN leaves <= t THEN 'away' WHEN quiet <= t THEN 'dropped' ELSE status END AS st FROM (
            SELECT *, dropped + {_GONE} AS leaves FROM (
                SELECT m.*, w.status, w.removed, CASE WHEN w.status = 'live' THEN w.since + {_SILENT} END AS quiet, CASE WHEN w.status = 'live' AND w.since + {_SILENT} <= m.t THEN w.since + {_SILENT} WHEN w.status = 'dropped' THEN w.since END AS dropped
                FROM w JOIN m ON m.phone = w.phone AND m.i = w.i + 1)))
    ) SELECT phone, x.t AS at_ms, x.seq, x.what FROM (SELECT phone, unnest(told) AS x FROM w)"""
)
def q_presence(t: Tables) -> DataFrame:
    return presence.presence(messages(t.events), _SILENT, _GONE)


def _on(t: Tables, kind: str) -> DataFrame:
    """For each room the six-hour steps, and whether at least two such events fall in them."""
    hop = F.floor((seconds() - F.lit(1704067200)) / 21600)
    return t.events.groupBy((F.col("user_id") % 7).alias("room"), hop.alias("hop")).agg((F.count_if(F.col("event_type") == kind) >= 2).alias("on"))


_ROOMS = """WITH h AS (SELECT user_id % 7 AS room, CAST((epoch_us(ts) // 1000000 - 1704067200) // 21600 AS BIGINT) AS hop, count(*) FILTER (event_type = 'click') >= 2 AS a, count(*) FILTER (event_type = 'view') >= 2 AS b FROM events GROUP BY 1, 2),
    s AS (SELECT x.room, CAST(y.hop - x.hop AS INTEGER) AS lag, count(*) AS n, count(*) FILTER (x.a AND y.b) AS n11, count(*) FILTER (x.a) AS n1x, count(*) FILTER (y.b) AS nx1 FROM h x JOIN h y ON x.room = y.room AND y.hop - x.hop BETWEEN -40 AND 80 GROUP BY 1, 2),
    p AS (SELECT room, lag, round(CASE WHEN n < 20 OR n1x = 0 OR n1x = n OR nx1 = 0 OR nx1 = n THEN 0.0 ELSE CAST(n * n11 - n1x * nx1 AS DOUBLE) / sqrt(CAST(n1x * (n - n1x) * nx1 * (n - nx1) AS DOUBLE)) END, 6) AS phi FROM s)"""


@query(_ROOMS + " SELECT room, lag, phi FROM p")
def q_phi_by_room(t: Tables) -> DataFrame:
    return alignment.phi_at_lags(_on(t, "click"), _on(t, "view"), -40, 80, 20, "room")


@query(
    _ROOMS
    + """, k AS (SELECT *, phi >= max(phi) OVER (PARTITION BY room ORDER BY lag RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS peak, max({phi: phi, lag: lag}) OVER (PARTITION BY room) AS best FROM p)
    SELECT room, first(best).lag AS lag, first(best).phi AS phi FROM k GROUP BY room HAVING first(best).phi >= 0.05 AND coalesce(max(phi) FILTER (peak AND abs(lag - best.lag) > 5), 0) < first(best).phi * 0.97"""
)
def q_clear_offsets(t: Tables) -> DataFrame:
    scores = alignment.phi_at_lags(_on(t, "click"), _on(t, "view"), -40, 80, 20, "room")
    return alignment.clear_offsets(scores, "room", least=0.05, rival=0.97, reach=5)


@query(
    """SELECT o.o_orderkey AS id, CASE WHEN l.v IS NOT NULL THEN 'line' WHEN c.c_acctbal > 5000 THEN 'customer' WHEN c.c_nationkey < 10 THEN 'nation' ELSE 'none' END AS source,
        CASE WHEN l.v IS NOT NULL THEN l.v WHEN c.c_acctbal > 5000 THEN c.c_acctbal WHEN c.c_nationkey < 10 THEN CAST(c.c_nationkey AS DOUBLE) END AS answer
    FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS v FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1) l ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey"""
)
def q_answers_in_turn(t: Tables) -> DataFrame:
    by_line = lambda open_: t.lineitem.where("l_discount >= 0.09").join(open_.select("id"), F.col("l_orderkey") == F.col("id"), "left_semi").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_extendedprice").alias("answer"))
    at = lambda open_: open_.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    by_customer = lambda open_: at(open_).where("c_acctbal > 5000").select("id", F.col("c_acctbal").alias("answer"))
    by_nation = lambda open_: at(open_).where("c_nationkey < 10").select("id", F.col("c_nationkey").cast("double").alias("answer"))
    questions = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey")
    return fallback.answer_in_turn(questions, "id", [("line", by_line), ("customer", by_customer), ("nation", by_nation)], "none")


def _service(t: Tables) -> DataFrame:
    """Hits of a lyrics service: parts; of two thirds the lyrics have time stamps, of every fifth title and singer are the wrong way round."""
    synced = F.concat(F.lit("[00:01.00]"), F.col("p_type"), F.lit("\n[00:05.00]"), F.col("p_name"))
    turned = F.col("p_partkey") % 5 == 0
    title, singer = F.col("p_name"), F.col("p_brand")
    return t.part.select(F.when(turned, singer).otherwise(title).alias("hit_title"), F.when(turned, title).otherwise(singer).alias("hit_artist"), (F.col("p_size") * 10.0).alias("hit_length"), F.when(F.col("p_partkey") % 3 != 0, synced).otherwise(F.col("p_type")).alias("lyrics"), F.col("p_partkey").alias("ord"))


@query()
def q_best_synced(t: Tables) -> DataFrame:
    wanted = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), (F.col("p_size") * 10.0).alias("length"))
    return search.best_synced(wanted, _service(t))


@query()
def q_find_lyrics(t: Tables) -> DataFrame:
    embedded = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("[00:02.00]"), F.col("p_name"))).when(F.col("p_partkey") % 4 == 1, F.col("p_name"))
    songs = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), (F.col("p_size") * 10.0).alias("length"), embedded.alias("embedded"))
    return fallback.find_lyrics(songs, _service(t), search.best_synced)
