"""Queries over what services and downloads answer, and over the small rules about it: tables play the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import payloads as p
from ..operators import catalogue as c, timeline as tl
from ..operators.lineage import spread
from .registry import Tables, query
from .series import millis


@query(
    """WITH v AS (SELECT p_size AS q, 'https://v.example.com/' || (p_partkey % 60) AS url, min(p_partkey) AS i FROM part WHERE p_partkey % 7 NOT IN (0, 1) AND p_partkey % 9 <> 4 GROUP BY 1, 2)
    SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY i) AS INTEGER) AS ord, url, CASE WHEN i % 5 = 0 THEN 'Unknown song' ELSE p_name END AS title, CASE WHEN i % 3 = 0 THEN p_type ELSE p_brand END AS channel,
        CASE WHEN i % 4 > 0 THEN CAST(round(p_retailprice * 1000) AS BIGINT) END AS duration_ms, CASE WHEN i % 2 = 0 THEN 'https://i.example.com/' || i ELSE 'https://j.example.com/' || i END AS thumbnail FROM v JOIN part ON p_partkey = i"""
)
def q_found_videos(t: Tables) -> DataFrame:
    """A search per size of part: its parts as lines, some cut off, some live, some without an address."""
    i = F.col("p_partkey")
    body = F.to_json(
        F.struct(
            F.when(i % 9 != 4, F.concat(F.lit("https://v.example.com/"), (i % 60).cast("string"))).alias("url"),
            F.when(i % 5 != 0, F.col("p_name")).alias("title"),
            F.when(i % 3 != 0, F.col("p_brand")).alias("channel"),
            F.col("p_type").alias("uploader"),
            F.when(i % 4 > 0, F.col("p_retailprice")).alias("duration"),
            F.when(i % 2 == 0, F.concat(F.lit("http://i.example.com/"), i.cast("string"))).alias("thumbnail"),
            F.array(F.struct(F.concat(F.lit("https://j.example.com/"), i.cast("string")).alias("url"))).alias("thumbnails"),
            F.when(i % 7 == 1, "is_live").otherwise("not_live").alias("live_status"),
        )
    )
    line = F.when(i % 7 == 0, F.substring(body, 1, 30)).otherwise(body)
    return p.found_videos(t.part.select(F.col("p_size").alias("q"), i.alias("n"), line.alias("line")), "q", "n", "line")


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 8 > 0 THEN '/m/' || p_partkey END AS path, CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS name,
        CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 3 > 0 THEN p_brand WHEN p_partkey % 2 = 0 THEN 'A ' || p_brand ELSE 'Owner' END AS singer, CASE WHEN p_partkey % 8 > 0 THEN CAST(round(p_retailprice) AS BIGINT) ELSE -1 END AS duration_s,
        p_partkey % 8 > 0 AND p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS sure FROM part"""
)
def q_fetched(t: Tables) -> DataFrame:
    i = F.col("p_partkey")
    record = F.struct(
        F.when(i % 8 > 0, F.concat(F.lit("/m/"), i.cast("string"))).alias("filepath"),
        F.concat("p_brand", F.lit(" - "), "p_name", F.lit(" (Official Video) [HD]")).alias("title"),
        F.lit("Owner").alias("uploader"),
        F.when(i % 3 == 0, F.col("p_type")).alias("track"),
        F.when(i % 2 == 0, F.concat(F.lit("A "), "p_brand")).alias("artist"),
        F.col("p_retailprice").alias("duration"),
    )
    found = p.fetched(spread(t.part).select(i.alias("id"), F.to_json(record).alias("line")), "line")
    return found.select("id", "path", "name", "singer", F.coalesce("duration_s", F.lit(-1)).alias("duration_s"), F.coalesce(F.size("guesses") == 0, F.lit(False)).alias("sure"))


@query("SELECT p_partkey AS id, p_name AS hit_title, p_brand || CASE WHEN p_size % 2 = 0 THEN ' & ' || p_type ELSE '' END AS hit_artist, CAST(p_retailprice AS DOUBLE) AS hit_length FROM part WHERE p_partkey % 6 > 0")
def q_recordings(t: Tables) -> DataFrame:
    credit = lambda name, join: F.struct(name.alias("name"), join.alias("joinphrase"))
    two = F.when(F.col("p_size") % 2 == 0, F.array(credit(F.col("p_brand"), F.lit(" & ")), credit(F.col("p_type"), F.lit("")))).otherwise(F.array(credit(F.col("p_brand"), F.lit(None).cast("string"))))
    body = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("title"), (F.col("p_retailprice") * 1000).alias("length"), two.alias("artist-credit"))).alias("recordings")))
    rows = t.part.select(F.col("p_partkey").alias("id"), p.recordings(F.when(F.col("p_partkey") % 6 > 0, body).otherwise("busy")).alias("hits"))
    return rows.select("id", F.inline("hits")).withColumn("hit_length", F.round("hit_length", 6))


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(list_extract(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), -1), '\.[^.]*$', ''), '[-_]+', ' ', 'g')) AS title, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^(www\.)+', '') AS channel FROM pages"""
)
def q_file_preview(t: Tables) -> DataFrame:
    return t.pages.select("page_id", p.file_preview(F.col("url")).alias("f")).select("page_id", "f.*")


@query("SELECT conv_id, CAST(count(*) AS INTEGER) AS n, max(turn) * 1000 AS last_ms, count(*) FILTER (role = 'user') AS voices FROM conversations GROUP BY 1")
def q_lines_json(t: Tables) -> DataFrame:
    """Each conversation's turns as lyric lines, kept as JSON and read again."""
    none = F.array().cast("array<struct<start_ms:long,end_ms:long,text:string>>")
    line = F.struct((F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + 500).alias("end_ms"), "text", none.alias("words"), F.when(F.col("role") == "user", "M").alias("voice"))
    kept = t.conversations.groupBy("conv_id").agg(p.lines_to_json(F.array_sort(F.collect_list(line))).alias("lines"))
    lines = p.lines_of_json(F.col("lines"))
    return kept.select("conv_id", F.size(lines).alias("n"), F.array_max(F.transform(lines, lambda x: x.start_ms)).alias("last_ms"), F.size(F.filter(lines, lambda x: x.voice.isNotNull())).cast("long").alias("voices"))


@query(
    """SELECT event_id, event_id % 5 = 0 AS same, event_id % 3 = 1 AS dev, CASE event_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'image/jpeg' END AS picture,
        CASE event_id % 4 WHEN 0 THEN 'a.jpg' WHEN 1 THEN 'a.png' END AS artwork FROM events"""
)
def q_request_rules(t: Tables) -> DataFrame:
    i = F.col("event_id")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (i % n + 1).cast("int"))
    return t.events.select(
        "event_id",
        p.same_origin(pick(5, "https://Mac.local", "http://mac.local", "https://other", "https://mac.local.evil", None), F.lit("mac.local")).alias("same"),
        p.dev_path(pick(3, "x", "/x", "//host/x")).alias("dev"),
        p.picture_kind(pick(6, "a.png", "a.webp", "a.jpg", "../a.png", ".png", "a")).alias("picture"),
        p.kept_artwork(pick(4, "image/jpeg; q=1", "image/png", "text/html", None), F.lit("a")).alias("artwork"),
    )


@query("SELECT l_orderkey AS audio_hash, CAST(l_linenumber AS BIGINT) AS model_id, CAST(l_quantity AS BIGINT) AS chunks_total, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS chunks_done, CASE WHEN l_returnflag = 'R' THEN 'ready' ELSE 'running' END AS status, CASE WHEN l_returnflag = 'R' THEN 77 END AS last_used_at FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity DESC, l_returnflag)")
def q_finish(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("audio_hash"), F.col("l_linenumber").cast("long").alias("model_id")).agg(F.min_by(F.struct("l_quantity", "l_returnflag"), F.struct(-F.col("l_quantity"), F.col("l_returnflag"))).alias("l"))
    rows = lines.select("audio_hash", "model_id", F.col("l.l_quantity").cast("long").alias("chunks_total"), F.lit(0).cast("long").alias("chunks_done"), F.lit("running").alias("status"), F.lit(None).cast("long").alias("last_used_at"))
    return c.finish(rows, lines.where("l.l_returnflag = 'R'").select("audio_hash", "model_id"), 77)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def q_may_start(t: Tables) -> DataFrame:
    queued = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("track_id"))
    sources = t.events.select(F.col("user_id").alias("track_id"), F.when(F.col("event_type") == "purchase", "hash").alias("audio_hash"))
    return c.may_start(t.customer.select(F.col("c_custkey").alias("id")), queued, sources)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def q_rows_of(t: Tables) -> DataFrame:
    """All orders of rich customers, by keys that must be there."""
    rich = t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    buyers = rich.join(t.orders.select("o_custkey").distinct(), "o_custkey", "left_semi")
    return c.rows_of(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), buyers)


@query(
    """WITH r AS (SELECT user_id, event_id AS o, epoch_us(ts) // 1000 AS t, CAST(floor(value) AS BIGINT) AS n FROM events),
    f AS (SELECT *, coalesce(n < min(n) OVER (PARTITION BY user_id ORDER BY t, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM r),
    e AS (SELECT user_id, max({t: t, o: o, n: n}) FILTER (fresh) AS a, max({t: t, o: o, n: n}) AS b FROM f GROUP BY 1)
    SELECT user_id, CASE WHEN b.n > a.n THEN round((b.t - a.t) / CAST(b.n - a.n AS DOUBLE), 6) END AS rate FROM e"""
)
def q_progress_rate(t: Tables) -> DataFrame:
    reports = t.events.select("user_id", millis().alias("t"), F.floor("value").alias("n"), "event_id")
    return tl.arrival_rate(reports, "user_id", "t", "n", "event_id").withColumn("rate", F.round("rate", 6))
