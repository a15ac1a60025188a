"""Queries over small column rules and web payloads built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import shapes as s
from ..operators import catalogue as c
from .registry import Tables, query


@query("SELECT p_partkey AS id, p_size % 360 AS a, (p_size + 137) % 360 AS b, (p_size + 211) % 360 AS c FROM part")
def q_hues(t: Tables) -> DataFrame:
    h = s.hues(F.col("p_size"))
    return t.part.select(F.col("p_partkey").alias("id"), *[h[i].alias(n) for i, n in enumerate("abc")])


@query("SELECT o_orderkey AS id, starts_with(o_orderpriority, '1-') AS user, CASE WHEN starts_with(o_orderpriority, '1-') OR o_orderstatus <> 'P' THEN o_orderpriority ELSE 'Imported' END AS shown FROM orders")
def q_display_name(t: Tables) -> DataFrame:
    user = F.col("o_orderpriority").startswith("1-")
    return t.orders.select(F.col("o_orderkey").alias("id"), user.alias("user"), F.when(user | (F.col("o_orderstatus") != "P"), F.col("o_orderpriority")).otherwise("Imported").alias("shown"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN (event_id % 256) BETWEEN 16 AND 31 WHEN 2 THEN false WHEN 3 THEN true ELSE event_id % 2 = 0 END AS lan FROM events")
def q_lan_addresses(t: Tables) -> DataFrame:
    n, octet = F.col("event_id") % 5, (F.col("event_id") % 256).cast("string")
    ip = (
        F.when(n == 0, F.concat(F.lit("10.1.2."), octet)).when(n == 1, F.concat(F.lit("172."), octet, F.lit(".0.1"))).when(n == 2, F.concat(F.lit("8.8.8."), octet)).when(n == 3, F.concat(F.lit("::ffff:192.168.0."), octet)).otherwise(F.when(F.col("event_id") % 2 == 0, "fd00::1").otherwise("2001:db8::1"))
    )
    return t.events.select("event_id", s.is_lan(ip).alias("lan"))


@query("SELECT p_partkey AS id, p_name AS title, 'album:' || lower(p_brand) || ':' || lower(p_type) AS key FROM part")
def q_collection_keys(t: Tables) -> DataFrame:
    file = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("-_")), F.lit(".flac"))
    return t.part.select(F.col("p_partkey").alias("id"), s.file_title(file).alias("title"), s.collection_key("album", F.col("p_brand"), F.col("p_type")).alias("key"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' END AS ending FROM events")
def q_picture_ending(t: Tables) -> DataFrame:
    n = F.col("event_id") % 3
    return t.events.select("event_id", s.picture_ending(F.when(n == 0, "image/JPEG; q=1").when(n == 1, "image/png").otherwise("text/html")).alias("ending"))


@query("SELECT p_partkey AS id, p_brand AS singer, '\"' || p_name || '\\\"x\\\"' || '\"' AS quoted FROM part".replace("\\\\", "\\"))
def q_before_featured(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), s.before_featured(F.concat("p_brand", F.lit(" FT. somebody"))).alias("singer"), s.quoted(F.concat("p_name", F.lit('"x"'))).alias("quoted"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'zh-Hant' WHEN 1 THEN 'zh-Hans' WHEN 2 THEN 'ja' WHEN 3 THEN 'ko' WHEN 4 THEN 'es' ELSE 'en' END AS locale, doc_id || ' songs' AS label FROM documents")
def q_locale(t: Tables) -> DataFrame:
    tags = F.array(*[F.lit(x) for x in ("zh-TW", "zh-CN", "ja-JP", "ko", "es-419", "fr")])
    return t.documents.select("doc_id", s.locale_of(tags[(F.col("doc_id") % 6).cast("int")]).alias("locale"), s.template(F.lit("{n} songs"), F.col("doc_id")).alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 0 AS stale FROM lineitem")
def q_stale_files(t: Tables) -> DataFrame:
    ends = F.array(F.lit(".flac"), F.lit(".flac.part"), F.lit(".vocals.flac"))
    return t.lineitem.select("l_orderkey", "l_linenumber", s.stale_file(F.concat(F.lit("a/0001"), ends[F.col("l_linenumber") % 3])).alias("stale"))


@query("SELECT p_partkey AS id, p_name AS title, p_brand AS channel, CAST(p_size * 1500 AS BIGINT) AS duration_ms FROM part")
def q_oembed(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("author_name"), (F.col("p_size") * 1.5).alias("duration")))
    return t.part.select(F.col("p_partkey").alias("id"), s.preview(body).alias("p")).select("id", "p.*")


@query("SELECT p_partkey AS id, p_name || '|' || p_brand AS phrases FROM part")
def q_jsonp_phrases(t: Tables) -> DataFrame:
    body = F.format_string('cb(["q",[["%s",0],["%s",0]],{}])', "p_name", "p_brand")
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(s.phrases(body), "|").alias("phrases"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 3 THEN p_name || ' & ' || p_brand END AS titles FROM part")
def q_search_hits(t: Tables) -> DataFrame:
    body = F.format_string('{"code":%d,"data":{"result":[{"type":"video","title":"<em>%s</em> &amp; %s","bvid":"B"},{"type":"user","title":"x","bvid":"C"}]}}', F.when(F.col("p_partkey") % 4 == 3, -412).otherwise(0), "p_name", "p_brand")
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(F.transform(s.video_hits(body), lambda h: h.title), "|").alias("titles"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 256 END AS BIGINT) AS delay FROM events")
def q_gapless(t: Tables) -> DataFrame:
    tag = F.format_string(" 00000000 %08X 000003F0 %016X", F.col("event_id") % 256, F.col("event_id") % 3)
    return t.events.select("event_id", s.gapless(tag).delay.alias("delay"))


@query("SELECT event_id, round(2.0 * least(value, 100) / 100 * least(event_id % 150, 100) / 100, 6) AS gain, round(greatest(least((value - 20) / 30, 1.0), 0.0), 6) AS progress, CAST(greatest(floor((value - 10) / 10), 0) AS BIGINT) AS chunk FROM events")
def q_playback_numbers(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", F.round(s.voice_gain(F.col("value"), F.col("event_id") % 150), 6).alias("gain"), F.round(s.progress(F.col("value"), F.lit(20.0), F.lit(50.0)), 6).alias("progress"), s.chunk_at(F.col("value") - 10, 10).alias("chunk")
    )


@query("SELECT vec_id, CAST(round(greatest(least(CAST(embedding[1] AS DOUBLE), 1.0), -1.0) * 32767) AS INTEGER) AS sample, CAST(round(12 * log2((220 + vec_id % 600) / 440.0)) AS INTEGER) AS semitone FROM embeddings")
def q_quantise(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", s.to_i16(F.col("embedding")[0].cast("double")).alias("sample"), s.nearest_semitone(F.lit(220) + F.col("vec_id") % 600).alias("semitone"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_acctbal > 3 THEN 'restart' ELSE 'previous' END AS button FROM customer")
def q_blank_to_null(t: Tables) -> DataFrame:
    own = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name"))
    return t.customer.select(F.col("c_custkey").alias("id"), s.blank_to_null(own).alias("name"), s.previous_action(F.col("c_acctbal")).alias("button"))


@query("SELECT p_brand AS artist, count(*) AS n, arg_min(p_name, p_partkey) AS first_title, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY 1")
def q_group_by_artist(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("artist")).agg(F.count("*").alias("n"), F.min_by("p_name", "p_partkey").alias("first_title"), F.sum("p_size").alias("bytes"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderstatus = 'F'")
def q_hidden_items(t: Tables) -> DataFrame:
    hidden = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return c.without_keys(t.orders.where("o_orderstatus = 'F'"), hidden).select(F.col("o_orderkey").alias("id"))


@query("SELECT o_orderkey AS id FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS done FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND done >= n - 1")
def q_is_ready(t: Tables) -> DataFrame:
    chunks = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    return t.orders.where("o_orderstatus = 'F'").join(chunks, "o_orderkey").where("done >= n - 1").select(F.col("o_orderkey").alias("id"))


@query(
    """WITH a AS (SELECT p_brand AS k, p_name AS phrase, p_partkey AS ord FROM part WHERE p_size <= 25), b AS (SELECT p_brand AS k, upper(p_name) AS phrase, p_partkey + 1000000 AS ord FROM part WHERE p_size > 25),
    u AS (SELECT *, row_number() OVER (PARTITION BY k, lower(phrase) ORDER BY ord) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT k, phrase, ord FROM u WHERE r = 1 AND lower(phrase) <> 'small ring'"""
)
def q_phrase_merge(t: Tables) -> DataFrame:
    side = lambda cond, phrase, shift: t.part.where(cond).select(F.col("p_brand").alias("k"), phrase.alias("phrase"), (F.col("p_partkey") + shift).alias("ord"))
    both = side("p_size <= 25", F.col("p_name"), 0).unionByName(side("p_size > 25", F.upper("p_name"), 1000000))
    return c.distinct_by_first(both, F.struct("k", F.lower("phrase")), "ord").where(F.lower("phrase") != "small ring")


@query("SELECT c_nationkey AS scope, coalesce(max(CASE WHEN c_custkey = 17 THEN c_custkey END), arg_min(c_custkey, c_name)) AS selected FROM customer GROUP BY 1")
def q_keep_or_first(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_nationkey").alias("scope")).agg(F.coalesce(F.max(F.when(F.col("c_custkey") == 17, F.col("c_custkey"))), F.min_by("c_custkey", "c_name")).alias("selected"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE 'Customer#' || lpad(CAST(s_suppkey * 20 AS VARCHAR), 9, '0') NOT IN (SELECT c_name FROM customer)")
def q_ingest_once(t: Tables) -> DataFrame:
    address = F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 20).cast("string"), 9, "0"))
    return c.without_keys(t.supplier.withColumn("c_name", address), t.customer.select("c_name")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


@query("SELECT c_custkey AS id, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, substr(c_name, 1, 12) AS short FROM customer")
def q_digits_short(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), s.digits(F.col("c_name")).alias("digits"), s.short(F.concat(F.lit("  "), "c_name", F.lit(" ")), 12).alias("short"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1), '^((www|open)\.)+', '') AS host FROM pages")
def q_display_host(t: Tables) -> DataFrame:
    return t.pages.select("page_id", s.display_host(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1)).alias("host"))


@query("SELECT l_orderkey AS id, max(CASE WHEN l_linenumber = 2 THEN md5(CAST(l_linenumber AS VARCHAR)) END) AS digest FROM lineitem GROUP BY 1")
def q_manifest_digest(t: Tables) -> DataFrame:
    line = lambda n: F.concat(F.md5(n.cast("string").cast("binary")), F.lit("  file "), n.cast("string"))
    manifests = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), line), "\n").alias("manifest"))
    return manifests.select("id", s.digest_of(F.col("manifest"), F.lit("file 2")).alias("digest"))
