"""Not-modified revisits of a web archive: an as-of join by canonical URL to the latest earlier full response."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Headers that a 304 may bring up to date; all others stay those of the full response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning"]
#: Query parameters that don't tell pages apart.
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, tracking parameters and closing slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"\?(.*)$", 1), TRACKING, ""), r"^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _tag(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit (status 304): record_id, refers_to, verdict, headers.

    ``records`` has record_id long, url string, ts long, status int, headers map<string,string> with
    lower-case names. A revisit refers to the full response (status 200) of the same canonical URL
    with the largest earlier ts; of those of one ts, to the largest record_id. The verdict is
    ``resolved`` if validators agree (entity tags compared weakly, else last-modified), ``mismatch``
    if they differ, ``no validator`` if there is none to compare, ``unresolved`` without an earlier
    response. Headers are those of the response, with the permitted ones of the revisit in their
    place; only a resolved revisit has them. A null url or ts is unresolved; repeated revisits each
    get their row; other columns and statuses play no part.

    A URL may hold a third of all rows, so time is cut into spans: the best response of each URL and
    span is found first, the latest of all earlier spans is handed on to each span, and windows see
    one URL and span only. Bodies never shuffle.
    """
    rows = records.where("status in (200, 304)").select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), (F.col("status") == 200).alias("full"), F.map_entries("headers").alias("entries")
    )
    n, low, high = rows.agg(F.count("*"), F.min("ts"), F.max("ts")).first()
    spans = math.ceil(n / max(64, math.sqrt(n or 1))) or 1
    width = max(1, math.ceil(((high or 0) - (low or 0) + 1) / spans))
    rows = rows.withColumn("span", F.floor((F.col("ts") - F.lit(low or 0)) / width))
    best = F.when(F.col("full") & F.col("ts").isNotNull(), F.struct("ts", "record_id", "entries"))
    by_span = rows.where("key is not null and ts is not null").groupBy("key", "span").agg(F.max(best).alias("own"))
    before = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    handed = by_span.select("key", "span", F.max("own").over(before).alias("best")).where("best is not null")
    rows = rows.select("record_id", "key", "span", "ts", "full", "entries", best.alias("best"))
    handed = handed.select(F.lit(None).cast("long").alias("record_id"), "key", "span", F.col("best.ts").alias("ts"), F.lit(True).alias("full"), F.lit(None).cast(rows.schema["entries"].dataType).alias("entries"), "best")
    earlier = Window.partitionBy("key", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    # rows without a key or time have no partner; their ids deal them out
    known = rows.where("key is not null and ts is not null").unionByName(handed).withColumn("found", F.max("best").over(earlier)).where("not full")
    lost = rows.where("not full and (key is null or ts is null)").withColumn("found", F.lit(None).cast(rows.schema["best"].dataType))
    own, other = F.map_from_entries("entries"), F.map_from_entries("found.entries")
    tags, dates = (F.element_at(own, "etag"), F.element_at(other, "etag")), (F.element_at(own, "last-modified"), F.element_at(other, "last-modified"))
    agree = F.when(tags[0].isNotNull() & tags[1].isNotNull(), _tag(tags[0]) == _tag(tags[1])).when(dates[0].isNotNull() & dates[1].isNotNull(), dates[0] == dates[1])
    verdict = F.when(F.col("found").isNull(), "unresolved").when(agree.isNull(), "no validator").when(agree, "resolved").otherwise("mismatch")
    fresh = F.map_filter(own, lambda k, v: k.isin(PERMITTED))
    kept = F.map_filter(other, lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return known.unionByName(lost).select("record_id", F.col("found.record_id").alias("refers_to"), verdict.alias("verdict"), F.when(verdict == "resolved", F.map_concat(kept, fresh)).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log over ``pages``: each page's full response at an even time and a revisit of it some time later.

    Every seventh revisit carries another entity tag, every fifth none, every eleventh no validator.
    """
    page = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    when = F.concat(F.lit("day "), F.floor(page / 10).cast("string"))
    header = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    entries = lambda *e: F.map_from_entries(F.filter(F.array(*e), lambda x: x.value.isNotNull()))
    response = entries(header("content-type", F.lit("text/html")), header("etag", tag), header("last-modified", when), header("cache-control", F.concat(F.lit("max-age="), (page % 100).cast("string"))))
    etag = F.when((page % 11 == 0) | (page % 5 == 0), None).when(page % 7 == 0, F.lit('"changed"')).when(page % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    revisit = entries(
        header("content-length", F.lit("0")), header("etag", etag), header("last-modified", F.when(page % 11 != 0, when)), header("cache-control", F.concat(F.lit("max-age="), (page % 100 + 100).cast("string"))), header("date", F.concat(F.lit("t"), (page * 2 + 101).cast("string")))
    )
    full = pages.select((page * 2).alias("record_id"), "url", (page * 2).alias("ts"), F.lit(200).alias("status"), response.alias("headers"))
    return full.unionByName(pages.select((page * 2 + 1).alias("record_id"), "url", (page * 2 + 101).alias("ts"), F.lit(304).alias("status"), revisit.alias("headers")))


ORACLE = r"""
WITH bare AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
parts AS (SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    regexp_replace(regexp_replace(regexp_extract(u, '\?(.*)$', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '', 'g'), '^&', '') AS query FROM bare),
pg AS (SELECT page_id, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS key,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || CAST(page_id // 10 AS VARCHAR) AS day FROM parts),
pair AS (SELECT r.page_id, r.tag AS own_tag, r.day AS own_day, f.page_id AS other, f.tag AS other_tag, f.day AS other_day,
    row_number() OVER (PARTITION BY r.page_id ORDER BY f.page_id DESC NULLS LAST) AS n
    FROM pg r LEFT JOIN pg f ON f.key = r.key AND f.page_id * 2 < r.page_id * 2 + 101),
one AS (SELECT *, CASE WHEN page_id % 11 = 0 OR page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"changed"' ELSE own_tag END AS etag,
    CASE WHEN page_id % 11 <> 0 THEN own_day END AS modified FROM pair WHERE n = 1),
judged AS (SELECT *, CASE WHEN other IS NULL THEN 'unresolved'
    WHEN etag IS NOT NULL THEN CASE WHEN etag = other_tag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified = other_day THEN 'resolved' ELSE 'mismatch' END
    ELSE 'no validator' END AS verdict FROM one)
SELECT page_id * 2 + 1 AS record_id, other * 2 AS refers_to, verdict,
    CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=' || CAST(page_id % 100 + 100 AS VARCHAR) || chr(10) || 'content-type: text/html' || chr(10)
        || 'date: t' || CAST(page_id * 2 + 101 AS VARCHAR) || chr(10) || 'etag: ' || CASE WHEN etag IS NULL THEN other_tag WHEN page_id % 2 = 0 THEN 'W/' || etag ELSE etag END || chr(10)
        || 'last-modified: ' || coalesce(modified, other_day) END AS headers
FROM judged"""
