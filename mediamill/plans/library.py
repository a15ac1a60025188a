"""Queries over a library that changes: edits, upgrades, resumed work, other rates and scripts, unreadable rows, events for queued songs. Parts play the songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scripts
from ..operators import editing, migrations, resume, signals
from ..sources import quarantine
from ..streaming import fanout
from .registry import Tables, query

# ---- edits

_SHELVES = """WITH track AS (SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_type AS album FROM part),
    refs AS (SELECT DISTINCT 'artist' AS kind, 'artist:' || lower(artist) AS ref, artist AS name, CAST(NULL AS VARCHAR) AS subtitle FROM track UNION ALL
        SELECT DISTINCT 'album', 'album:' || lower(artist) || ':' || lower(album), album, artist FROM track),
    collection AS (SELECT CAST(row_number() OVER (ORDER BY kind, ref) AS BIGINT) AS id, * FROM refs),
    member AS (SELECT c.id AS collection_id, t.id AS track_id, CAST(row_number() OVER (PARTITION BY c.id ORDER BY t.id) - 1 AS BIGINT) AS position FROM track t JOIN collection c ON c.ref IN ('artist:' || lower(artist), 'album:' || lower(artist) || ':' || lower(album))),
    edit AS (SELECT p_partkey AS track_id, p_partkey AS ord, upper(p_name) AS title, CASE WHEN p_size % 7 > 0 THEN 'Brand#' || (p_size * 3 % 40) END AS artist, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Single' END AS album FROM part WHERE p_size >= 44),
    home AS (SELECT track_id, ord, 'playlist' AS kind, 'imported' AS ref, 'Imported' AS name, CAST(NULL AS VARCHAR) AS subtitle FROM edit
        UNION ALL SELECT track_id, ord, 'artist', 'artist:' || lower(artist), artist, NULL FROM edit WHERE artist IS NOT NULL
        UNION ALL SELECT track_id, ord, 'album', 'album:' || lower(coalesce(artist, '')) || ':' || lower(album), album, artist FROM edit),
    spelled AS (SELECT kind, ref, arg_max({n: name, s: subtitle}, ord) AS v, min(ord) AS first FROM home GROUP BY 1, 2),
    fresh AS (SELECT (SELECT max(id) FROM collection) + row_number() OVER (ORDER BY first, s.kind, s.ref) AS id, s.kind, s.ref, v.n AS name, v.s AS subtitle FROM spelled s ANTI JOIN collection c ON c.kind = s.kind AND c.ref = s.ref),
    shelf AS (SELECT c.id, c.kind, c.ref, coalesce(v.n, c.name) AS name, CASE WHEN v IS NULL THEN c.subtitle ELSE v.s END AS subtitle FROM collection c LEFT JOIN spelled s ON s.kind = c.kind AND s.ref = c.ref UNION ALL SELECT * FROM fresh),
    stay AS (SELECT * FROM member WHERE track_id NOT IN (SELECT track_id FROM edit)),
    asked AS (SELECT s.id AS collection_id, h.track_id, h.kind, row_number() OVER (PARTITION BY s.id ORDER BY h.ord, h.track_id) AS nth FROM home h JOIN shelf s ON s.kind = h.kind AND s.ref = h.ref),
    ends AS (SELECT collection_id, min(position) AS front, max(position) AS back FROM stay GROUP BY 1),
    members AS (SELECT * FROM stay UNION ALL SELECT a.collection_id, track_id, CASE WHEN kind = 'playlist' THEN coalesce(front - nth, 1 - nth) ELSE coalesce(back + nth, nth - 1) END FROM asked a LEFT JOIN ends e ON e.collection_id = a.collection_id)"""


def shelves(t: Tables) -> editing.Shelves:
    tracks = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"))
    home = editing.homes(tracks.withColumnRenamed("id", "track_id").withColumn("ord", F.col("track_id"))).where("kind <> 'playlist'")
    refs = home.select("provider", "kind", "provider_ref", "name", "subtitle").distinct()
    collections = refs.withColumn("id", F.row_number().over(Window.orderBy("kind", "provider_ref")).cast("long"))
    members = home.join(collections.select("id", "kind", "provider_ref"), ["kind", "provider_ref"]).select(F.col("id").alias("collection_id"), "track_id")
    return editing.Shelves(tracks, collections, members.withColumn("position", F.row_number().over(Window.partitionBy("collection_id").orderBy("track_id")) - 1))


def _edited(t: Tables) -> editing.Shelves:
    artist = F.when(F.col("p_size") % 7 > 0, F.concat(F.lit("Brand#"), (F.col("p_size") * 3 % 40).cast("string")))
    album = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("Single")
    edits = t.part.where("p_size >= 44").select(F.col("p_partkey").alias("track_id"), F.col("p_partkey").alias("ord"), F.upper("p_name").alias("title"), artist.alias("artist"), album.alias("album"))
    return editing.edit_info(shelves(t), edits)


@query(_SHELVES + " SELECT t.id, coalesce(e.title, t.title) AS title, CASE WHEN e.track_id IS NULL THEN t.artist ELSE e.artist END AS artist, CASE WHEN e.track_id IS NULL THEN t.album ELSE e.album END AS album FROM track t LEFT JOIN edit e ON e.track_id = t.id")
def q_edit_tracks(t: Tables) -> DataFrame:
    return _edited(t).tracks


@query(_SHELVES + " SELECT id, kind, ref AS provider_ref, name, subtitle FROM shelf WHERE kind = 'playlist' OR id IN (SELECT collection_id FROM members)")
def q_edit_collections(t: Tables) -> DataFrame:
    return _edited(t).collections.select("id", "kind", "provider_ref", "name", "subtitle")


@query(_SHELVES + " SELECT collection_id, track_id, CAST(position AS BIGINT) AS position FROM members")
def q_edit_members(t: Tables) -> DataFrame:
    return _edited(t).members


# ---- upgrades


def _named(tables: migrations.Tables) -> migrations.Tables:
    return {**tables, "customer": tables["customer"].withColumnsRenamed({"c_custkey": "id", "c_name": "name"})}


def _seeded(tables: migrations.Tables) -> migrations.Tables:
    return {**tables, "customer": tables["customer"].withColumn("art_seed", F.pmod(F.col("id") * 7919, F.lit(360)))}


def _split(tables: migrations.Tables) -> migrations.Tables:
    """Segments become a table of their own."""
    c = tables["customer"]
    segments = c.select(F.col("c_mktsegment").alias("name")).distinct().withColumn("id", F.row_number().over(Window.orderBy("name")))
    return {**tables, "segment": segments, "customer": c.join(F.broadcast(segments.select(F.col("id").alias("segment_id"), F.col("name").alias("c_mktsegment"))), "c_mktsegment", "left").drop("c_mktsegment")}


STEPS = [_named, _seeded, _split]


@query("SELECT c_custkey AS id, c_name AS name, c_custkey * 7919 % 360 AS art_seed, CAST(dense_rank() OVER (ORDER BY c_mktsegment) AS INTEGER) AS segment_id FROM customer")
def q_upgrade(t: Tables) -> DataFrame:
    return migrations.upgrade({"customer": t.customer, "orders": t.orders}, 0, STEPS)["customer"].select("id", "name", "art_seed", "segment_id")


# ---- resumed work, rates


@query("SELECT vec_id AS audio_hash, i AS index, CAST(len(x) AS INTEGER) AS n, round(list_sum(list_transform(x, lambda v: v::DOUBLE)), 4) + 0.0 AS total FROM (SELECT vec_id, i, embedding[i * 20 + 1 : i * 20 + 20] AS x FROM embeddings, range(0, 4) r(i) WHERE (vec_id + i) % 3 <> 0)")
def q_resume_missing(t: Tables) -> DataFrame:
    songs = t.embeddings.select(F.col("vec_id").alias("audio_hash"), F.col("embedding").cast("array<double>").alias("samples"))
    done = songs.select("audio_hash", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("index")).where((F.col("audio_hash") + F.col("index")) % 3 == 0)
    found = resume.separate_missing(songs, done, signals.silence, 20, 24, 16, 4)
    return found.select("audio_hash", "index", F.size("instrumental").alias("n"), (F.round(F.aggregate("instrumental", F.lit(0.0), lambda a, v: a + v), 4) + 0.0).alias("total"))


@query(
    """WITH s AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 + unnest(range(0, 64)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings), n AS (SELECT label, count(*) AS n FROM s GROUP BY 1),
    o AS (SELECT label, unnest(range(0, n * 147 // 160)) AS j FROM n), q AS (SELECT label, j, j * 160 // 147 AS i, (j * 160 % 147) / 147.0::DOUBLE AS t FROM o),
    x AS (SELECT q.*, coalesce(a.v, 0) AS a, b.v AS b, coalesce(c.v, 0) AS c, coalesce(d.v, 0) AS d FROM q LEFT JOIN s a ON a.label = q.label AND a.p = i - 1 JOIN s b ON b.label = q.label AND b.p = i LEFT JOIN s c ON c.label = q.label AND c.p = i + 1 LEFT JOIN s d ON d.label = q.label AND d.p = i + 2)
    SELECT label, j // 100 AS block, count(*) AS n, round(sum(((((d - a) * 0.5 + (b - c) * 1.5) * t + (a - b * 2.5 + c * 2.0 - d * 0.5)) * t + (c - a) * 0.5) * t + b), 4) + 0.0 AS total FROM x GROUP BY 1, 2"""
)
def q_cubic_rate(t: Tables) -> DataFrame:
    """48 kHz to 44.1 kHz over each label's vectors as one signal, summed by blocks of 100."""
    start = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1) * 64
    pieces = t.embeddings.select("label", start.cast("long").alias("start"), "embedding")
    out = resume.cubic(pieces, "label", "start", "embedding", 160, 147, 500).select("label", F.posexplode("samples").alias("k", "v"), "start")
    return out.groupBy("label", F.floor((F.col("start") + F.col("k")) / 100).alias("block")).agg(F.count("*").alias("n"), (F.round(F.sum("v"), 4) + 0.0).alias("total"))


# ---- scripts


@query(
    """WITH d AS (SELECT DISTINCT p_name FROM part WHERE length(p_name) % 2 = 0) SELECT p_partkey AS id, CASE WHEN d.p_name IS NOT NULL THEN '<' || reverse(part.p_name) || '>' ELSE upper(string_split(part.p_name, ' ')[1]) || ' ' || upper(string_split(part.p_name, ' ')[2]) END || ' mix' AS title
    FROM part LEFT JOIN d ON d.p_name = part.p_name"""
)
def q_converted_titles(t: Tables) -> DataFrame:
    """Titles by a dictionary of the parts' own words and of every second whole name: whole names come first."""
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("phrase")).distinct().withColumn("to", F.upper("phrase"))
    wholes = t.part.where("length(p_name) % 2 = 0").select(F.col("p_name").alias("phrase")).distinct().withColumn("to", F.concat(F.lit("<"), F.reverse("phrase"), F.lit(">")))
    convert = scripts.converter(words.unionByName(wholes))
    return t.part.select(F.col("p_partkey").alias("id"), convert(F.concat("p_name", F.lit(" mix"))).alias("title"))


# ---- unreadable rows


def _props(t: Tables) -> DataFrame:
    i, props = F.col("event_id") % 12, F.col("props")
    body = F.when(i == 0, F.substring(props, 1, 4)).when(i == 1, F.concat(F.lit("["), props, F.lit("]"))).when(i == 2, F.lit('{"k": "x"}')).when(i == 3, F.lit("{}")).when(i == 4, F.lit("  ")).when(i == 5, F.lit(None)).when(i == 6, F.lit('{"k": null}')).when(i == 7, F.lit("7")).otherwise(props)
    return t.events.select("event_id", body.alias("props"))


@query(
    """SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'notAnObject' WHEN 2 THEN 'wrongType:k' WHEN 3 THEN 'missing:k' WHEN 4 THEN 'empty' WHEN 5 THEN 'empty' WHEN 6 THEN 'missing:k' WHEN 7 THEN 'notAnObject' END AS reason,
        CASE WHEN event_id % 12 > 7 THEN CAST(props->>'$.k' AS BIGINT) END AS k FROM events"""
)
def q_sorted_out(t: Tables) -> DataFrame:
    """Good rows and dead ones together: their counts add up to the input."""
    good, dead = quarantine.sort_out(_props(t), "props", {"k": "bigint"}, ["k"])
    return good.select("event_id", F.lit(None).cast("string").alias("reason"), "k").unionByName(dead.select("event_id", "reason", F.lit(None).cast("bigint").alias("k")))


# ---- events for queued songs


@query("SELECT e.user_id AS track_id, e.event_id AS event, q.event_id AS entry FROM events e JOIN events q ON q.user_id = e.user_id AND q.event_type = 'signup' AND e.event_type = 'view' AND e.ts >= q.ts AND e.ts <= q.ts + INTERVAL 12 HOUR")
def q_for_queued(t: Tables) -> DataFrame:
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = e.where("event_type = 'view'").select(F.col("user_id").alias("track_id"), F.col("ts").alias("at"), F.col("event_id").alias("event"))
    queue = e.where("event_type = 'signup'").select(F.col("user_id").alias("track_id"), F.col("ts").alias("queued_at"), F.col("event_id").alias("entry"))
    return fanout.for_queued(events, queue, shown="12 hours").select("track_id", "event", "entry")
