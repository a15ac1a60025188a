"""What becomes of requests: failures noted, lyrics looked up again, parts of songs handed out, questions asked once."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import interleave
from .lineage import kept

#: Codes of what can go wrong here.
NOT_PREPARED, PART_NOT_READY = "notPrepared", "partNotReady"


class Noted(NamedTuple):
    sources: DataFrame
    events: DataFrame


def note_failures(sources: DataFrame, failures: DataFrame) -> Noted:
    """Sources (id, track_id, selected, status, error, ...) with the failures (seq, track_id, message, problem) of their songs, and an event for each failure.

    A song's selected source is marked failed with the message of the last failure (by seq); songs without a selected source only have the event.
    """
    last = failures.groupBy("track_id").agg(F.max_by("message", "seq").alias("_message"))
    hit = F.col("_message").isNotNull() & F.col("selected")
    news = {"status": F.lit("failed"), "error": F.col("_message")}
    marked = sources.join(last, "track_id", "left").select(*[F.when(hit, news[c]).otherwise(F.col(c)).alias(c) if c in news else F.col(c) for c in sources.columns])
    return Noted(marked, failures.select("seq", F.lit("failed").alias("event"), "track_id", "message", "problem"))


class Lyrics(NamedTuple):
    """Tables after lookups: lyrics (track_id, source, lyrics, fetched_at), sources, the edits that swapped names call for (track_id, ord, title, artist, album), events (track_id, event)."""

    lyrics: DataFrame
    sources: DataFrame
    edits: DataFrame
    events: DataFrame


def lyrics_due(lyrics: DataFrame, tracks: DataFrame, now_ms: int, retry_ms: int = 7 * 86_400_000) -> DataFrame:
    """Ids of tracks without lyrics, or for which none were found longer ago than ``retry_ms``."""
    known = lyrics.where((F.col("source") != "none") | (now_ms - F.col("fetched_at") <= retry_ms)).select(F.col("track_id").alias("id"))
    return tracks.select("id").join(known, "id", "left_anti")


def look_up_again(asked: DataFrame, tracks: DataFrame, lyrics: DataFrame, sources: DataFrame, find: Callable[[DataFrame], DataFrame], now_ms: int) -> Lyrics:
    """Lyrics of the asked tracks (track_id) looked up now, even where there are some.

    ``find`` answers songs (id, title, artist, length, embedded) with (id, source, lyrics, name, singer), as ``fallback.find_lyrics``. What
    it finds takes the place of the old lyrics; the timing that was set for those is forgotten, the user's too; names found by the
    swap become edits unless the user edited the song. Where nothing is found all stays. Tracks that aren't there drop out.
    """
    wanted = tracks.join(asked.select(F.col("track_id").alias("id")).distinct(), "id", "left_semi")
    songs = wanted.select("id", "title", "artist", (F.col("duration_ms") / 1000).alias("length"), F.lit(None).cast("string").alias("embedded"))
    found = kept(find(songs).where("source <> 'none'").withColumnRenamed("id", "track_id"))
    fresh = found.select("track_id", "source", "lyrics", F.lit(now_ms).cast("long").alias("fetched_at"))
    new_lyrics = lyrics.join(found.select("track_id"), "track_id", "left_anti").select("track_id", "source", "lyrics", "fetched_at").unionByName(fresh)
    timed = sources.join(found.select("track_id", F.lit(True).alias("_new")), "track_id", "left")
    reset = F.coalesce("_new", F.lit(False))
    news = {"offset_ms": F.lit(0).cast("long"), "manual": F.lit(False)}
    new_sources = timed.select(*[F.when(reset, news[c]).otherwise(F.col(c)).alias(c) if c in news else F.col(c) for c in sources.columns])
    moved = timed.where(reset & ((F.col("offset_ms") != 0) | F.col("manual"))).select("track_id").distinct()
    swapped = found.where("name is not null").join(wanted.where("not info_edited").select(F.col("id").alias("track_id"), "album"), "track_id")
    edits = swapped.select("track_id", F.col("track_id").alias("ord"), F.col("name").alias("title"), F.col("singer").alias("artist"), "album")
    told = lambda df, event: df.select("track_id", F.lit(event).alias("event"))
    return Lyrics(new_lyrics, new_sources, edits, told(found, "lyrics").unionByName(told(moved, "lyricOffset")).unionByName(told(edits, "renamed")))


def parts_of(wanted: DataFrame, sources: DataFrame, separations: DataFrame, chunks: DataFrame, mixes: DataFrame) -> DataFrame:
    """(track_id, index, vocals, instrumental, problem): parts of songs by their selected source, each interleaved; or why there is none.

    ``wanted`` (track_id, index), ``sources`` (track_id, selected, audio_hash), ``separations`` (audio_hash), ``chunks`` of vocals and ``mixes``
    of the whole, both (audio_hash, index, left, right). A song without audio or separation isn't prepared; one whose
    chunk isn't there yet has that part not ready. Only the wanted chunks' samples are read on.
    """
    chosen = sources.where("selected").select("track_id", "audio_hash")
    known = wanted.join(chosen, "track_id", "left").join(separations.select("audio_hash", F.lit(True).alias("_known")).distinct(), "audio_hash", "left")
    one = lambda df, name: df.select("audio_hash", "index", F.struct("left", "right").alias(name))
    rows = known.join(one(chunks, "v"), ["audio_hash", "index"], "left").join(one(mixes, "m"), ["audio_hash", "index"], "left")
    problem = F.when(F.col("_known").isNull(), NOT_PREPARED).when(F.col("v").isNull() | F.col("m").isNull(), PART_NOT_READY)
    n = F.least(F.size("v.left"), F.size("m.left"))
    rest = lambda side: F.zip_with(F.slice(f"m.{side}", F.lit(1), n), F.slice(f"v.{side}", F.lit(1), n), lambda a, b: a - b)
    fine = problem.isNull()
    return rows.select("track_id", "index", F.when(fine, interleave(F.col("v.left"), F.col("v.right"))).alias("vocals"), F.when(fine, interleave(rest("left"), rest("right"))).alias("instrumental"), problem.alias("problem"))


def ask_once(messages: DataFrame, guest: str = "guest", order: str = "seq") -> DataFrame:
    """(guest, seq, track_id): when each guest asks for lyrics, from messages (guest, seq, kind, track_id).

    A guest asks when the player's song becomes another than the one last asked for, and again when the current song's lyrics changed;
    a player without a song and news of other songs ask nothing. Windows see one guest's messages.
    """
    by = Window.partitionBy(guest).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    played = F.col("kind") == "player"
    rows = messages.withColumn("_now", F.last(F.when(played, F.struct("track_id")), ignorenulls=True).over(by)).withColumn("_asked", F.last(F.when(played, F.col("track_id")), ignorenulls=True).over(by))
    other = played & F.col("track_id").isNotNull() & ~F.col("_asked").eqNullSafe(F.col("track_id"))
    changed = (F.col("kind") == "lyricsChanged") & (F.col("track_id") == F.col("_now.track_id"))
    return rows.where(F.coalesce(other | changed, F.lit(False))).select(guest, order, "track_id")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that the seed alone decides, whatever their partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def join_code(draw: Column) -> Column:
    """Four digits from a number of two random bytes."""
    return F.lpad(F.pmod(draw, F.lit(10_000)).cast("string"), 4, "0")
