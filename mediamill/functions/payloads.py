"""Answers of services and records of downloads as rows; lyric lines as JSON; requests and addresses as predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import names
from .shapes import file_title

_DUMP = "url string, title string, channel string, uploader string, duration double, thumbnail string, thumbnails array<struct<url:string>>, live_status string, unread string"
_INFO = "filepath string, title string, uploader string, artist string, track string, album string, tags array<string>, thumbnail string, duration double, unread string"
_RECORDINGS = "recordings array<struct<title:string,length:double,`artist-credit`:array<struct<name:string,joinphrase:string>>>>, unread string"
LINES = "array<struct<start_ms:long,end_ms:long,text:string,words:array<struct<start_ms:long,end_ms:long,text:string>>,voice:string>>"


def _read(text: Column, schema: str) -> Column:
    """The fields of a JSON object; null where it can't be read as them."""
    row = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unread"})
    return F.when(row.isNotNull() & row.unread.isNull() & F.trim(text).startswith("{"), row)


def found_videos(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, ord, url, title, channel, duration_ms, thumbnail) from a downloader's lines of JSON, one a video.

    Lines that can't be read, videos live or to come and those without an address drop out; of one address the first line counts.
    A missing title is "Unknown song", the channel else the uploader, the picture else the first of several, always by https.
    """
    d = lines.select(key, F.col(order).alias("place"), _read(F.col(line), _DUMP).alias("d")).where("d.url is not null and coalesce(d.live_status, '') not in ('is_live', 'is_upcoming')")
    picture = F.regexp_replace(F.coalesce("d.thumbnail", F.try_element_at("d.thumbnails", F.lit(1)).url), "^http://", "https://")
    hit = F.struct(F.coalesce("d.title", F.lit("Unknown song")).alias("title"), F.coalesce("d.channel", "d.uploader").alias("channel"), F.round(F.col("d.duration") * 1000).cast("long").alias("duration_ms"), picture.alias("thumbnail"))
    once = d.groupBy(key, "d.url").agg(F.min("place").alias("place"), F.min_by(hit, "place").alias("hit"))
    return once.select(key, F.row_number().over(Window.partitionBy(key).orderBy("place")).alias("ord"), "url", "hit.*")


def fetched(records: DataFrame, line: str) -> DataFrame:
    """``records`` with what a download's record says: path, name, singer, album, tags, thumbnail, guesses, duration_s; a record that can't be read or has no path has nulls.

    The music fields come before the video's title: a track names the song and its artist, else the uploader, the singer; without a track
    the cleaned title does. Guesses are needed only where not both are named; with a track alone their singers count.
    """
    info = "_info"
    rows = records.withColumn(info, _read(F.col(line), _INFO)).withColumn(info, F.when(F.col(info).filepath.isNotNull(), F.col(info)))
    i = F.col(info)
    rows = rows.withColumn("_video", F.when(i.isNotNull(), F.coalesce(i.title, F.lit("Unknown song")))).withColumn("_owner", i.uploader)
    rows = names.name_guesses(rows, "_video", "_owner", "_guesses")
    rows = rows.withColumn("_named", names.upload_names("_video", "_owner"))
    own = F.col("_named")
    name = F.when(i.track.isNotNull(), i.track).otherwise(own.title)
    singer = F.when(i.track.isNotNull(), F.coalesce(i.artist, i.uploader)).otherwise(own.artist)
    by_track = F.transform("_guesses", lambda g: F.struct(i.track.alias("title"), g.artist.alias("artist")))
    guesses = F.when(i.track.isNotNull() & i.artist.isNotNull(), F.slice("_guesses", 1, 0)).when(i.track.isNotNull(), F.array_distinct(by_track)).otherwise(F.col("_guesses"))
    made = {"path": i.filepath, "name": name, "singer": singer, "album": i.album, "tags": F.when(i.isNotNull(), F.coalesce(i.tags, F.array().cast("array<string>"))), "thumbnail": i.thumbnail, "guesses": guesses, "duration_s": F.when(i.isNotNull(), F.round(F.coalesce(i.duration, F.lit(0.0))).cast("long"))}
    return rows.select(*records.columns, *[c.alias(n) for n, c in made.items()])


def recordings(body: Column) -> Column:
    """An array of (hit_title, hit_artist, hit_length in seconds) from a catalogue's answer: an artist is all credited names with what joins them. Null where it can't be read."""
    credit = lambda r: F.coalesce(r["artist-credit"], F.array().cast("array<struct<name:string,joinphrase:string>>"))
    artist = lambda r: F.concat_ws("", F.transform(credit(r), lambda c: F.concat_ws("", c["name"], c.joinphrase)))
    return F.transform(_read(body, _RECORDINGS).recordings, lambda r: F.struct(r.title.alias("hit_title"), artist(r).alias("hit_artist"), (r.length / 1000).alias("hit_length")))


def file_preview(url: Column) -> Column:
    """(title, channel) of a direct link: the last part of its path as a title, its host."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.struct(file_title(F.element_at(F.split(path, "/"), -1)).alias("title"), F.nullif(F.regexp_replace(host, r"^(www\.)+", ""), F.lit("")).alias("channel"))


def lines_to_json(lines: Column) -> Column:
    """Lyric lines as they are kept; none as null."""
    return F.when(F.size(lines) > 0, F.to_json(lines))


def lines_of_json(text: Column) -> Column:
    """Kept lines; null text has none, text that can't be read is null."""
    return F.when(text.isNull(), F.array().cast(LINES)).otherwise(F.from_json(text, LINES))


def same_origin(origin: Column, host: Column) -> Column:
    """The page that asks is the one served here: https and the same host; a missing header is another's."""
    return F.coalesce(origin.startswith("https://") & (F.lower(F.substring(origin, 9, 1 << 20)) == F.lower(host)), F.lit(False))


def dev_path(path: Column) -> Column:
    """A path on this server, never another host."""
    return path.startswith("/") & ~path.startswith("//")


def picture_kind(name: Column) -> Column:
    """The media type of a song's picture; null for a name that could lead out of its folder."""
    ending = F.substring_index(name, ".", -1)
    return F.when(~name.rlike(r"[/\\]|^\."), F.when(ending.isin("png", "webp"), F.concat(F.lit("image/"), ending)).otherwise("image/jpeg"))


def kept_artwork(content_type: Column, path: Column) -> Column:
    """A downloaded picture's path with the ending of its media type; null if that isn't a picture's."""
    from .shapes import picture_ending

    return F.concat(path, F.lit("."), picture_ending(content_type))


def audio_track(tracks: Column) -> Column:
    """(index, duration_ms) of the first of tracks (codec, sample_rate, frames) that is audio."""
    numbered = F.transform(tracks, lambda t, i: F.struct(i.alias("index"), t.codec.alias("codec"), t.sample_rate.alias("sample_rate"), t.frames.alias("frames")))
    first = F.try_element_at(F.filter(numbered, lambda t: t.codec.isNotNull() & t.sample_rate.isNotNull()), F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["index"].alias("index"), F.floor(first.frames * 1000 / first.sample_rate).alias("duration_ms")))


def model_sizes(n_fft: int, hop: int, frames: int) -> dict[str, int]:
    """Samples that a model sees in a segment, that are dropped on either side, and that are left."""
    chunk, trim = hop * (frames - 1), n_fft // 2
    return {"chunk_size": chunk, "trim": trim, "gen_size": chunk - 2 * trim}


def interfaces_in_order(interfaces: DataFrame) -> DataFrame:
    """Network interfaces (name, ip): wired and wireless ones first, then by name and address."""
    return interfaces.orderBy(~F.col("name").startswith("en"), "name", "ip")


def with_missing(own: Column, wanted: Column) -> Column:
    """A certificate's addresses with the wanted ones that it lacks after them."""
    return F.array_union(own, wanted)
