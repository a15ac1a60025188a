"""Small column rules: keys, paths, addresses, web payloads, playback arithmetic. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Picture endings by media type.
PICTURES = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp", "image/gif": "gif"}


def hues(seed: Column) -> Column:
    """Three hues of a seed."""
    return F.array(seed % 360, (seed + 137) % 360, (seed + 211) % 360)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def is_lan(ip: Column) -> Column:
    """Private, link-local and loopback addresses of version 4, mapped ones too; local ones of version 6."""
    v4 = F.regexp_replace(F.lower(ip), "^::ffff:", "")
    part = F.split(v4, r"\.")
    octet = lambda i: F.try_element_at(part, F.lit(i)).try_cast("int")
    private = (octet(1) == 10) | (octet(1) == 127) | ((octet(1) == 172) & octet(2).between(16, 31)) | ((octet(1) == 192) & (octet(2) == 168)) | ((octet(1) == 169) & (octet(2) == 254))
    return F.when(v4.contains(":"), v4.rlike("^(::1$|f[cd]|fe[89ab])")).otherwise(F.coalesce(private, F.lit(False)))


def file_title(name: Column) -> Column:
    """``salt-and_static.flac`` as ``salt and static``."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[-_]+", " "))


def collection_key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.lower(p) for p in parts])


def picture_ending(kind: Column) -> Column:
    """The ending for a media type, its parameters apart; null for others."""
    bare = F.lower(F.trim(F.substring_index(kind, ";", 1)))
    return F.try_element_at(F.create_map(*[F.lit(x) for p in PICTURES.items() for x in p]), bare)


def before_featured(name: Column) -> Column:
    """The singer without those featured."""
    return F.trim(F.regexp_replace(name, "(?i) (feat\\. |feat |ft\\. |featuring ).*$", ""))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def locale_of(tag: Column) -> Column:
    """The interface language of a browser's tag."""
    low = F.lower(tag)
    return (
        F.when(low.rlike("^zh-(hant|tw|hk|mo)"), "zh-Hant").when(low.rlike("^zh"), "zh-Hans").when(low.rlike("^ja"), "ja").when(low.rlike("^ko"), "ko").when(low.rlike("^es"), "es").otherwise("en")
    )


def template(text: Column, n: Column) -> Column:
    return F.replace(text, F.lit("{n}"), n.cast("string"))


def stale_file(path: Column) -> Column:
    return path.rlike(r"(\.part|\.vocals\.flac|\.inst\.flac)$")


def gapless(tag: Column) -> Column:
    """(delay, padding) of a gapless tag: the second and third hexadecimal fields; null without a length."""
    part = F.split(F.trim(tag), r"\s+")
    hexed = lambda i: F.conv(F.try_element_at(part, F.lit(i)), 16, 10).cast("long")
    return F.when(F.coalesce(hexed(4), F.lit(0)) > 0, F.struct(hexed(2).alias("delay"), hexed(3).alias("padding")))


def preview(body: Column) -> Column:
    """Title, channel and milliseconds of an embed answer."""
    j = F.from_json(body, "title string, author_name string, duration double, thumbnail_url string")
    return F.struct(j.title.alias("title"), j.author_name.alias("channel"), F.round(j.duration * 1000).cast("long").alias("duration_ms"))


def phrases(body: Column) -> Column:
    """Phrases of a padded suggestion answer: what stands in the second element of the array after the first bracket."""
    inner = F.regexp_extract(body, r"^[^(]*\((.*)\)[^)]*$", 1)
    second = F.get_json_object(inner, "$[1]")
    return F.transform(F.from_json(second, "array<array<string>>"), lambda x: x[0])


def video_hits(body: Column) -> Column:
    """Video rows of a search answer, marks taken out of titles; null when its code isn't 0."""
    from .columns import plain

    j = F.from_json(body, "code int, data struct<result: array<struct<type: string, title: string, bvid: string>>>")
    return F.when(j.code == 0, F.transform(F.filter(j.data.result, lambda r: r.type == "video"), lambda r: F.struct(r.bvid.alias("id"), plain(r.title).alias("title"))))


def voice_gain(volume: Column, voice: Column) -> Column:
    return F.lit(2.0) * F.least(volume, F.lit(100)) / 100 * F.least(voice, F.lit(100)) / 100


def progress(at: Column, start: Column, end: Column) -> Column:
    """Share of a span that is over, 0 to 1; spans last a millisecond at least."""
    return F.greatest(F.least((at - start) / F.greatest(end - start, F.lit(0.001)), F.lit(1.0)), F.lit(0.0))


def chunk_at(seconds: Column, length: float) -> Column:
    return F.greatest(F.floor(seconds / length), F.lit(0))


def to_i16(x: Column) -> Column:
    """A sample as a 16-bit integer: clamped, halves away from zero."""
    return F.round(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) * 32767).cast("int")


def nearest_semitone(hz: Column) -> Column:
    """Semitones from 440 Hz."""
    return F.round(12 * F.log2(hz / 440)).cast("int")


def previous_action(position_s: Column) -> Column:
    return F.when(position_s > 3, "restart").otherwise("previous")


def digits(code: Column) -> Column:
    """ASCII digits only."""
    return F.regexp_replace(code, "[^0-9]", "")


def short(text: Column, most: int = 40) -> Column:
    """The first characters of a trimmed name."""
    return F.substring(F.trim(text), 1, most)


def display_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^((www|open)\.)+", "")


def digest_of(manifest: Column, name: Column) -> Column:
    """The digest on the first line of a checksum manifest that names the file (with or without the mark of binary mode); null if none does."""
    parts = F.transform(F.split(manifest, "\r?\n"), lambda line: F.split(F.trim(line), r"\s+\*?", 2))
    own = F.filter(parts, lambda p: (F.size(p) == 2) & (F.try_element_at(p, F.lit(2)) == name))
    return F.try_element_at(F.try_element_at(own, F.lit(1)), F.lit(1))
