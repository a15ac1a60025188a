"""Pasted links: what looks like one, its one form, what can be had from it. All by column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Sites whose pages give audio, streaming services that don't, endings of audio files.
EXTRACTABLE = ["youtube.com", "youtu.be", "soundcloud.com", "bandcamp.com", "vimeo.com", "archive.org", "mixcloud.com", "b23.tv"]
STREAMING = ["spotify.com", "music.apple.com", "tidal.com", "deezer.com"]
AUDIO = ["mp3", "wav", "flac", "m4a", "aac", "ogg", "aif", "aiff"]
#: The codes of links that can't be used.
LINK_STREAMING, LINK_UNSUPPORTED = "linkStreaming", "linkUnsupported"

_URL = r"^(https?)://(?:[^/?#@\s]*@)?([^/?#:@\s]*\.[^/?#:@\s]*)(?::(\d{0,5}))?(/[^?#]*)?(\?[^#]*)?(#.*)?$"


def parsed(text: Column) -> Column:
    """(scheme, host, port, path, query) of what looks like a link, with or without its scheme; null for words to look for.

    A link has no white space and a host with a dot; the host is in lower case, a default port is left out, an empty path is "/".
    """
    s = F.trim(text)
    url = F.when(s.rlike("^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    part = lambda n: F.regexp_extract(url, _URL, n)
    port = F.when(part(3) != F.when(part(1) == "http", "80").otherwise("443"), F.nullif(part(3), F.lit("")))
    link = F.struct(part(1).alias("scheme"), F.lower(part(2)).alias("host"), port.alias("port"), F.coalesce(F.nullif(part(4), F.lit("")), F.lit("/")).alias("path"), F.substring(part(5), 2, 1 << 20).alias("query"), part(6).alias("fragment"))
    return F.when((s != "") & ~s.rlike(r"\s") & url.rlike(_URL) & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535), link)


def host_is(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith(f".{domain}")


def _bare(link: Column) -> Column:
    return F.regexp_replace(link.host, r"\.+$", "")


def _one_of(host: Column, domains: list[str]) -> Column:
    found = F.lit(False)
    for d in domains:
        found = found | host_is(host, d)
    return found


def _page_of_videos(link: Column) -> Column:
    return host_is(_bare(link), "bilibili.com") & link.path.startswith("/video/")


def as_text(link: Column) -> Column:
    return F.concat(link.scheme, F.lit("://"), link.host, F.when(link.port.isNotNull(), F.concat(F.lit(":"), link.port)).otherwise(""), link.path, F.when(link.query != "", F.concat(F.lit("?"), link.query)).otherwise(""), link.fragment)


def canonical(link: Column) -> Column:
    """The one address of a video, whatever form its link has; other links as they are."""
    h, segments = _bare(link), F.split(link.path, "/")
    at = lambda n: F.try_element_at(segments, F.lit(n))  # noqa: E731  the first is what stands before the first slash
    asked = lambda name: F.try_url_decode(F.regexp_extract(link.query, rf"(?:^|&){name}=([^&]*)", 1))
    watched = F.when(at(2) == "watch", asked("v")).when(at(2).isin("shorts", "live", "embed"), at(3))
    video = F.when(host_is(h, "youtu.be"), at(2)).when(host_is(h, "youtube.com"), watched)
    part = F.when(link.query.rlike("(?:^|&)p="), F.concat(F.lit("?p="), F.url_encode(asked("p")))).otherwise("")
    return (
        F.when(_page_of_videos(link), F.concat(F.lit("https://www.bilibili.com/video/"), F.coalesce(at(3), F.lit("")), part)).when(video != "", F.concat(F.lit("https://www.youtube.com/watch?v="), F.url_encode(video))).otherwise(as_text(link))
    )


def verdict(link: Column) -> Column:
    """``audio file``, ``extractable``, ``streaming`` or ``unsupported``."""
    ending = F.lower(F.substring_index(link.path, ".", -1))
    return F.when(link.path.contains(".") & ending.isin(AUDIO), "audio file").when(_one_of(_bare(link), EXTRACTABLE) | _page_of_videos(link), "extractable").when(_one_of(_bare(link), STREAMING), "streaming").otherwise("unsupported")


def rejection(link: Column) -> Column:
    """Why a link can't be used; null if it can."""
    return F.when(verdict(link) == "streaming", LINK_STREAMING).when(verdict(link) == "unsupported", LINK_UNSUPPORTED)


def _bound(text: Column, of: Callable[[Column], Column]) -> Column:
    """Of a parsed link; a lambda's own variable is computed once, an outer expression wherever it is named."""
    return F.transform(F.array(parsed(text)), of)[0]


def details(text: Column) -> Column:
    """(canonical, verdict, problem) of what looks like a link; null for words."""
    return _bound(text, lambda link: F.when(link.isNotNull(), F.struct(canonical(link).alias("canonical"), verdict(link).alias("verdict"), rejection(link).alias("problem"))))


def meant(text: Column) -> Column:
    """What the search box's text means: (kind, url, host, streaming): a ``link`` that can be used, a ``rejected`` one, or ``text`` to look for.

    The host is shown without ``www.`` and ``open.`` before it.
    """

    def outcome(link: Column) -> Column:
        shown = F.regexp_replace(F.regexp_replace(link.host, r"^(www\.)+", ""), r"^(open\.)+", "")
        usable = rejection(link).isNull()
        words = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("boolean").alias("streaming"))
        return F.when(link.isNull(), words).otherwise(F.struct(F.when(usable, "link").otherwise("rejected").alias("kind"), F.when(usable, as_text(link)).alias("url"), shown.alias("host"), F.when(~usable, verdict(link) == "streaming").alias("streaming")))

    return _bound(text, outcome)
