"""Sources asked in turn: each sees only the keys that no earlier one has answered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .lineage import kept

#: Takes the open questions and returns (key, answer columns) for those that it can answer.
Source = Callable[[DataFrame], DataFrame]


def answer_in_turn(questions: DataFrame, key: str, sources: list[tuple[str, Source]], nothing: str | None = None) -> DataFrame:
    """The answers of the first source that has one for each key, with that source's name as ``source``.

    Each source gets the rows of ``questions`` that are still open; its answers are written once and those keys leave
    before the next is asked, so a dear source at the end sees few. A source's answers for keys that it wasn't asked for are
    left out; of several for one key any one counts unless the source chooses itself. ``nothing`` names the rest, with null answers;
    without it the rest has no rows. Keys of questions are unique and not null.
    """
    names = None
    open_, answered = questions, []
    for name, source in sources:
        found = source(open_)
        names = names or [c for c in found.columns if c != key]
        found = found.select(key, *names).join(open_.select(key), key, "left_semi").dropDuplicates([key])
        found = kept(found.withColumn("source", F.lit(name)))
        answered.append(found)
        open_ = kept(open_.join(found.select(key), key, "left_anti"))
    if nothing is not None:
        kinds = answered[0].schema
        answered.append(open_.select(key, *[F.lit(None).cast(kinds[c].dataType).alias(c) for c in names], F.lit(nothing).alias("source")))
    out = answered[0]
    for more in answered[1:]:
        out = out.unionByName(more)
    return out


def find_lyrics(songs: DataFrame, hits: DataFrame, match: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(id, source, lyrics, name, singer) for songs (id, title, artist, length, embedded): synced text of the file itself, else the service's best match, else its best with title and singer swapped, else none.

    A swapped match names the song: name and singer are the hit's. ``match`` gives (id, hit_title, hit_artist, lyrics) for songs among ``hits``.
    """
    from ..functions import names as n

    blank = F.lit(None).cast("string")

    def embedded(open_: DataFrame) -> DataFrame:
        return open_.where(n.is_synced(F.col("embedded"))).select("id", F.col("embedded").alias("lyrics"), blank.alias("name"), blank.alias("singer"))

    def service(open_: DataFrame) -> DataFrame:
        return match(open_.select("id", "title", "artist", "length"), hits).select("id", "lyrics", blank.alias("name"), blank.alias("singer"))

    def swapped(open_: DataFrame) -> DataFrame:
        turned = open_.where("artist is not null").select("id", F.col("artist").alias("title"), F.col("title").alias("artist"), "length")
        return match(turned, hits).select("id", "lyrics", F.col("hit_title").alias("name"), F.col("hit_artist").alias("singer"))

    return answer_in_turn(songs, "id", [("embedded", embedded), ("service", service), ("swapped", swapped)], "none")
