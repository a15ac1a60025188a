"""A change set over songs, collections and memberships, worked out from one snapshot of the three tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import kept


class Shelves(NamedTuple):
    """track (id, title, artist, album, ...), collection (id, provider, kind, provider_ref, name, subtitle), member (collection_id, track_id, position)."""

    tracks: DataFrame
    collections: DataFrame
    members: DataFrame


_REF = ["provider", "kind", "provider_ref"]


def homes(edits: DataFrame) -> DataFrame:
    """(track_id, ord, provider, kind, provider_ref, name, subtitle): the collections in which each edited song belongs: the imported ones, its artist's, its album's."""
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    home = lambda kind, ref, name, subtitle: F.struct(F.lit("local").alias("provider"), F.lit(kind).alias("kind"), ref.alias("provider_ref"), name.alias("name"), subtitle.cast("string").alias("subtitle"))
    artist, album = F.col("artist"), F.col("album")
    each = [
        home("playlist", F.lit("imported"), F.lit("Imported"), F.lit(None)),
        F.when(artist.isNotNull(), home("artist", F.concat(F.lit("artist:"), lower(artist)), artist, F.lit(None))),
        F.when(album.isNotNull(), home("album", F.concat(F.lit("album:"), lower(artist), F.lit(":"), lower(album)), album, artist)),
    ]
    return edits.select("track_id", "ord", F.explode(F.filter(F.array(*each), lambda h: h.isNotNull())).alias("home")).select("track_id", "ord", "home.*")


def edit_info(shelves: Shelves, edits: DataFrame) -> Shelves:
    """Songs with new title, artist and album (edits: track_id, ord, title, artist, album), filed under their new artist and album.

    All edits work on the snapshot at once. An edited song leaves every album and artist; the collections that it
    belongs to are found by (provider, kind, provider_ref), take the name that the last edit (by ord) spells, or are made, with ids
    after the largest, in the order of the edits that first ask for them. A song that isn't in one yet goes to the end of its artist and album, and
    to the front of the imported ones, in the order of the edits. Albums and artists that hold no song then go. Of several
    edits of a song the last counts; edits of songs that aren't there do nothing. Only edited songs and the collections that
    they touch are shuffled by more than their keys.
    """
    tracks, collections, members = shelves
    edits = edits.groupBy("track_id").agg(F.max_by(F.struct("ord", "title", "artist", "album"), "ord").alias("e")).select("track_id", "e.*")
    edits = kept(edits.join(tracks.select(F.col("id").alias("track_id")), "track_id", "left_semi"))
    new = edits.select(F.col("track_id").alias("id"), F.struct("title", "artist", "album").alias("new"))
    tracks = tracks.join(new, "id", "left").select(*[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in ("title", "artist", "album") else F.col(c) for c in tracks.columns])

    wanted = kept(homes(edits))
    spelled = wanted.groupBy(*_REF).agg(F.max_by(F.struct("name", "subtitle"), "ord").alias("new"), F.min("ord").alias("first"))
    matched = collections.join(spelled, _REF, "left")
    old = matched.select(*[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in ("name", "subtitle") else F.col(c) for c in collections.columns])
    made = spelled.join(collections.select(*_REF), _REF, "left_anti")
    most = collections.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))  # one row
    number = F.row_number().over(Window.orderBy("first", "kind", "provider_ref"))
    fresh = made.withColumn("number", number).join(F.broadcast(most), F.lit(True)).select((F.col("most") + F.col("number")).alias("id"), *_REF, "new.name", "new.subtitle")
    collections = kept(old.unionByName(fresh, allowMissingColumns=True))

    moved = members.join(collections.where("kind in ('album', 'artist')").select(F.col("id").alias("collection_id")), "collection_id", "left_semi").join(edits.select("track_id"), "track_id", "left_semi")
    stay = members.join(moved.select("collection_id", "track_id"), ["collection_id", "track_id"], "left_anti")
    ask = wanted.join(collections.select(F.col("id").alias("collection_id"), *_REF), _REF).select("collection_id", "track_id", "ord", "kind")
    ask = ask.join(stay.select("collection_id", "track_id"), ["collection_id", "track_id"], "left_anti")
    ends = stay.join(ask.select("collection_id").distinct(), "collection_id", "left_semi").groupBy("collection_id").agg(F.min("position").alias("front"), F.max("position").alias("back"))
    nth = F.row_number().over(Window.partitionBy("collection_id").orderBy("ord", "track_id"))
    # into an empty collection the first song takes place 0
    front = F.when(F.col("front").isNull(), 1 - F.col("nth")).otherwise(F.col("front") - F.col("nth"))
    back = F.when(F.col("back").isNull(), F.col("nth") - 1).otherwise(F.col("back") + F.col("nth"))
    added = ask.withColumn("nth", nth).join(ends, "collection_id", "left").select("collection_id", "track_id", F.when(F.col("kind") == "playlist", front).otherwise(back).cast("long").alias("position"))
    members = kept(stay.select("collection_id", "track_id", F.col("position").cast("long").alias("position")).unionByName(added))

    full = collections.join(members.select(F.col("collection_id").alias("id")), "id", "left_semi")
    empty_ok = collections.where("kind not in ('album', 'artist')").join(members.select(F.col("collection_id").alias("id")), "id", "left_anti")
    return Shelves(tracks, full.unionByName(empty_ok), members)
