"""Search in nested JSON of any depth, as VARIANT values, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as x
from .lineage import kept, spread

#: Levels that one pass goes down; deeper values take another pass.
LEVELS = 16


def find_key(rows: DataFrame, id_col: str, json_col: str, key: str, levels: int = LEVELS, read: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """(id, path, value): every value under ``key`` that isn't inside another such value, however deep, or what ``read`` makes of it.

    ``path`` orders a document's values as a depth-first walk meets them (object members by name). Each level
    gives an object's value under the key, or else its members; scalars fall away, so rows
    are only ever as many as there are values, and nothing is shuffled. After ``levels`` levels, what is still open is written once and
    goes on. Null and unreadable JSON give no rows.
    """
    under = f"struct<`{key.replace('`', '``')}`: variant>"
    node = rows.where(F.contains(F.col(json_col), F.lit(key))).select(F.col(id_col), F.array().cast("array<int>").alias("path"), F.try_parse_json(json_col).alias("v"), F.lit(False).alias("found"))
    members = rows.sparkSession.tvf.variant_explode_outer
    found, hit = F.col("found"), F.col("hit")
    done = None
    while True:
        for _ in range(levels):
            # a struct's missing field is null; a missing path is dear (an exception inside)
            node = node.select(id_col, "path", "v", "found", F.when(~found, F.try_variant_get("v", "$", under).getField(key)).alias("hit"))
            node = node.select(id_col, "path", F.coalesce("hit", F.when(found, F.col("v"))).alias("v"), F.when(~found & hit.isNull(), F.col("v")).alias("open"), (found | hit.isNotNull()).alias("found"))
            deeper = node.lateralJoin(members(F.col("open").outer())).where("found or pos is not null")
            path = F.when(found, F.col("path")).otherwise(F.concat("path", F.array("pos")))
            node = deeper.select(id_col, path.alias("path"), F.when(found, F.col("v")).otherwise(F.col("value")).alias("v"), "found")
        reached = kept(node.select(id_col, "path", F.when(~found, F.col("v")).alias("v"), "found", F.when(found, read(F.col("v"))).alias("value")))
        values = reached.where("found").select(id_col, "path", "value")
        done = values if done is None else done.unionByName(values)
        node = reached.where("not found").drop("value")
        if node.isEmpty():
            return done


#: What is read of a video, each text simply or as runs. Only a text can be had as binary, a number or a flag is null.
_TEXT = "struct<simpleText: binary, runs: array<struct<text: binary>>>"
_VIDEO = f"""struct<videoId: binary, title: {_TEXT}, ownerText: {_TEXT}, longBylineText: {_TEXT}, lengthText: {_TEXT}, thumbnail: struct<thumbnails: array<struct<url: binary>>>,
    badges: array<struct<metadataBadgeRenderer: struct<style: binary>>>, upcomingEventData: variant>"""


def shown_text(v: Column) -> Column:
    """A text given simply, or as runs that follow each other."""
    return F.coalesce(v.simpleText.cast("string"), F.array_join(v.runs.text.cast("array<string>"), ""))


def videos(rows: DataFrame, id_col: str, json_col: str, most: int | None = None) -> DataFrame:
    """(id, ord, url, title, channel, duration_ms, thumbnail): the videos of a search response in its order, each address once, none live or to come.

    Videos without an id or a title drop out; of videos with one address the first that isn't live counts. ``most`` keeps the first
    so many of each response.
    """
    v, clock = F.col("value"), F.col("clock")
    found = find_key(rows, id_col, json_col, "videoRenderer", read=lambda v: F.try_variant_get(v, "$", _VIDEO))
    live = F.coalesce(F.array_contains(v.badges.metadataBadgeRenderer.style.cast("array<string>"), "BADGE_STYLE_TYPE_LIVE_NOW"), F.lit(False))
    texts = F.struct(
        F.concat(F.lit("https://www.youtube.com/watch?v="), v.videoId.cast("string")).alias("url"),
        shown_text(v.title).alias("title"),
        F.coalesce(shown_text(v.ownerText), shown_text(v.longBylineText)).alias("channel"),
        shown_text(v.lengthText).alias("clock"),
        F.get(v.thumbnail.thumbnails, F.lit(0)).url.cast("string").alias("thumbnail"),
    )
    duration = F.when(clock.rlike(r"^\s*-?\d{1,9}\s*(:\s*-?\d{1,9}\s*)*$"), x.clock_ms(F.regexp_replace(clock, r"\s", "")))
    hit = F.struct("title", "channel", duration.alias("duration_ms"), "thumbnail")
    shown = found.where(~live & v.upcomingEventData.isNull()).select(id_col, "path", F.inline(F.array(texts))).where("url is not null and title is not null").select(id_col, "path", "url", hit.alias("hit"))
    whole = spread(shown, id_col)
    once = whole.withColumn("nth", F.row_number().over(Window.partitionBy(id_col, "url").orderBy("path"))).where("nth = 1")
    listed = once.withColumn("ord", F.row_number().over(Window.partitionBy(id_col).orderBy("path"))).select(id_col, "ord", "url", "hit.*")
    return listed if most is None else listed.where(F.col("ord") <= most)
