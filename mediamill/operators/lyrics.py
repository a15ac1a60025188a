"""Time-stamped lyrics: text to lines, words and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import columns as x, names
from .lineage import spread


def parse_lrc(texts: DataFrame) -> DataFrame:
    """Lines of each track (track_id, text, duration_ms): start_ms, end_ms, text, voice, words.

    A line's leading brackets are time stamps; another bracket before the first of them makes the
    line metadata, later ones are dropped. Voices carry on in the order of the text. A line ends
    where the next begins, blank ones included; the last at the duration, or 5 s on. Whole texts are
    dealt by track, once; lines are parsed where the windows see them, one track at a time.
    """
    lines = spread(texts, "track_id").select("track_id", "duration_ms", F.posexplode(F.split(F.regexp_replace("text", "^﻿", ""), "\r?\n")).alias("line_no", "line"))
    head = r"^((?:\s*\[[^\]]*\])+)"
    once = lambda value, of: F.transform(F.array(value), of)[0]
    stamps = lambda h: F.transform(F.regexp_extract_all(h, F.lit(r"\[([^\]]*)\]"), F.lit(1)), x.stamp_ms)
    own = lambda h: once(F.trim(F.substring("line", F.length(h) + 1, F.length("line"))), names.split_voice)
    parsed = once(F.regexp_extract("line", head, 1), lambda h: F.struct(stamps(h).alias("stamps"), own(h).alias("own")))
    stamped = F.filter(F.array(parsed), lambda p: F.try_element_at(p.stamps, F.lit(1)).isNotNull())
    lines = lines.where(F.col("line").rlike(r"^\s*\[")).select("track_id", "duration_ms", "line_no", F.explode(stamped).alias("p"))
    lines = lines.select("track_id", "duration_ms", "line_no", F.col("p.own").alias("own"), F.filter("p.stamps", lambda s: s.isNotNull()).alias("stamps"))
    so_far = Window.partitionBy("track_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("voice", F.last("own.voice", ignorenulls=True).over(so_far))
    rows = lines.select("track_id", "duration_ms", "line_no", "voice", F.col("own.rest").alias("text"), F.posexplode("stamps").alias("stamp_no", "start_ms"))
    order = Window.partitionBy("track_id").orderBy("start_ms", "line_no", "stamp_no")
    rows = rows.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(order), F.greatest(F.col("duration_ms"), F.col("start_ms") + 5000)))
    rows = rows.where("text <> ''")
    return rows.select("track_id", "start_ms", "end_ms", "text", "voice", x.spread_words(F.col("text"), F.col("start_ms"), F.col("end_ms")).alias("words"))


def timeline(lines: DataFrame, least_gap_ms: int = 3000) -> DataFrame:
    """Lines and the gap rows between what is sung: track_id, kind, start_ms, end_ms, text."""
    sung_end = F.coalesce(F.try_element_at("words", F.lit(-1)).end_ms, F.col("end_ms"))
    w = Window.partitionBy("track_id").orderBy("start_ms")
    rows = lines.withColumn("sung_end", sung_end).withColumn("before", F.coalesce(F.lag("sung_end").over(w), F.lit(0).cast("long")))
    gaps = rows.where(F.col("start_ms") - F.col("before") > least_gap_ms).select("track_id", F.lit("gap").alias("kind"), F.col("before").alias("start_ms"), F.col("start_ms").alias("end_ms"), F.lit(None).cast("string").alias("text"))
    return rows.select("track_id", F.lit("line").alias("kind"), "start_ms", "end_ms", "text").unionByName(gaps)
