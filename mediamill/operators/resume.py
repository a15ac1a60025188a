"""Work on what is missing: the planned chunks of a song less those that are done."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import signals


def missing_chunks(songs: DataFrame, done: DataFrame, chunk: int, from_first_gap: bool = False) -> DataFrame:
    """(audio_hash, index) of the chunks of songs (audio_hash, n) that ``done`` (audio_hash, index) lacks; or all from each song's first gap on, as a run in order leaves them."""
    count = F.ceil(F.col("n") / chunk)
    plan = songs.where("n > 0").select("audio_hash", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("index"))
    have = done.select("audio_hash", F.col("index").cast("long").alias("index")).distinct()
    gaps = plan.join(have, ["audio_hash", "index"], "left_anti")
    if not from_first_gap:
        return gaps
    first = gaps.groupBy("audio_hash").agg(F.min("index").alias("first"))
    return plan.join(first, "audio_hash").where(F.col("index") >= F.col("first")).select("audio_hash", "index")


def separate_missing(songs: DataFrame, done: DataFrame, model: Callable[[np.ndarray], np.ndarray], chunk: int, length: int, n_fft: int, hop: int, compensate: float = 1.0) -> DataFrame:
    """(audio_hash, index, vocals, instrumental) of the chunks that are missing; with ``done`` the same as a full run.

    Chunks of ``chunk`` samples and the model's segments of ``length`` don't line up, so each missing chunk asks for the
    segments that it touches; only these reach the model, each once, and songs without a gap aren't read on. ``songs`` has
    (audio_hash, samples); hashes are unique and not null.
    """
    gaps = missing_chunks(songs.select("audio_hash", F.size("samples").alias("n")), done, chunk)
    low, high = F.col("index") * chunk, (F.col("index") + 1) * chunk - 1
    touched = F.sequence(F.floor(low / length), F.floor(high / length))
    wanted = gaps.select("audio_hash", F.explode(touched).alias("k")).groupBy("audio_hash").agg(F.sort_array(F.collect_set((F.col("k") * length).cast("int"))).alias("starts"))
    own = songs.select("audio_hash", "samples").join(wanted, "audio_hash").withColumn("starts", F.filter("starts", lambda s: s < F.size("samples")))
    found = signals.separate(own, model, length, n_fft, hop, compensate)
    both = found.select("audio_hash", "start", F.arrays_zip("vocals", "instrumental").alias("both"))
    chunks = signals.regroup(both, "audio_hash", "start", "both", chunk).join(gaps, ["audio_hash", "index"], "left_semi")
    return chunks.select("audio_hash", "index", F.transform("samples", lambda x: x.vocals).alias("vocals"), F.transform("samples", lambda x: x.instrumental).alias("instrumental"))


def cubic(pieces: DataFrame, key: str, start: str, samples: str, rate: int, to: int, piece: int = 1 << 14) -> DataFrame:
    """Pieces of signals (start, samples that follow each other) at another rate by cubic interpolation through four samples: (key, start, samples).

    Of n samples of a key floor(n * to / rate) come out, wherever the pieces' borders lie: a piece gives the samples
    whose place, j * rate / to, falls on it, and sees one sample of the piece before and two of the piece after. Places are whole numbers
    and remainders, so nothing drifts. Beyond the ends are zeros. All by array expressions; a row is at most ``piece`` samples.
    """
    even = signals.regroup(pieces, key, start, samples, piece)
    by = Window.partitionBy(key).orderBy("index")
    x = even.select(key, "index", F.col("samples").cast("array<double>").alias("x"), F.lag("samples").over(by).cast("array<double>").alias("before"), F.lead("samples").over(by).cast("array<double>").alias("after"))
    # what a short last piece lacks lies beyond the end
    left = F.coalesce(F.slice("before", -1, 1), F.array(F.lit(0.0)))
    right = F.slice(F.concat(F.coalesce("after", F.array().cast("array<double>")), F.array(F.lit(0.0), F.lit(0.0))), 1, 2)
    n = F.col("index") * piece + F.size("x")
    first = F.ceil(F.col("index") * piece * to / F.lit(rate)).cast("long")
    # the last place on this piece; of the last piece no more than the whole length allows
    beyond = F.when(F.col("after").isNull(), F.floor(n * to / F.lit(rate))).otherwise(F.ceil(n * to / F.lit(rate))).cast("long")
    x = x.select(key, "index", F.concat(left, "x", right).alias("x"), first.alias("first"), beyond.alias("beyond")).where("beyond > first")

    def at(v: Column, j: Column) -> Column:
        i = F.floor(j * rate / F.lit(to)) - F.col("index") * piece
        t = (j * rate % to) / F.lit(float(to))
        a, b, c, d = (F.get(v, (i + k).cast("int")) for k in range(4))
        c1, c2, c3 = (c - a) * 0.5, a - b * 2.5 + c * 2.0 - d * 0.5, (d - a) * 0.5 + (b - c) * 1.5
        return ((c3 * t + c2) * t + c1) * t + b

    # a lambda's variable is computed once, an outer expression for each sample
    out = F.transform(F.array("x"), lambda v: F.transform(F.sequence("first", F.col("beyond") - 1), lambda j: at(v, j)))[0]
    return x.select(key, F.col("first").alias("start"), out.alias("samples"))
