"""Signals as arrays in rows: frames, segments and chunks, each worked on by the task that holds its row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import kernels


def spectrum(frames: DataFrame, column: str, n_fft: int, hop: int) -> DataFrame:
    """A row per frame of each signal: frame, re, im."""
    kept = [f for f in frames.schema.fields if f.name != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "frame int, re array<double>, im array<double>"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for row in pdf.itertuples(index=False):
                values = row._asdict()
                for k, s in enumerate(kernels.stft(values.pop(column), n_fft, hop)):
                    rows.append([*values.values(), k, s.real, s.imag])
            yield pd.DataFrame(rows, columns=[*(f.name for f in kept), "frame", "re", "im"])

    return frames.mapInPandas(run, schema)


def segments(songs: DataFrame, length: int, margin: int) -> DataFrame:
    """Overlapping segments of each song (audio_hash, samples): start, samples with ``margin`` on both sides, zeros outside; of songs with an array ``starts`` only those."""
    n = F.size("samples")
    starts = F.col("starts") if "starts" in songs.columns else F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(length))
    padded = F.concat(F.array_repeat(F.lit(0.0), margin), F.col("samples").cast("array<double>"), F.array_repeat(F.lit(0.0), margin + length))
    return songs.select("audio_hash", n.alias("n"), padded.alias("padded"), F.explode(starts).alias("start")).select("audio_hash", "n", "start", F.slice("padded", F.col("start") + 1, length + 2 * margin).alias("samples"))


def passthrough(spectrum_: np.ndarray) -> np.ndarray:
    """The stub model that keeps everything."""
    return spectrum_


def silence(spectrum_: np.ndarray) -> np.ndarray:
    """The stub model that keeps nothing."""
    return np.zeros_like(spectrum_)


def separate(songs: DataFrame, model: Callable[[np.ndarray], np.ndarray], length: int, n_fft: int, hop: int, compensate: float = 1.0) -> DataFrame:
    """Vocals by a model on the spectrum of each segment, cropped, and what is left: audio_hash, start, vocals, instrumental.

    Segments are independent rows, so a long song is the work of many tasks; ``resume.separate_missing``
    works on those that are missing.
    """
    margin = n_fft // 2

    @F.pandas_udf("array<double>")
    def vocals(samples: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> np.ndarray:
            s = kernels.stft(x, n_fft, hop)
            s[:, :3] = 0
            return kernels.istft(model(s), n_fft, hop, len(x))[margin : margin + length] * compensate

        return samples.map(one)

    # said to vary, so that no later filter runs the model a second time
    rows = segments(songs, length, margin).withColumn("vocals", vocals.asNondeterministic()("samples"))
    size = F.least(F.col("n") - F.col("start"), F.lit(length))
    mix = F.slice("samples", F.lit(margin + 1), size)
    return rows.select("audio_hash", "start", F.slice("vocals", F.lit(1), size).alias("vocals"), F.zip_with(mix, F.slice("vocals", F.lit(1), size), lambda a, b: a - b).alias("instrumental"))


def regroup(pieces: DataFrame, key: str, start: str, samples: str, length: int) -> DataFrame:
    """Pieces of any length as chunks of ``length`` samples by index; the last may be short. Pieces are cut at the borders of chunks, not taken apart."""
    s, n = F.col(start), F.size(samples)
    at = pieces.where(n > 0).select(key, F.col(samples).alias("v"), s.alias("s"), F.explode(F.sequence(F.floor(s / length), F.floor((s + n - 1) / length))).alias("index"))
    begin = F.greatest(F.col("index") * length - F.col("s"), F.lit(0))
    end = F.least((F.col("index") + 1) * length - F.col("s"), F.size("v"))
    part = F.struct((F.col("s") + begin).alias("p"), F.slice("v", (begin + 1).cast("int"), (end - begin).cast("int")).alias("v"))
    lists = at.groupBy(key, "index").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return lists.select(key, "index", F.flatten(F.transform("parts", lambda x: x.v)).alias("samples"))


def pitch_of(column: str, rate: float) -> Column:
    @F.pandas_udf("double")
    def run(frames: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else kernels.pitch(f, rate) for f in frames], dtype="float64")

    return run(column)


def peaks_of(column: str) -> Column:
    @F.pandas_udf("array<struct<bin int, power double>>")
    def run(frames: pd.Series) -> pd.Series:
        return frames.map(lambda f: [{"bin": b, "power": p} for b, p in kernels.spectral_peaks(f)], na_action="ignore")

    return run(column)


def power_db(frames: DataFrame, column: str) -> DataFrame:
    """Each frame's mean power in dB."""
    from ..functions.columns import decibels, mean_square

    return frames.withColumn("db", decibels(mean_square(F.col(column))))
