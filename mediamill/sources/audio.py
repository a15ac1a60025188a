"""Audio and folder sources: wave files as rows of samples, folders as sizes, chunks as Parquet."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.kernels import quantise, resample

RATE = 44100
SAMPLES = "path string, rate int, left array<float>, right array<float>, error string"


def decode_wave(content: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Rate and two channels of a 16-bit wave file; one channel is doubled, further ones are dropped."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit samples")
        data = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()) / 32768
        return w.getframerate(), data[:, 0], data[:, min(1, data.shape[1] - 1)]


def decode_range(content: bytes, start: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames start to start + length of ``read_waves``' output, fewer at the end; of a file at 44.1 kHz only these are read."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getframerate() == RATE and w.getsampwidth() == 2:
            at = min(start, w.getnframes())
            w.setpos(at)
            data = np.frombuffer(w.readframes(min(length, w.getnframes() - at)), "<i2").reshape(-1, w.getnchannels()) / 32768
            return data[:, 0].astype(np.float32), data[:, min(1, data.shape[1] - 1)].astype(np.float32)
    rate, left, right = decode_wave(content)
    return tuple(resample(x, rate)[start : start + length].astype(np.float32) for x in (left, right))


#: Names of a wave file's text chunks.
TAGS = {b"INAM": "title", b"IART": "artist", b"IPRD": "album"}


def read_tags(content: bytes) -> dict[str, str | int | None]:
    """Title, artist, album (of each the first that isn't blank) and duration_ms of a wave file, from its chunks' heads; no sample is read."""
    out: dict[str, str | int | None] = dict.fromkeys([*TAGS.values(), "duration_ms"])
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, rate, width = 12, 0, 0
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt ":
            rate, width = struct.unpack_from("<I", content, at + 12)[0], struct.unpack_from("<H", content, at + 20)[0]
        elif name == b"data" and rate and width:
            out["duration_ms"] = min(size, len(content) - at - 8) // width * 1000 // rate
        elif name == b"LIST" and content[at + 8 : at + 12] == b"INFO":
            k, end = at + 12, min(at + 8 + size, len(content))
            while k + 8 <= end:
                n = struct.unpack_from("<I", content, k + 4)[0]
                field, text = TAGS.get(content[k : k + 4]), content[k + 8 : k + 8 + n].split(b"\0")[0].decode("utf-8", "replace").strip()
                if field and text and out[field] is None:
                    out[field] = text
                k += 8 + n + n % 2
        at += 8 + size + size % 2
    return out


def probe_waves(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, artist, album, duration_ms, error) of each wave file under ``path``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for name, content in zip(pdf.path, pdf.content):
                try:
                    rows.append((name, *read_tags(bytes(content)).values(), None))
                except (ValueError, struct.error) as e:
                    rows.append((name, None, None, None, None, f"unsupported: {e}"))
            yield pd.DataFrame(rows, columns=["path", "title", "artist", "album", "duration_ms", "error"]).astype({"duration_ms": "Int64"} | dict.fromkeys(["path", "title", "artist", "album", "error"], object))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, title string, artist string, album string, duration_ms long, error string")


def as_waves(chunks: DataFrame) -> DataFrame:
    """(audio_hash, content): each song's chunks (audio_hash, index, left, right), from 0 on to the first gap, as one 16-bit wave file.

    Samples are clamped and cut towards zero, not rounded. A song's chunks are one row of the result, so one task's memory.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("index").sort_values("index")
        pdf = pdf[pdf["index"].to_numpy() == np.arange(len(pdf))]
        both = [np.concatenate([np.zeros(0), *pdf[c]]) for c in ("left", "right")]
        cut = (np.clip(np.stack(both, axis=1), -1, 1) * 32767).astype("<i2")
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(2), w.setsampwidth(2), w.setframerate(RATE)
            w.writeframes(cut.tobytes())
        return pd.DataFrame({"content": [out.getvalue()]})

    kind = chunks.schema["audio_hash"].dataType.simpleString()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf).assign(audio_hash=pd.Series([key[0]], dtype=object))[["audio_hash", "content"]]

    return chunks.select("audio_hash", "index", "left", "right").groupBy("audio_hash").applyInPandas(one, f"audio_hash {kind}, content binary")


def read_waves(spark: SparkSession, path: str) -> DataFrame:
    """A row per wave file under ``path``, at 44.1 kHz; a file that can't be read has an error and no samples."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for name, content in zip(pdf.path, pdf.content):
                try:
                    rate, left, right = decode_wave(bytes(content))
                    if rate != RATE:
                        left, right = resample(left, rate), resample(right, rate)
                    rows.append((name, rate, left.astype(np.float32), right.astype(np.float32), None))
                except (ValueError, EOFError, wave.Error) as e:
                    rows.append((name, None, None, None, f"unsupported: {e}"))
            yield pd.DataFrame(rows, columns=["path", "rate", "left", "right", "error"]).astype({"rate": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, SAMPLES)


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes, files and the latest change of each folder of files under ``path``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"), F.unix_millis(F.max("modificationTime")).alias("changed_ms"))


def content_hash(left: np.ndarray, right: np.ndarray) -> bytes:
    """Bytes that identify a song: both channels interleaved as 16-bit integers."""
    both = np.empty(2 * len(left), np.int16)
    both[::2], both[1::2] = quantise(left), quantise(right)
    return both.astype("<i2").tobytes()


def with_hash(songs: DataFrame) -> DataFrame:
    """Songs with audio_hash, the SHA-256 of their interleaved samples."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(packed=[None if a is None else content_hash(a, b) for a, b in zip(pdf.left, pdf.right)])

    return songs.mapInPandas(run, SAMPLES + ", packed binary").withColumn("audio_hash", F.sha2("packed", 256)).drop("packed")
