"""Two long yes/no series of a key, slid against each other: packed bits, all lags of a segment at once, and when to do it again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .timeline import phi

#: Hops of a segment.
SEGMENT = 1 << 12
_COUNTS = ("n", "n11", "n1x", "nx1")


def _packed(places: list[int], base: int, size: int) -> np.ndarray:
    """Bits of the places from ``base`` on, as little-endian words with one to spare."""
    bits = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
    bits[np.asarray(places, np.int64) - base] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def _slide(own: np.ndarray, other: np.ndarray, size: int, lags: int) -> np.ndarray:
    """For each lag 0..lags-1 the number of places where own[i] and other[i + lag] are both set: shifts once for each bit of a word, then words at a time."""
    words = size // 64
    out = np.zeros(lags, np.int64)
    for r in range(min(64, lags)):
        moved = other if r == 0 else other[:-1] >> np.uint64(r) | other[1:] << np.uint64(64 - r)
        steps = len(range(r, lags, 64))
        rows = np.lib.stride_tricks.sliding_window_view(moved, words)[:steps]
        out[r::64] = np.bitwise_count(rows & own[:words]).sum(axis=1, dtype=np.int64)
    return out


def _correlate(low: int, lags: int, segment: int):
    """Segments to counts of all lags; a task sums those of a key that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        schema = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], schema.field(0).type), *(pa.array([t.tolist()], pa.list_(pa.int64())) for t in total)], names=["key", *_COUNTS])

        reach = segment + lags + 64
        for batch in batches:
            for r in batch.to_pylist():
                if total is not None and r["key"] != key:
                    yield out()
                    total = None
                schema = batch.schema
                begin, start = r["seg"] * segment, r["seg"] * segment + low
                a, known = _packed(r["on1"], begin, segment), _packed(r["there1"], begin, segment)
                b, other = _packed(r["on2"], start, reach), _packed(r["there2"], start, reach)
                found = np.array([_slide(p, q, segment, lags) for p, q in ((known, other), (a, b), (a, other), (known, b))])
                key, total = r["key"], found if total is None else total + found
        if total is not None:
            yield out()

    return run


def counts_by_lag(first: DataFrame, second: DataFrame, low: int, high: int, key: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """(key, lag, n, n11, n1x, nx1): for each lag the hops that both series (key, hop, on) have, first[i] with second[i + lag], and of these those that are on in both, the first, the second.

    A series is cut into segments of ``segment`` hops (a multiple of 64); a segment of the second series reaches over by as many hops as there are
    lags. Hops become bits and a lag takes a shift, an AND and a count per 64 hops, so rows follow the hops, not the lags, and a
    key of any length is dealt out by segments. Hops come once; keys without a common hop have no rows. Null hops and keys drop out.
    """
    lags = high - low + 1
    place = F.col(key) if key else F.lit(0)
    tidy = lambda df: df.select(place.alias("key"), F.col("hop").cast("long").alias("hop"), F.coalesce("on", F.lit(False)).alias("on")).where("key is not null and hop is not null")
    own = tidy(first).withColumn("seg", F.floor(F.col("hop") / segment))
    # hop h of the second meets the segments from (h - high) to (h - low)
    met = F.sequence(F.floor((F.col("hop") - high) / segment), F.floor((F.col("hop") - low) / segment))
    other = tidy(second).withColumn("seg", F.explode(met))
    both = lambda df, k: df.groupBy("key", "seg").agg(F.collect_list(F.when(F.col("on"), F.col("hop"))).alias(f"on{k}"), F.collect_list("hop").alias(f"there{k}"))
    pieces = both(own, 1).join(both(other, 2), ["key", "seg"])
    kind = pieces.schema["key"].dataType.simpleString()
    lists = ", ".join(f"{c} array<long>" for c in _COUNTS)
    sums = pieces.select("key", "seg", "on1", "there1", "on2", "there2").mapInArrow(_correlate(low, lags, segment), f"key {kind}, {lists}")
    each = sums.select("key", F.posexplode(F.arrays_zip(*_COUNTS)).alias("k", "c")).select("key", (F.col("k") + low).alias("lag"), "c.*")
    found = each.groupBy("key", "lag").agg(*[F.sum(c).alias(c) for c in _COUNTS]).where("n > 0")
    return found.withColumnRenamed("key", key) if key else found.drop("key")


def phi_at_lags(first: DataFrame, second: DataFrame, low: int, high: int, least: int, key: str | None = None) -> DataFrame:
    """For each key and lag the phi correlation of first[i] with second[i + lag]; 0 for fewer than ``least`` common hops or a constant series."""
    c = {name: F.col(name) for name in _COUNTS}
    value = F.when(c["n"] < least, 0.0).otherwise(phi(c["n11"], c["n1x"], c["nx1"], c["n"]))
    return counts_by_lag(first, second, low, high, key).select(*([key] if key else []), "lag", F.round(value, 6).alias("phi"))


def clear_offsets(scores: DataFrame, key: str, least: float = 0.3, rival: float = 0.8, reach: int = 20) -> DataFrame:
    """(key, lag, phi): the lag of each key's best score (of equal ones the last), if it is at least ``least`` and every other peak (the largest within ``reach`` lags) more than ``reach`` away is below ``rival`` of it."""
    by = Window.partitionBy(key)
    near = by.orderBy("lag").rangeBetween(-reach, reach)
    peaks = scores.withColumn("peak", F.col("phi") >= F.max("phi").over(near)).withColumn("best", F.max(F.struct("phi", "lag")).over(by))
    other = F.max(F.when(F.col("peak") & (F.abs(F.col("lag") - F.col("best.lag")) > reach), F.col("phi")))
    found = peaks.groupBy(key).agg(F.first("best").alias("best"), F.greatest(other, F.lit(0.0)).alias("other"))
    return found.where((F.col("best.phi") >= least) & (F.coalesce("other", F.lit(0.0)) < F.col("best.phi") * rival)).select(key, "best.lag", "best.phi")


def due(sources: DataFrame, lyrics: DataFrame, key: str) -> DataFrame:
    """Sources (key, ready, manual, synced_at) whose whole song must be aligned: ready, not set by hand, and not yet with these lyrics (key, fetched_at)."""
    both = sources.join(lyrics.select(key, "fetched_at"), key)
    return both.where(F.col("ready") & ~F.col("manual") & ~F.col("synced_at").eqNullSafe(F.col("fetched_at")))


def align(sources: DataFrame, lyrics: DataFrame, sung: DataFrame, words: DataFrame, key: str, low: int, high: int, least_hops: int, hop_ms: int = 50, **rule: float) -> DataFrame:
    """``sources`` with offset_ms and synced_at brought up to date; a second run over the result changes nothing.

    Only the series (key, hop, on) of sources that are due are read on: a song with a clear offset takes it, one without keeps what
    it has, and both note the version of the lyrics. Of the same version nothing is done again.
    """
    open_ = due(sources, lyrics, key).select(key, "fetched_at")
    of = lambda hops: hops.join(open_.select(key), key, "left_semi")
    found = clear_offsets(phi_at_lags(of(words), of(sung), low, high, least_hops, key), key, **rule)
    news = open_.join(found.select(key, (F.col("lag") * hop_ms).cast("long").alias("new_ms")), key, "left")
    return sources.join(news, key, "left").select(*[F.coalesce({"offset_ms": "new_ms", "synced_at": "fetched_at"}[c], F.col(c)).alias(c) if c in ("offset_ms", "synced_at") else F.col(c) for c in sources.columns])
