"""Shared pieces: checkpoints, vectorised text hashing, bounded id filters, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

U = np.uint64
#: Bytes of text that a task hashes at once; one longer text is taken alone.
CHUNK_BYTES = 1 << 19


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``.

    Only in local mode, where that setting is absent, a temporary folder is taken.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint()


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema with further fields; a field of the same name gives way."""
    names = {n for n, _ in fields}
    return T.StructType([f for f in schema.fields if f.name not in names] + [T.StructField(n, t) for n, t in fields])


def put(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with further columns, in the order of ``with_fields``."""
    names = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + list(columns.values()), names=names + list(columns))


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Whole texts as UTF-8; null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_STEP = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            table = np.full(n, U(base))
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, by one prefix sum over all of them."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


#: For ``bytes.translate``: A-Z to lower case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, in order, and where each text's words begin (one more entry ends the last)."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    flips = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data])).astype(np.int8)))
    starts, ends = flips[::2], flips[1::2]
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return span_hashes(data, starts, ends), np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words; of a shorter text its whole sequence; none without words."""
    words, at = word_hashes(texts)
    runs = np.zeros(max(0, len(words) - width + 1), U)
    for k in range(width):
        runs += words[k : k + len(runs)] * U(pow(0xA24BAED4963EE407, k + 1, 1 << 64))
    runs = mix64(runs)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = U(int(b - a))
            for w in words[a:b]:
                h = mix64(np.array([h ^ w], U))[0]
            out.append(np.array([h], U))
        else:
            out.append(np.zeros(0, U))
    return out


def id_filter(ids: DataFrame, column: str, bits: int = 1 << 24) -> DataFrame:
    """A bitmap over the ids' hashes as at most ``bits``/64 rows (_word, _bits), whatever the number of ids."""
    place = F.pmod(F.xxhash64(F.col(column), F.lit(17)), F.lit(bits))
    return ids.select(place.alias("p")).groupBy(F.expr("p div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("_bits"))


def maybe_in(df: DataFrame, column: str, bitmap: DataFrame, bits: int = 1 << 24, negate: bool = False) -> DataFrame:
    """Rows whose id may be among those of the bitmap (negate: surely isn't), without a shuffle of ``df``: the broadcast has ``bits``/64 rows at most."""
    names = df.columns
    mark = "_bit"
    while any(n.lower().startswith(mark) for n in names):  # columns of any name may come along
        mark = f"_{mark}"
    place = F.pmod(F.xxhash64(F.col(column), F.lit(17)), F.lit(bits))
    flags = bitmap.select(F.col("_word").alias(f"{mark}_word"), F.col("_bits").alias(f"{mark}_bits"))
    placed = df.withColumn(f"{mark}_place", place).withColumn(f"{mark}_key", F.expr(f"{mark}_place div 64"))
    joined = placed.join(F.broadcast(flags), F.col(f"{mark}_key") == F.col(f"{mark}_word"), "left")
    hit = F.coalesce(f"{mark}_bits", F.lit(0)).bitwiseAND(F.expr(f"shiftleft(1L, cast({mark}_place % 64 as int))")) != 0
    hit = F.coalesce(hit, F.lit(False))
    return joined.where(~hit if negate else hit).select(*[F.col(f"`{n}`") for n in names])


def without_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose id isn't among ``ids`` (null ids stay); only rows that the bounded bitmap flags are shuffled."""
    ids = checkpointed(ids.select(F.col(column)).where(F.col(column).isNotNull()).distinct())
    bitmap = id_filter(ids, column)
    return maybe_in(df, column, bitmap, negate=True).unionByName(maybe_in(df, column, bitmap).join(ids, column, "left_anti").select(*[F.col(f"`{n}`") for n in df.columns]))


class Forest:
    """Union-find over a task's own nodes; roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around each root; flushed now and then, so memory stays bounded."""

    def flush(f: Forest) -> Iterator[pa.RecordBatch]:
        pairs = [(x, f.root(x)) for x in f.up]
        pairs = [(x, r) for x, r in pairs if x != r]
        for k in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs[k : k + 50_000]], pa.int64()) for i in (0, 1)], names=["u", "v"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        if len(forest.up) > 1_000_000:
            yield from flush(forest)
            forest = Forest()
    yield from flush(forest)


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): for each node with an edge the smallest node reachable.

    Tasks first contract their own edges to stars; then large-star and small-star steps
    alternate, each from a checkpoint, until nothing changes. Only counts reach the driver.
    """
    star = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").mapInArrow(_contract, "u long, v long")
    star = checkpointed(star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        star = checkpointed(moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
