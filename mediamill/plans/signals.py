"""Queries over arrays: embeddings play audio frames of 64 samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as x
from ..operators import signals as s
from .registry import Tables, query


@query("SELECT vec_id, round(10 * log10(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / len(embedding) + 1e-10), 6) AS db FROM embeddings")
def q_frame_power_db(t: Tables) -> DataFrame:
    return s.power_db(t.embeddings, "embedding").select("vec_id", F.round("db", 6).alias("db"))


@query(
    """SELECT a.vec_id, round(10 * log10(list_sum(list_transform(a.embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / (list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) + 1e-12)), 4) AS sdr_db
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def q_sdr(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("ref"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("est"))
    both = a.join(b, "vec_id")
    error = F.zip_with("ref", "est", lambda p, q: p - q)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y * y)
    return both.select("vec_id", F.round(10 * F.log10(square(F.col("ref")) / (square(error) + 1e-12)), 4).alias("sdr_db"))


@query("SELECT vec_id, CAST(len(embedding) // 2 * 2 AS BIGINT) AS n, list_sum(list_transform(range(1, 33), lambda i: i * (CAST(round(embedding[i] * 1000) AS BIGINT) - CAST(round(embedding[i + 32] * 1000) AS BIGINT))))::BIGINT AS mark FROM embeddings")
def q_interleave(t: Tables) -> DataFrame:
    both = x.interleave(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    # in single precision, as the samples are: a product that is rounded to a half there isn't one in double precision
    mille = lambda k: F.round(F.element_at("both", k.cast("int")) * F.lit(1000).cast("float")).cast("long")
    pair = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: i * (mille(2 * i - 1) - mille(2 * i)))
    return t.embeddings.select("vec_id", both.alias("both")).select("vec_id", F.size("both").cast("long").alias("n"), F.aggregate(pair, F.lit(0).cast("long"), lambda a, v: a + v).alias("mark"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 0.5 - CAST(v AS DOUBLE))), 6) AS total FROM embeddings")
def q_scale_diff(t: Tables) -> DataFrame:
    values = F.col("embedding").cast("array<double>")
    diff = F.zip_with(F.transform(values, lambda v: v * 0.5), values, lambda a, b: a - b)
    return t.embeddings.select("vec_id", F.round(F.aggregate(diff, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(
    """SELECT label, (pos // 100)::BIGINT AS index, count(*) AS n FROM (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 + unnest(range(0, 64)) AS pos FROM embeddings) GROUP BY 1, 2"""
)
def q_regroup(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    start = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1) * 64
    pieces = t.embeddings.select("label", start.cast("long").alias("start"), "embedding")
    return s.regroup(pieces, "label", "start", "embedding", 100).select("label", "index", F.size("samples").cast("long").alias("n"))


@query("SELECT l_orderkey AS id, CAST(ceil(sum(l_quantity) / 10.0) AS BIGINT) AS chunks FROM lineitem GROUP BY 1")
def q_chunk_plan(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(x.chunk_count(F.sum("l_quantity"), 10).cast("long").alias("chunks"))


@query("SELECT l_orderkey AS id, l_linenumber AS c, greatest(l_linenumber - 1, 0) AS first, least(l_linenumber + 3, 6) AS last FROM lineitem")
def q_window_range(t: Tables) -> DataFrame:
    first, last = x.decode_window(F.col("l_linenumber"), F.lit(7))
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("c"), first.alias("first"), last.alias("last"))


@query("SELECT l_orderkey AS id, l_linenumber AS c, CAST(CASE WHEN l_linenumber >= 7 THEN 65.0 ELSE least(l_linenumber * 10.0, 65.0) END AS DOUBLE) AS ready_s, CASE WHEN l_linenumber >= 7 THEN 65.0 ELSE least(l_linenumber * 10.0, 65.0) END >= 6 AS can_start FROM lineitem")
def q_ready_eta(t: Tables) -> DataFrame:
    ready = F.when(F.col("l_linenumber") >= 7, F.lit(65.0)).otherwise(F.least(F.col("l_linenumber") * F.lit(10.0), F.lit(65.0)))
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("c"), ready.alias("ready_s"), (ready >= 6).alias("can_start"))


@query("SELECT vec_id, round(greatest(least((20 * log10(greatest(list_max(list_transform(embedding, lambda v: abs(v)))::DOUBLE, 1e-6)) + 50) / 50, 1.0), 0.0), 6) AS level FROM embeddings")
def q_loudness(t: Tables) -> DataFrame:
    peak = F.array_max(F.transform("embedding", lambda v: F.abs(v))).cast("double")
    return t.embeddings.select("vec_id", F.round(x.loudness(peak), 6).alias("level"))


@query()
def q_stft_power(t: Tables) -> DataFrame:
    frames = s.spectrum(t.embeddings.select("vec_id", "embedding"), "embedding", 16, 4)
    power = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda a, v: a + v)
    return frames.select("vec_id", "frame", F.round(power, 6).alias("power"))


@query()
def q_yin(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(s.pitch_of("embedding", 8000.0), 3).alias("hz"))


@query()
def q_howl(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.posexplode(s.peaks_of("embedding")).alias("rank", "p")).select("vec_id", "rank", F.col("p.bin").alias("bin"), F.round("p.power", 6).alias("power"))


@query()
def q_separate_passthrough(t: Tables) -> DataFrame:
    songs = t.embeddings.select(F.col("vec_id").alias("audio_hash"), F.col("embedding").cast("array<double>").alias("samples"))
    out = s.separate(songs, s.passthrough, 24, 16, 4)
    return out.select("audio_hash", "start", F.transform("vocals", lambda v: F.round(v, 6)).alias("vocals"), F.size("instrumental").alias("n"))
