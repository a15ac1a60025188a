"""Queries and their SQL on small tables of odd values."""

from __future__ import annotations

import struct
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from mediamill.plans import imports, lookups, registry, signals, text


def _same(got, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    want = con.sql(sql).df()
    rows = lambda df: sorted(map(tuple, df[want.columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_instrumental_knows_ascii_letters_and_one_word(spark):
    texts = ["der instöä x", "an inst.", "instead", "Instru-men tal", "karaoke", "伴奏", "inst2", "éinst", "inst"]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = text.q_instrumental(SimpleNamespace(documents=spark.createDataFrame(documents))).toPandas()
    _same(got, registry.ORACLES["q_instrumental"], documents=documents)


def test_interleave_rounds_single_precision(spark):
    half = struct.unpack("f", struct.pack("f", 0.3195))[0]  # times 1000: 319.5 in single, 319.4999993 in double precision
    vectors = [[0.001 * i for i in range(64)], [half if i == 17 else -half if i == 40 else 0.0 for i in range(64)]]
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    df = spark.createDataFrame(list(enumerate(vectors)), kind)
    got = signals.q_interleave(SimpleNamespace(embeddings=df)).toPandas()
    _same(got, registry.ORACLES["q_interleave"].replace("FROM embeddings", "FROM (SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM embeddings)"), embeddings=pd.DataFrame({"vec_id": [0, 1], "embedding": vectors}))


@pytest.mark.parametrize("name", ["q_clean_title", "q_fetched"])
def test_parts_of_one_file_are_dealt_to_all_cores(spark, name):
    rows = [(i, f"{a} ring", f"Brand#{i % 5}", "SMALL", i % 9, 100.0 + i) for i, a in enumerate(["red", "hot", "cold", "small"] * 5)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1)
    query = {"q_clean_title": text.q_clean_title, "q_fetched": imports.q_fetched}[name]
    got = query(SimpleNamespace(part=part))
    assert got.rdd.getNumPartitions() == 4
    if name in registry.ORACLES:
        _same(got.toPandas(), registry.ORACLES[name], part=part.toPandas())
    else:
        assert {(r.id, r.name, r.singer) for r in got.collect()} == {(i, n, None) for i, n, *_ in rows}


def test_videos_of_one_file_are_dealt_to_all_cores(spark):
    rows = [(i, i % 37, ["view", "click", "error", "signup", "purchase"][i * i % 5]) for i in range(2600)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1)
    assert lookups.video_pages(events).rdd.getNumPartitions() == 4
    got = lookups.q_nested_videos(SimpleNamespace(events=events))
    assert got.rdd.getNumPartitions() == 4
    shown = "coalesce(CAST(duration_ms AS STRING), '')"
    _same(got.withColumn("duration_ms", F.expr(shown)).toPandas(), f"SELECT * REPLACE ({shown} AS duration_ms) FROM ({registry.ORACLES['q_nested_videos']})", events=events.toPandas())
