"""Nested search, lookups in turn, aligned series and presence, each against a plain version."""

from __future__ import annotations

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediamill.operators import alignment, fallback, nested, search
from mediamill.streaming import presence


def walk(v, key, out):
    if isinstance(v, dict):
        if key in v:
            out.append(v[key])
        else:
            for k in sorted(v):
                walk(v[k], key, out)
    elif isinstance(v, list):
        for x in v:
            walk(x, key, out)


def some_json(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.2:
        return r.choice([None, 1, "k", True, "", 2.5])
    if kind < 0.6:
        return {r.choice(["k", "a", "b", "it's", "z z"]): some_json(r, depth - 1) for _ in range(r.randint(0, 4))}
    return [some_json(r, depth - 1) for _ in range(r.randint(0, 4))]


@pytest.mark.parametrize("levels", [3, 16])
def test_find_key_equals_a_walk(spark, levels):
    r = random.Random(4)
    bodies = [json.dumps(some_json(r, r.randint(0, 9))) for _ in range(150)] + ['{"k":', None, "", "[]", '{"k":null}', '{"a":{"k":{"k":1}},"k":2}']
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got: dict = {}
    for row in nested.find_key(df, "id", "body", "k", levels).select("id", "path", F.to_json("value").alias("v")).collect():
        got.setdefault(row.id, []).append((row.path, json.loads(row.v)))
    for k, body in enumerate(bodies):
        want: list = []
        try:
            walk(json.loads(body), "k", want)
        except (TypeError, ValueError):
            pass
        assert [v for _, v in sorted(got.get(k, []), key=lambda x: x[0])] == want, body


def video(name, title="T", **more):
    return {"videoRenderer": {"videoId": name, "title": {"simpleText": title}, **more}}


def test_videos_come_once_and_none_live(spark):
    live = {"badges": [{"metadataBadgeRenderer": {"style": "BADGE_STYLE_TYPE_LIVE_NOW"}}]}
    body = {"a": [video("x", "live", **live), {"s": {"c": [video("y", lengthText={"runs": [{"text": "1:0"}, {"text": "2:03"}]}, ownerText={"runs": [{"text": "Some"}, {"no": 1}, {"text": "one"}]})]}}, video("x", "later", longBylineText={"simpleText": "By"}), video("y", "again")]}
    body["b"] = [video("z", upcomingEventData={}), video(7), {"videoRenderer": {"videoId": "t"}}, video("w", thumbnail={"thumbnails": [{"url": "u"}, {"url": "v"}]}, lengthText={"simpleText": "LIVE"})]
    rows = nested.videos(spark.createDataFrame([(1, json.dumps(body), "x")], "id int, body string, url string"), "id", "body").orderBy("ord").collect()
    head = "https://www.youtube.com/watch?v="
    assert [tuple(r)[1:] for r in rows] == [(1, head + "y", "T", "Someone", 3_723_000, None), (2, head + "x", "later", "By", None, None), (3, head + "w", "T", None, None, "u")]
    assert nested.videos(spark.createDataFrame([(1, json.dumps(body))], "id int, body string"), "id", "body", 2).count() == 2

def test_only_texts_are_read_as_texts(spark):
    odd = {"ownerText": {"simpleText": 2.5}, "longBylineText": {"runs": [{"text": True}, None, {"text": "B"}]}, "lengthText": {"simpleText": 61}, "thumbnail": {"thumbnails": [{"url": 1e300}, {"url": "u"}]}}
    calm = {"badges": [None, 3, {"metadataBadgeRenderer": {"style": 1}}, {"metadataBadgeRenderer": "BADGE_STYLE_TYPE_LIVE_NOW"}], "ownerText": "x"}
    body = [video("a", title=7), video(True), video("b", **odd), video("c", **calm), video("d", upcomingEventData=None), {"videoRenderer": [video("e")]}, {"videoRenderer": None}, {"videoRenderer": "f"}]
    rows = nested.videos(spark.createDataFrame([(1, json.dumps(body))], "id int, body string"), "id", "body").orderBy("ord").collect()
    assert [(r.url[-1], r.title, r.channel, r.duration_ms, r.thumbnail) for r in rows] == [("b", "T", "B", None, None), ("c", "T", None, None, None)]


def test_keys_of_any_signs_and_values_read_at_once(spark):
    df = spark.createDataFrame([(1, json.dumps({"x": [{"it's": "7"}, {"a`b": 2}]}))], "id int, body string")
    assert [r.v for r in nested.find_key(df, "id", "body", "it's", 2).select(F.to_json("value").alias("v")).collect()] == ['"7"']
    assert [r.value for r in nested.find_key(df, "id", "body", "a`b", 2, lambda v: F.try_variant_get(v, "$", "int")).collect()] == [2]


# ---- alignment


def by_lag(first, second, low, high):
    out = {}
    for lag in range(low, high + 1):
        pairs = [(a, second[h + lag]) for h, a in first.items() if h + lag in second]
        if pairs:
            out[lag] = (len(pairs), sum(a and b for a, b in pairs), sum(a for a, _ in pairs), sum(b for _, b in pairs))
    return out


@pytest.mark.parametrize("segment, low, high", [(64, -70, 130), (128, -3, 2), (4096, -200, -100), (64, 5, 5)])
def test_counts_at_all_lags_equal_a_loop(spark, segment, low, high):
    r = random.Random(segment)
    series = {k: [{h + shift: r.random() < 0.4 for h in range(-20, n) if r.random() < 0.9} for shift in (0, 3)] for k, n in (("a", 300), ("b", 64), ("c", 1))}
    of = lambda i: spark.createDataFrame([(k, h, on) for k, s in series.items() for h, on in s[i].items()] + [(None, 1, True), ("d", None, True)], "key string, hop long, on boolean")
    got: dict = {}
    for row in alignment.counts_by_lag(of(0), of(1), low, high, "key", segment).collect():
        got.setdefault(row.key, {})[row.lag] = (row.n, row.n11, row.n1x, row.nx1)
    assert got == {k: x for k, (a, b) in series.items() if (x := by_lag(a, b, low, high))}


def test_a_long_series_is_found_at_its_shift(spark):
    on = np.random.default_rng(1).random(30_000) < 0.3
    words = spark.createDataFrame(pd.DataFrame({"song": 1, "hop": np.arange(len(on)), "on": on}))
    sung = words.withColumn("hop", F.col("hop") + 777)
    scores = alignment.phi_at_lags(words, sung, -1200, 2400, 1200, "song")
    assert alignment.clear_offsets(scores, "song").first()[:] == (1, 777, 1.0)
    assert scores.count() == 3601


def test_songs_are_aligned_once_for_each_version(spark):
    r = random.Random(2)
    on = [r.random() < 0.4 for _ in range(400)]
    hops = lambda shift, songs: spark.createDataFrame([(s, h + shift, x) for s in songs for h, x in enumerate(on)], "song int, hop long, on boolean")
    flat = spark.createDataFrame([(5, h, True) for h in range(400)], "song int, hop long, on boolean")
    sung, words = hops(30, (1, 2, 3, 4)).unionByName(flat), hops(0, (1, 2, 3, 4, 5))
    lyrics = spark.createDataFrame([(k, 100 + k) for k in range(1, 6)], "song int, fetched_at long")
    # 1 is due, 2 set by hand, 3 not ready, 4 done with these lyrics, 5 has no clear offset
    rows = [(1, True, False, None, 0), (2, True, True, None, 7), (3, False, False, None, 8), (4, True, False, 104, 9), (5, True, False, 99, 11)]
    sources = spark.createDataFrame(rows, "song int, ready boolean, manual boolean, synced_at long, offset_ms long")
    run = lambda s: alignment.align(s, lyrics, sung, words, "song", -50, 100, 100)
    once = run(sources).orderBy("song").collect()
    assert [(r.song, r.synced_at, r.offset_ms) for r in once] == [(1, 101, 1500), (2, None, 7), (3, None, 8), (4, 104, 9), (5, 105, 11)]
    again = spark.createDataFrame(once, sources.schema)
    assert alignment.due(again, lyrics, "song").count() == 0
    assert run(again).orderBy("song").collect() == once


# ---- lookups in turn


def test_each_source_sees_what_is_still_open(spark):
    asked: dict = {}

    def source(name, knows):
        def ask(open_):
            asked[name] = sorted(r.k for r in open_.collect())
            return spark.createDataFrame([(k, f"{name}{k}") for k in knows], "k int, answer string")

        return name, ask

    questions = spark.createDataFrame([(k,) for k in range(8)], "k int")
    found = fallback.answer_in_turn(questions, "k", [source("a", [1, 1, 99]), source("b", [1, 2, 3]), source("c", []), source("d", [3, 4])], "none")
    assert {r.k: (r.source, r.answer) for r in found.collect()} == {0: ("none", None), 1: ("a", "a1"), 2: ("b", "b2"), 3: ("b", "b3"), 4: ("d", "d4"), **{k: ("none", None) for k in (5, 6, 7)}}
    assert asked == {"a": list(range(8)), "b": [0, 2, 3, 4, 5, 6, 7], "c": [0, 4, 5, 6, 7], "d": [0, 4, 5, 6, 7]}


def test_lyrics_of_the_file_then_the_service_then_swapped(spark):
    songs = spark.createDataFrame(
        [(1, "Paper Boats", "Juniper", 200.0, "[00:01.00]own"), (2, "Paper Boats", "Juniper", 200.0, "no stamps"), (3, "Dani Sato", "Overpass", 100.0, None), (4, "Nobody", None, 100.0, None)], "id int, title string, artist string, length double, embedded string"
    )
    hits = spark.createDataFrame([("Paper Boats", "Juniper", 200.0, "[00:01.00]sync", 1), ("Paper Boats", "Juniper", 200.0, "plain", 2), ("Overpass", "Dani Sato", 101.0, "[00:01.00]bridge", 3)], "hit_title string, hit_artist string, hit_length double, lyrics string, ord int")
    got = {r.id: (r.source, r.lyrics, r.name, r.singer) for r in fallback.find_lyrics(songs, hits, search.best_synced).collect()}
    assert got == {1: ("embedded", "[00:01.00]own", None, None), 2: ("service", "[00:01.00]sync", None, None), 3: ("swapped", "[00:01.00]bridge", "Overpass", "Dani Sato"), 4: ("none", None, None, None)}


# ---- presence


def test_silence_expiry_and_removal(spark):
    rows = [(1, 0, "join"), (1, 4_000, "frame"), (1, 9_000, "frame"), (1, 9_500, "join"), (2, 0, "join"), (2, 1_000, "leave"), (2, 1_001, "frame"), (3, 0, "kick"), (3, 5, "join"), (4, 0, "join"), (4, 125_000, "join")]
    df = spark.createDataFrame([(p, t, k, kind) for k, (p, t, kind) in enumerate(rows)], "phone long, at_ms long, seq long, kind string")
    got = sorted(((r.phone, r.at_ms, r.what) for r in presence.presence(df, until=130_000).collect()))
    assert got == [(1, 0, "joined"), (1, 9_000, "silent"), (1, 9_500, "back"), (1, 14_500, "silent"), (2, 0, "joined"), (2, 1_000, "left"), (3, 0, "kicked"), (3, 5, "refused"), (4, 0, "joined"), (4, 5_000, "silent"), (4, 125_000, "gone"), (4, 125_000, "joined"), (4, 130_000, "silent")]


def test_stream_with_timers_equals_batch(spark, tmp_path):
    """Three files out of order within the delay; one row comes later than that and drops out of both."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(6)
    kinds = ["join"] * 3 + ["frame"] * 6 + ["leave", "kick"]
    rows = [(p, int(t), r.choice(kinds)) for p in range(6) for t in sorted(r.sample(range(400_000), 40))]
    rows = [(p, t, k, kind, min(2, max(0, t + r.randint(-4_000, 4_000)) // 150_000)) for k, (p, t, kind) in enumerate(rows)]
    late = (0, 1_000, 9_999, "leave", 2)
    schema = "phone long, at_ms long, seq long, kind string, file long"
    df = spark.createDataFrame([*rows, late], schema).withColumn("at", F.timestamp_millis("at_ms"))
    for k in range(3):
        df.where(f"file = {k}").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    end = spark.createDataFrame([(99, 600_000, 0, "frame", 3)], schema).withColumn("at", F.timestamp_millis("at_ms"))
    end.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("file")
    q = presence.stream_presence(stream).writeStream.format("memory").queryName("presence").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = presence.presence(spark.createDataFrame(rows, schema), until=590_000)
    key = lambda d: sorted((x.phone, x.at_ms, x.what, x.seq or -1) for x in d.collect())
    assert key(spark.table("presence")) == key(batch)
