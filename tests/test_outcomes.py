"""Pasted links and what becomes of requests, against tables of cases and plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from mediamill.functions import links
from mediamill.operators import fallback, outcomes, search

WATCH = "https://www.youtube.com/watch?v="
CASES = {
    "https://youtu.be/abc?t=3": (WATCH + "abc", "extractable"),
    " youtube.com/watch?list=x&v=a_b-c ": (WATCH + "a_b-c", "extractable"),
    "https://music.youtube.com./live/abc": (WATCH + "abc", "extractable"),
    "http://www.youtube.com/embed/abc/": (WATCH + "abc", "extractable"),
    "https://youtube.com/watch?v=": ("https://youtube.com/watch?v=", "extractable"),
    "https://youtube.com/@someone": ("https://youtube.com/@someone", "extractable"),
    "https://notyoutube.com/watch?v=a": ("https://notyoutube.com/watch?v=a", "unsupported"),
    "bilibili.com/video/BV1?p=2&x=1": ("https://www.bilibili.com/video/BV1?p=2", "extractable"),
    "https://www.bilibili.com/read/1": ("https://www.bilibili.com/read/1", "unsupported"),
    "https://Music.Apple.com/x": ("https://music.apple.com/x", "streaming"),
    "https://apple.com": ("https://apple.com/", "unsupported"),
    "http://e.com:80/a.b/c": ("http://e.com/a.b/c", "unsupported"),
    "http://u:p@e.com:81/x.Flac?y": ("http://e.com:81/x.Flac?y", "audio file"),
    "archive.org/details/x#y": ("https://archive.org/details/x#y", "extractable"),
    "two words.com": None,
    "": None,
    "word": None,
    "ftp://e.com/a.mp3": None,
    "e.com:99999/": None,
}


def test_links(spark):
    df = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "t string").select("t", links.details(F.col("t")).alias("d"), links.meant(F.col("t")).alias("m"))
    for r in df.collect():
        want = CASES.get(r.t)
        assert (None if r.d is None else (r.d.canonical, r.d.verdict)) == want, r.t
        assert r.m.kind == ("text" if want is None else "link" if want[1] in ("audio file", "extractable") else "rejected")
        if want:
            assert r.d.problem == {"streaming": "linkStreaming", "unsupported": "linkUnsupported"}.get(want[1]) and r.m.streaming == {"streaming": True, "unsupported": False}.get(want[1])


def test_failures_mark_the_selected_source(spark):
    sources = spark.createDataFrame([(1, 10, True, "ready", None, "x"), (2, 10, False, "ready", None, "x"), (3, 11, True, "ready", "old", "x")], "id int, track_id int, selected boolean, status string, error string, uri string")
    failures = spark.createDataFrame([(1, 10, "first", "download"), (2, 10, "last", None), (3, 99, "gone", "songGone")], "seq int, track_id int, message string, problem string")
    sources_, events = outcomes.note_failures(sources, failures)
    assert {r.id: (r.status, r.error, r.uri) for r in sources_.collect()} == {1: ("failed", "last", "x"), 2: ("ready", None, "x"), 3: ("ready", "old", "x")}
    assert sorted(map(tuple, events.collect())) == [(1, "failed", 10, "first", "download"), (2, "failed", 10, "last", None), (3, "failed", 99, "gone", "songGone")]


def test_lyrics_looked_up_again(spark):
    tracks = spark.createDataFrame(
        [(1, "Paper Boats", "Juniper", "Al", 200_000, False), (2, "Dani Sato", "Overpass", None, 100_000, False), (3, "Dani Sato", "Overpass", None, 100_000, True), (4, "Nobody", "No", None, 1_000, False), (5, "Paper Boats", "Juniper", None, 200_000, False)],
        "id int, title string, artist string, album string, duration_ms long, info_edited boolean",
    )
    lyrics = spark.createDataFrame([(1, "service", "old", 5), (4, "none", None, 7), (5, "service", "kept", 5)], "track_id int, source string, lyrics string, fetched_at long")
    sources = spark.createDataFrame([(k, k, 40 * (k % 2), k == 3) for k in range(1, 6)], "id int, track_id int, offset_ms long, manual boolean")
    hits = spark.createDataFrame([("Paper Boats", "Juniper", 200.0, "[00:01.00]new", 1), ("Overpass", "Dani Sato", 100.0, "[00:01.00]bridge", 2)], "hit_title string, hit_artist string, hit_length double, lyrics string, ord int")
    asked = spark.createDataFrame([(k,) for k in (1, 1, 2, 3, 4, 99)], "track_id int")
    got = outcomes.look_up_again(asked, tracks, lyrics, sources, lambda songs: fallback.find_lyrics(songs, hits, search.best_synced), 900)
    assert {r.track_id: (r.source, r.lyrics, r.fetched_at) for r in got.lyrics.collect()} == {1: ("service", "[00:01.00]new", 900), 2: ("swapped", "[00:01.00]bridge", 900), 3: ("swapped", "[00:01.00]bridge", 900), 4: ("none", None, 7), 5: ("service", "kept", 5)}
    assert {r.id: (r.offset_ms, r.manual) for r in got.sources.collect()} == {1: (0, False), 2: (0, False), 3: (0, False), 4: (0, False), 5: (40, False)}
    assert [tuple(r) for r in got.edits.collect()] == [(2, 2, "Overpass", "Dani Sato", None)]
    assert sorted(map(tuple, got.events.collect())) == [(1, "lyricOffset"), (1, "lyrics"), (2, "lyrics"), (2, "renamed"), (3, "lyricOffset"), (3, "lyrics")]
    week = 7 * 86_400_000
    assert sorted(r.id for r in outcomes.lyrics_due(lyrics, tracks, 8 + week).collect()) == [2, 3, 4] and sorted(r.id for r in outcomes.lyrics_due(lyrics, tracks, 7 + week).collect()) == [2, 3]


def test_parts_or_why_not(spark):
    chunks = spark.createDataFrame([("h", 0, [1.0, 2.0], [3.0, 4.0])], "audio_hash string, index int, left array<double>, right array<double>")
    mixes = spark.createDataFrame([("h", 0, [5.0, 5.0, 9.0], [5.0, 5.0, 9.0]), ("h", 1, [1.0], [1.0])], chunks.schema)
    sources = spark.createDataFrame([(1, True, "h"), (1, False, "g"), (2, True, None), (3, True, "k")], "track_id int, selected boolean, audio_hash string")
    separations = spark.createDataFrame([("h",), ("h",), ("g",)], "audio_hash string")
    wanted = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (9, 0)], "track_id int, index int")
    got = {(r.track_id, r["index"]): (r.vocals, r.instrumental, r.problem) for r in outcomes.parts_of(wanted, sources, separations, chunks, mixes).collect()}
    assert got == {(1, 0): ([1, 3, 2, 4], [4, 2, 3, 1], None), (1, 1): (None, None, "partNotReady"), (2, 0): (None, None, "notPrepared"), (3, 0): (None, None, "notPrepared"), (9, 0): (None, None, "notPrepared")}


def test_guests_ask_once(spark):
    r = random.Random(5)
    rows = [(g, k, r.choice(["player", "player", "lyricsChanged", "clock"]), r.choice([None, 1, 2, 3])) for g in range(12) for k in range(40)]
    want = []
    for g in range(12):
        current = asked = None
        for _, k, kind, track in (x for x in rows if x[0] == g):
            if kind == "player":
                current = track
            elif kind == "lyricsChanged" and track is not None and track == current:
                asked = None
            else:
                continue
            if current is not None and current != asked:
                asked = current
                want.append((g, k, current))
    df = spark.createDataFrame(rows, "guest int, seq int, kind string, track_id int")
    assert sorted(map(tuple, outcomes.ask_once(df).collect())) == want


def test_orders_and_codes(spark):
    one, two = ([r.id for r in outcomes.shuffled(spark.range(50).repartition(n), "id", 3).collect()] for n in (1, 7))
    assert one == two != sorted(one) and sorted(one) == list(range(50)) and [r.id for r in outcomes.shuffled(spark.range(50), "id", 4).collect()] != one
    codes = spark.createDataFrame([(7,), (65_535,), (10_000,)], "n int").select(outcomes.join_code(F.col("n")).alias("c")).collect()
    assert [r.c for r in codes] == ["0007", "5535", "0000"]
