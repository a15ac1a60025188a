from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mediamill.functions import columns as x, kernels
from mediamill.operators import alignment, catalogue as c, lyrics, playqueue, signals, timeline as tl
from mediamill.streaming import rooms


def lrc(spark, text, duration):
    rows = lyrics.parse_lrc(spark.createDataFrame([(1, text, duration)], "track_id long, text string, duration_ms long")).orderBy("start_ms").collect()
    return [(r.start_ms, r.end_ms, r.text, r.voice) for r in rows]


def test_lrc(spark):
    assert [r[:2] for r in lrc(spark, "[ar:x]\n[00:02.00]a b\n[00:06.50]c", 12000)] == [(2000, 6500), (6500, 12000)]
    got = lrc(spark, "[00:01.5][00:20.123]chorus\n[00:04.00]\n[00:10.00][01:02:50]verse", 30000)
    assert [(r[0], r[2]) for r in got][:2] == [(1500, "chorus"), (10000, "verse")]
    assert got[0][1] == 4000
    assert lrc(spark, "[1:00]x", 0)[0][:2] == (60000, 65000)
    duet = lrc(spark, "[00:01.00]M: a\n[00:02.00]b\n[00:03.00]F: c\n[00:04.00]Both: d\n[00:05.00]Time: e", 14000)
    assert [r[3] for r in duet] == ["M", "M", "F", "Both", "Both"] and duet[-1][2] == "Time: e"


def test_words_and_timeline(spark):
    row = spark.range(1).select(x.spread_words(F.lit("one two three"), F.lit(0).cast("long"), F.lit(30000).cast("long")).alias("w")).first()
    assert [(w.start_ms, w.end_ms) for w in row.w] == [(0, 600), (600, 1200), (1200, 1800)]
    lines = spark.createDataFrame([(1, 5000, 9000, "a"), (1, 9000, 13000, "b"), (1, 20000, 24000, "c")], "track_id long, start_ms long, end_ms long, text string").withColumn("words", F.array().cast("array<struct<text string, start_ms long, end_ms long>>"))
    rows = lyrics.timeline(lines).orderBy("start_ms").collect()
    assert [(r.kind, r.start_ms, r.end_ms) for r in rows] == [("gap", 0, 5000), ("line", 5000, 9000), ("line", 9000, 13000), ("gap", 13000, 20000), ("line", 20000, 24000)]


def test_eviction(spark):
    rows = [("s", 0, 40, 3, True, False), ("s", 1, 40, 1, True, False), ("s", 2, 40, 2, True, False)]
    df = spark.createDataFrame(rows, "scope string, id long, size long, last_used long, ready boolean, protected boolean")
    gone = lambda budget: sorted(r.id for r in c.evict(df, F.lit(budget), "scope").collect())
    assert (gone(100), gone(40), gone(120)) == ([1], [1, 2], [])


def test_prefix_and_breaths(spark):
    chunks = spark.createDataFrame([("a", i) for i in (0, 1, 3, 3)] + [("b", 1)], "k string, i long")
    assert {r.k: r.contiguous for r in c.prefix_length(chunks, "k", "i").collect()} == {"a": 2, "b": 0}
    on = [i < 10 or 20 <= i < 30 or i > 44 for i in range(50)]
    hops = spark.createDataFrame([("a", i, v) for i, v in enumerate(on)], "k string, i long, on boolean")
    got = [r.on for r in tl.fill_breaths(hops, "k", "i", "on", 12).orderBy("i").collect()]
    assert got == [i < 30 or i > 44 for i in range(50)]


def test_move(spark):
    m = spark.createDataFrame([(1, t, i) for i, t in enumerate([10, 11, 12])], "collection_id long, track_id long, position long")
    for to, want in ((0, [12, 10, 11]), (1, [10, 12, 11]), (2, [10, 11, 12])):
        moves = spark.createDataFrame([(1, 12, to)], "collection_id long, track_id long, to long")
        rows = c.move_in_list(m, moves).orderBy("position").collect()
        assert [r.track_id for r in rows] == want and [r.position for r in rows] == [0, 1, 2]


def test_lag(spark):
    r = np.random.default_rng(4)
    song = np.repeat(r.random(120) < 0.5, 9)
    a = spark.createDataFrame([(i, bool(v)) for i, v in enumerate(song)], "hop long, on boolean")
    b = spark.createDataFrame([(i + 17, bool(v)) for i, v in enumerate(song)], "hop long, on boolean")
    best = tl.best_lag(alignment.phi_at_lags(a, b, -30, 30, 200), 0.3).first()
    assert (best.lag, best.phi) == (17, 1.0)
    flat = a.withColumn("on", F.lit(True))
    assert alignment.phi_at_lags(flat, b, 0, 0, 1).first().phi == 0.0


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 2, 0), ("b", 3, 9)], "k string, id long, t long")
    right = spark.createDataFrame([("a", 4, 0, 1.0), ("a", 5, 1, 2.0), ("a", 5, 2, 3.0), ("a", 6, 3, 4.0)], "k string, s long, i long, v double")
    for span in (None, lambda t: F.floor(t / 2), lambda t: t):
        got = {r.id: r.v for r in tl.as_of(left, right, "k", "t", "s", "v", "i", span).collect()}
        assert got == {1: 3.0, 2: None, 3: None}


def test_signals(spark):
    i = np.arange(1000)
    song = 0.4 * np.sin(0.3 * i) + 0.3 * np.cos(0.071 * i)
    assert kernels.stft(song[:40], 16, 4).shape == (11, 9)
    assert np.abs(kernels.istft(kernels.stft(song, 64, 16), 64, 16, 1000) - song).max() < 1e-4
    rate = 8000
    assert abs(kernels.pitch(np.sin(2 * np.pi * 220 * np.arange(800) / rate), rate) - 220) < 1
    assert kernels.pitch(np.zeros(10), rate) is None
    assert len(kernels.resample(song, 48000)) == 1000 * 44100 // 48000
    peaks = kernels.spectral_peaks(np.sin(2 * np.pi * 100 * np.arange(1024) / 1024))
    assert peaks[0][0] == 100
    out, gain = kernels.limit(np.sign(np.sin(np.arange(2000) / 20)) * 4.0, 1.0, 44100)
    assert 0.5 < np.abs(out).max() <= 0.89 + 1e-9 and gain < 1
    songs = spark.createDataFrame([("h", song[:300].tolist())], "audio_hash string, samples array<double>")
    rows = signals.separate(songs, signals.passthrough, 100, 64, 16).orderBy("start").collect()
    assert [len(r.vocals) for r in rows] == [100, 100, 100]
    whole = np.concatenate([np.add(r.vocals, r.instrumental) for r in rows])
    assert np.abs(whole - song[:300]).max() < 1e-9
    again = signals.regroup(signals.separate(songs, signals.silence, 100, 64, 16), "audio_hash", "start", "instrumental", 70).orderBy("index").collect()
    assert [len(r.samples) for r in again] == [70, 70, 70, 70, 20]


def test_clock(spark):
    row = spark.range(1).select(x.clock_ms(F.lit("1:02:03")).alias("a"), x.clock_text(F.lit(62999)).alias("b"), x.stamp_ms(F.lit("1:02.5")).alias("c"), x.stamp_ms(F.lit("0:61.0")).alias("d"), x.clock_text(F.lit(None).cast("long")).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (3723000, "1:02", 62500, None, "")


def test_queue(spark):
    q = playqueue.Queue()
    q.apply("add", track=1)
    q.apply("add", track=2)
    q.apply("next", track=3)
    assert [t for _, t in q.entries] == [1, 3, 2] and q.current == 0
    q.apply("move", key=1, to=0)
    assert [t for _, t in q.entries] == [1, 2, 3]
    q.apply("skip", delta=9)
    assert q.current == 0
    q.apply("finish")
    q.apply("finish")
    q.apply("finish")
    assert q.ended
    q.apply("add", track=9)
    assert q.entries[q.current][1] == 9 and not q.ended
    log = spark.createDataFrame([(1, 0, "add", 5), (1, 1, "add", 6), (1, 2, "remove_track", 5), (2, 0, "add", 7)], "session long, seq long, op string, track long").select("*", *[F.lit(None).cast("long").alias(n) for n in ("key", "to", "delta")])
    rows = {r.session: (r.tracks, r.current) for r in playqueue.fold(log).collect()}
    assert rows == {1: ("6", 6), 2: ("7", 7)}


def test_admissions_stream_equals_batch(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(int(r.integers(3)), i, int(t), bool(r.random() < 0.4)) for i, t in enumerate(np.cumsum(r.integers(1, 4000, 200)))]
    df = spark.createDataFrame(rows, "user_id long, event_id long, now_ms long, good_code boolean")
    for k in range(2):
        df.where(f"event_id div 100 = {k}").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rooms.stream_admissions(stream).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda rows_: sorted((x.event_id, x.verdict) for x in rows_)
    assert key(spark.table("admitted").collect()) == key(rooms.admissions(df).collect())
