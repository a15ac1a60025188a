"""Edits, upgrades, resumed work, other rates and scripts, unreadable rows and events for queued songs, each against a plain version."""

from __future__ import annotations

import errno
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediamill.functions import scripts
from mediamill.operators import editing, migrations, resume, search, signals
from mediamill.sources import quarantine
from mediamill.streaming import fanout

# ---- edits


def plain_edit(tracks, collections, members, edits):
    """The change set, step by step on dictionaries."""
    last = {}
    for e in sorted(edits, key=lambda e: e[1]):
        if e[0] in tracks:
            last[e[0]] = e
    edits = sorted(last.values(), key=lambda e: (e[1], e[0]))
    tracks = {**tracks, **{e[0]: e[2:] for e in edits}}
    members = {c: dict(m) for c, m in members.items()}
    for c, (kind, _, _, _) in collections.items():
        for e in edits:
            if kind != "playlist":
                members.get(c, {}).pop(e[0], None)
    asked = []
    for track, _, _, artist, album in edits:
        asked.append((track, "playlist", "imported", "Imported", None))
        if artist is not None:
            asked.append((track, "artist", f"artist:{artist.lower()}", artist, None))
        if album is not None:
            asked.append((track, "album", f"album:{(artist or '').lower()}:{album.lower()}", album, artist))
    by_ref = {(kind, ref): c for c, (kind, ref, _, _) in collections.items()}
    collections = dict(collections)
    first = {}
    for n, (track, kind, ref, _, _) in enumerate(asked):
        first.setdefault((kind, ref), (last[track][1], kind, ref))
    top = max(collections, default=0)
    for key in sorted((k for k in first if k not in by_ref), key=lambda k: first[k]):
        top += 1
        by_ref[key] = top
    for track, kind, ref, name, subtitle in asked:
        c = by_ref[kind, ref]
        collections[c] = (kind, ref, name, subtitle)
        own = members.setdefault(c, {})
        if track not in own:
            ends = own.values()
            own[track] = (min(ends) - 1 if ends else 0) if kind == "playlist" else (max(ends) + 1 if ends else 0)
    collections = {c: v for c, v in collections.items() if v[0] == "playlist" or members.get(c)}
    return tracks, collections, {c: m for c, m in members.items() if m}


@pytest.mark.parametrize("seed", range(3))
def test_edits_equal_a_plain_version(spark, seed):
    r = random.Random(seed)
    name = lambda: r.choice(["Juniper", "juniper", "Dani", "Ü", None])
    tracks = {k: (f"T{k}", name(), name()) for k in range(20)}
    collections = {1: ("playlist", "user:1", "Mine", None), 2: ("artist", "artist:juniper", "Juniper", None), 3: ("album", "album:juniper:dani", "Dani", "Juniper"), 4: ("artist", "artist:old", "Old", None)}
    if seed:
        collections[7] = ("playlist", "imported", "Imported", None)
    members = {c: {t: n * 2 for n, t in enumerate(r.sample(range(20), 4))} for c in collections}
    edits = [(r.choice([*range(20), 99]), k, f"N{k}", name(), name()) for k in range(12)]
    shelves = editing.Shelves(
        spark.createDataFrame([(k, *v, "x") for k, v in tracks.items()], "id long, title string, artist string, album string, more string"),
        spark.createDataFrame([(k, "local", *v) for k, v in collections.items()], "id long, provider string, kind string, provider_ref string, name string, subtitle string"),
        spark.createDataFrame([(c, t, p) for c, m in members.items() for t, p in m.items()], "collection_id long, track_id long, position long"),
    )
    got = editing.edit_info(shelves, spark.createDataFrame(edits, "track_id long, ord long, title string, artist string, album string"))
    want = plain_edit(tracks, collections, members, edits)
    assert {x.id: (x.title, x.artist, x.album) for x in got.tracks.collect()} == want[0]
    assert {x.id: (x.kind, x.provider_ref, x.name, x.subtitle) for x in got.collections.collect()} == want[1]
    found: dict = {}
    for x in got.members.collect():
        found.setdefault(x.collection_id, {})[x.track_id] = x.position
    assert found == want[2]


# ---- upgrades


def made(spark):
    return lambda _: {"track": spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string"), "member": spark.createDataFrame([(1,), (None,)], "track_id long")}


def test_a_library_goes_from_version_to_version(spark, tmp_path):
    refs = [migrations.Reference("member", "track_id", "track"), migrations.Reference("nothing", "x", "track")]
    library = migrations.Library(spark, str(tmp_path / "lib"))
    assert library.current() == (0, {})
    one, two = made(spark), lambda t: {**t, "track": t["track"].withColumn("seed", F.col("id") % 360)}
    library.open([one], refs)
    assert library.current()[0] == 1
    tables = library.open([one, two], refs)
    assert sorted(map(tuple, tables["track"].collect())) == [(1, "a", 1), (2, "b", 2)] and library.current()[0] == 2
    runs = []
    library.open([one, lambda t: runs.append(1) or t], refs)
    assert not runs  # nothing runs twice
    with pytest.raises(migrations.NewerLibraryError):
        library.open([one], refs)
    for bad, error in ((lambda t: {**t, "track": t["track"].where("id = 2")}, migrations.UpgradeError), (lambda t: 1 / 0, ZeroDivisionError)):
        with pytest.raises(error):
            library.open([one, two, two, bad], refs)
        version, tables = library.current()
        assert version == 2 and tables["track"].columns == ["id", "title", "seed"] and tables["member"].count() == 2


# ---- resumed work


def test_a_resumed_run_equals_a_full_one(spark):
    r = np.random.default_rng(3)
    songs = spark.createDataFrame([(h, r.normal(size=n).tolist()) for h, n in (("a", 150), ("b", 40), ("c", 7), ("d", 0))], "audio_hash string, samples array<double>")
    none = spark.createDataFrame([], "audio_hash string, index long")
    calls = spark.sparkContext.accumulator(0)

    def model(s):
        calls.add(1)
        return s

    run = lambda done: {(x.audio_hash, x["index"]): (x.vocals, x.instrumental) for x in resume.separate_missing(songs, done, model, 20, 24, 16, 4).collect()}
    full = run(none)
    assert sorted(full) == [*(("a", k) for k in range(8)), ("b", 0), ("b", 1), ("c", 0)] and calls.value == 7 + 2 + 1
    assert [len(full["a", k][0]) for k in range(8)] == [20] * 7 + [10]
    whole = signals.separate(songs.where("audio_hash = 'a'"), signals.passthrough, 24, 16, 4).orderBy("start").collect()
    assert np.allclose(np.concatenate([x.vocals for x in whole]), np.concatenate([full["a", k][0] for k in range(8)]))
    calls.value = 0
    done = spark.createDataFrame([("a", k) for k in (0, 1, 2, 4, 5, 6)] + [("b", 0), ("b", 1)], "audio_hash string, index long")
    rest = run(done)
    assert rest == {k: full[k] for k in (("a", 3), ("a", 7), ("c", 0))}
    assert calls.value == 2 + 2 + 1  # of songs a and c the segments that the gaps touch
    gaps = resume.missing_chunks(songs.select("audio_hash", F.size("samples").alias("n")), done, 20, from_first_gap=True)
    assert sorted(map(tuple, gaps.collect())) == [*(("a", k) for k in range(3, 8)), ("c", 0)]


@pytest.mark.parametrize("rate, to, piece", [(48000, 44100, 64), (8000, 44100, 10), (44100, 8000, 7), (3, 2, 5), (1, 1, 4)])
def test_cubic_equals_a_loop_across_pieces(spark, rate, to, piece):
    r = np.random.default_rng(piece)
    signal = {"a": r.normal(size=203), "b": r.normal(size=1), "c": r.normal(size=2)}
    rows = []
    for k, x in signal.items():
        cuts = sorted({0, *r.integers(0, len(x), 6).tolist()})
        rows += [(k, a, x[a:b].tolist()) for a, b in zip(cuts, [*cuts[1:], len(x)])]
    pieces = spark.createDataFrame(rows, "k string, start long, samples array<double>")
    got = {k: [] for k in signal}
    for x in sorted(resume.cubic(pieces, "k", "start", "samples", rate, to, piece).collect(), key=lambda x: (x.k, x.start)):
        assert x.start == len(got[x.k])
        got[x.k] += x.samples
    for k, x in signal.items():
        tap = lambda i, x=x: x[i] if 0 <= i < len(x) else 0.0
        want = []
        for j in range(len(x) * to // rate):
            i, t = j * rate // to, j * rate % to / to
            a, b, c, d = (tap(i + n) for n in (-1, 0, 1, 2))
            want.append(b + 0.5 * t * (c - a + t * (2 * a - 5 * b + 4 * c - d + t * (3 * (b - c) + d - a))))
        assert np.allclose(got[k], want)


def test_regroup_cuts_pieces_at_borders(spark):
    rows = [("a", 0, [1.0, 2.0, 3.0]), ("a", 3, []), ("a", 3, [4.0]), ("a", 4, [5.0, 6.0, 7.0, 8.0, 9.0])]
    got = signals.regroup(spark.createDataFrame(rows, "k string, s long, x array<double>"), "k", "s", "x", 2)
    assert {r["index"]: r.samples for r in got.collect()} == {0: [1, 2], 1: [3, 4], 2: [5, 6], 3: [7, 8], 4: [9]}


# ---- scripts


def test_the_longest_phrase_gives_way_first(spark):
    #: A few phrases and letters of both scripts.
    table = [("漢", "汉"), ("語", "语"), ("乾", "干"), ("乾坤", "乾坤"), ("頭髮", "头发"), ("髮", "发"), ("發", "发"), ("abc", "x"), ("ab", "y"), ("bcd", "z"), ("", "no"), (None, "no"), ("q", None)]
    convert = scripts.converter(spark.createDataFrame(table, "phrase string, to string"))
    texts = ["漢語", "乾坤乾", "頭髮發", "abcd", "abbcd", "ab", "", None, "q漢"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", convert("t").alias("t")).orderBy("id").collect()
    assert [r.t for r in rows] == ["汉语", "乾坤干", "头发发", "xd", "yz", "y", "", None, "q汉"]
    with pytest.raises(ValueError, match="too large"):
        scripts.converter(spark.range(scripts.ENTRIES + 1).select(F.col("id").cast("string").alias("phrase"), F.lit("x").alias("to")))


def test_titles_in_two_scripts_match(spark):
    convert = scripts.converter(spark.createDataFrame([("漢", "汉"), ("語", "语"), ("聲", "声")], "phrase string, to string"))
    wanted = spark.createDataFrame([(1, "漢語歌聲", "聲聲", 100.0)], "id int, title string, artist string, length double")
    hits = spark.createDataFrame([("汉语歌声", "声声", 100.0, 3, 5), ("汉", "声声", 100.0, 3, 6)], "hit_title string, hit_artist string, hit_length double, timed_lines int, ord int")
    assert search.best_match(wanted, hits).count() == 0
    assert [(r.id, r.hit_title, r.ord) for r in search.best_match(wanted, hits, convert).collect()] == [(1, "汉语歌声", 5)]


# ---- unreadable rows


def test_rows_are_good_or_dead(spark, tmp_path):
    bodies = ['{"k":1,"s":"a"}', '{"k":"7"}', '{"k":"x"}', '{"s":1}', '{"k":null}', "[1]", "7", '{"k":', "", " ", None, '{"k":2,"s":null}', '{"k":3,"s":{"a":1}}', "null"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    good, dead = quarantine.sort_out(rows, "body", {"k": "bigint", "s": "string"}, ["k"])
    assert {r.id: r.k for r in good.collect()} == {0: 1, 1: 7, 11: 2, 12: 3}
    why = {r.id: r.reason for r in dead.collect()}
    assert why == {2: "wrongType:k", 3: "missing:k", 4: "missing:k", 5: "notAnObject", 6: "notAnObject", 7: "unreadable", 8: "empty", 9: "empty", 10: "empty", 13: "notAnObject"}
    assert good.count() + dead.count() == len(bodies)
    for _ in range(2):  # a run done again replaces its own
        quarantine.keep_dead(dead, str(tmp_path / "dead"), "r1")
    assert spark.read.parquet(str(tmp_path / "dead")).groupBy("kind").count().collect().__len__() == 5 and spark.read.parquet(str(tmp_path / "dead")).count() == len(why)


def test_failures_of_files():
    known = [(ValueError("x"), "unsupported"), (EOFError(), "unsupported"), (OSError(errno.ENOENT, ""), "fileMoved"), (PermissionError(errno.EACCES, ""), "fileNotAllowed"), (OSError(errno.EIO, ""), "readFailed")]
    assert [quarantine.failure(e) for e, _ in known] == [k for _, k in known]


# ---- events for queued songs


def test_streams_meet_and_a_batch_told_twice_changes_nothing(spark, tmp_path):
    rows = [(k % 3, k * 60, k) for k in range(60)]
    events = spark.createDataFrame(rows, "track_id int, s long, event int").select("track_id", F.timestamp_seconds("s").alias("at"), "event")
    queue = spark.createDataFrame([(0, 100, "p"), (0, 2000, "q"), (1, 3000, "r"), (9, 0, "s")], "track_id int, s long, entry string").select("track_id", F.timestamp_seconds("s").alias("queued_at"), "entry")
    for name, df, time in (("events", events, "at"), ("queue", queue, "queued_at")):
        for low, high in ((0, 1200), (1200, 9999)):
            df.where((F.unix_seconds(time) >= low) & (F.unix_seconds(time) < high)).coalesce(1).write.parquet(str(tmp_path / name), mode="append")
    read = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out, sink = str(tmp_path / "out"), fanout.to_folder(str(tmp_path / "out"))
    told = []

    def failing(batch, number):
        sink(batch, number)
        told.append(number)
        if len(told) == 2:  # written, but the stream ends before it notes that
            raise RuntimeError("lost")

    joined = lambda: fanout.for_queued(read("events", events), read("queue", queue), "10 minutes", "15 minutes")
    start = lambda put: joined().writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        start(failing).awaitTermination()
    start(lambda b, n: (sink(b, n), told.append(n))).awaitTermination()
    assert told.count(1) == 2  # the second batch was told twice
    got = sorted((r.track_id, r.event, r.entry) for r in spark.read.parquet(out).collect())
    want = sorted((r.track_id, r.event, r.entry) for r in fanout.for_queued(events, queue, shown="15 minutes").collect())
    assert got == want and len(want) == 13


def test_views_go_out_when_they_change(spark, tmp_path):
    rows = [(1, 1, 1, "a"), (1, 2, 2, "a"), (1, 3, 3, "b"), (2, 1, 4, "a"), (1, 11, 5, "b"), (1, 12, 6, "a"), (2, 13, 7, "a"), (3, 14, 8, "x")]
    df = spark.createDataFrame(rows, fanout.VIEW)
    for low, high in ((0, 10), (10, 99)):
        df.where(f"at_ms >= {low} and at_ms < {high}").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fanout.on_change(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.seq for r in spark.table("changes").collect()) == [1, 3, 4, 6, 8]
