"""Payloads, strict lookups, rates and wave files against plain versions."""

from __future__ import annotations

import io
import json
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediamill.functions import payloads as p
from mediamill.operators import catalogue as c, timeline as tl
from mediamill.sources import audio


def test_downloader_lines(spark):
    lines = [
        {"url": "u1", "title": "A", "uploader": "up", "duration": 61.2345, "thumbnails": [{"url": "http://t"}, {"url": "x"}]},
        {"url": "u2", "live_status": "is_live"},
        "not json",
        {"title": "no address"},
        {"url": "u1", "title": "again"},
        {"url": "u3", "channel": "c", "uploader": "up", "thumbnail": "http://own", "thumbnails": [], "live_status": "was_live"},
        {"url": "u4", "duration": "long"},
        "[1]",
        None,
    ]
    df = spark.createDataFrame([(1, k, x if x is None or isinstance(x, str) else json.dumps(x)) for k, x in enumerate(lines)], "q int, n int, line string")
    got = [tuple(r)[1:] for r in p.found_videos(df, "q", "n", "line").orderBy("ord").collect()]
    assert got == [(1, "u1", "A", "up", 61_235, "https://t"), (2, "u3", "Unknown song", "c", None, "https://own")]


def test_download_records(spark):
    base = {"filepath": "/x", "title": "Juniper - Paper Boats (Official Video)", "uploader": "Some Channel"}
    records = [{**base, "track": "T", "artist": "S", "tags": ["a"]}, {**base, "track": "T"}, base, {**base, "artist": "S", "duration": 1.5}, {"title": "x"}, {"filepath": "/y"}]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(records)] + [(6, "bad"), (7, None)], "id int, line string")
    rows = {r.id: r for r in p.fetched(df, "line").collect()}
    assert [(rows[k]["name"], rows[k].singer, rows[k].duration_s) for k in range(6)] == [("T", "S", 0), ("T", "Some Channel", 0), ("Paper Boats", "Juniper", 0), ("Paper Boats", "Juniper", 2), (None, None, None), ("Unknown song", None, 0)]
    assert rows[0].guesses == [] and rows[0].tags == ["a"] and rows[1].tags == []
    assert ("T", "Juniper") in map(tuple, rows[1].guesses) and {g.title for g in rows[1].guesses} == {"T"}
    assert tuple(rows[2].guesses[0]) == ("Paper Boats", "Juniper") and rows[6].path is None and rows[7].path is None


def test_recordings_and_lines(spark):
    body = {"recordings": [{"title": "T", "length": 61500, "artist-credit": [{"name": "A", "joinphrase": " feat. "}, {"name": "B"}]}, {"title": "U"}]}
    df = spark.createDataFrame([(json.dumps(body),), ("busy",)], "b string").select(p.recordings(F.col("b")).alias("h"))
    assert [None if r.h is None else [tuple(x) for x in r.h] for r in df.collect()] == [[("T", "A feat. B", 61.5), ("U", "", None)], None]
    line = '[{"start_ms":1,"end_ms":2,"text":"a","words":[{"start_ms":1,"end_ms":2,"text":"a"}],"voice":"M"}]'
    kept = spark.createDataFrame([(line,), (None,), ("[]",)], "t string").select(p.lines_of_json(F.col("t")).alias("l")).select("l", p.lines_to_json(F.col("l")).alias("t")).collect()
    assert [len(r.l) for r in kept] == [1, 0, 0] and json.loads(kept[0].t) == json.loads(line) and kept[1].t is None and kept[2].t is None


def test_small_rules(spark):
    assert p.model_sizes(64, 16, 16) == {"chunk_size": 240, "trim": 32, "gen_size": 176}
    urls = ["https://www.www.files.example.com/a/salt-and_static.flac?x=1", "http://h", "https://u@h:8080/x.y.mp3#z", "nonsense"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(p.file_preview(F.col("u")).alias("f")).collect()
    assert [tuple(r.f) for r in got] == [("salt and static", "files.example.com"), ("", "h"), ("x.y", "h"), ("", None)]
    order = spark.createDataFrame([("wl0", "1"), ("en1", "2"), ("en0", "3"), ("bridge", "4")], "name string, ip string")
    assert [r.ip for r in p.interfaces_in_order(order).collect()] == ["3", "2", "4", "1"]
    one = spark.range(1).select(p.with_missing(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("a"))).alias("x"), p.audio_track(F.from_json(F.lit('[{"codec":null,"sample_rate":1,"frames":5},{"codec":"v","frames":5},{"codec":"aac","sample_rate":44100,"frames":44120}]'), "array<struct<codec:string,sample_rate:long,frames:long>>")).alias("t")).first()
    assert one.x == ["a", "b", "c"] and tuple(one.t) == (2, 1000)


def test_strict_lookups(spark):
    df = spark.createDataFrame([(k, k % 3, "x") for k in range(9)], "a int, b int, v string")
    keys = spark.createDataFrame([(1, 1), (5, 2), (1, 1)], "a int, b int")
    assert sorted(r.a for r in c.rows_of(df, keys).collect()) == [1, 5]
    with pytest.raises(c.MissingError, match=r"\(4, 2\)"):
        c.rows_of(df, spark.createDataFrame([(1, 1), (4, 2)], "a int, b int"))
    rows = spark.createDataFrame([("h", "m", 4, 1, "running", None), ("h", "n", 5, 2, "queued", 3)], "audio_hash string, model_id string, chunks_total int, chunks_done int, status string, last_used_at long")
    done = c.finish(rows, spark.createDataFrame([("h", "m")], "audio_hash string, model_id string"), 9)
    assert sorted(map(tuple, done.collect())) == [("h", "m", 4, 4, "ready", 9), ("h", "n", 5, 2, "queued", 3)]
    with pytest.raises(c.MissingError):
        c.finish(rows, spark.createDataFrame([("g", "m")], "audio_hash string, model_id string"), 9)


def test_rate_starts_anew_when_progress_falls(spark):
    r = random.Random(3)
    runs = {k: [(t, r.randint(0, 9)) for t in range(r.randint(1, 12))] for k in range(30)} | {99: [(0, 5), (10, 7), (20, 1), (30, 4)]}
    want = {}
    for k, reports in runs.items():
        first = last = None
        for t, n in reports:
            first = (t, n) if first is None or n < first[1] else first
            last = (t, n)
        want[k] = None if last[1] <= first[1] else (last[0] - first[0]) / (last[1] - first[1])
    df = spark.createDataFrame([(k, t, n, t) for k, x in runs.items() for t, n in x], "k int, t int, n int, o int")
    assert {x.k: x.rate for x in tl.arrival_rate(df, "k", "t", "n", "o").collect()} == want and want[99] == 10 / 3


def tagged(tags, frames, rate=44100, channels=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.arange(frames * channels, dtype="<i2").tobytes())
    info = b"INFO" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in tags)
    body = out.getvalue()[12:] + b"LIST" + struct.pack("<I", len(info)) + info
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def test_tags_and_ranges_of_wave_files(spark, tmp_path):
    data = tagged([(b"INAM", b"  \0"), (b"INAM", b" Boats\0"), (b"INAM", b"later"), (b"IART", b"Juniper"), (b"ISFT", b"x")], 66150)
    (tmp_path / "a.wav").write_bytes(data)
    (tmp_path / "b.wav").write_bytes(b"RIFFxx")
    (tmp_path / "c.wav").write_bytes(tagged([], 48000, 48000, 1))
    rows = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in audio.probe_waves(spark, str(tmp_path)).collect()}
    assert rows["a.wav"] == ("Boats", "Juniper", None, 1500, None) and rows["c.wav"] == (None, None, None, 1000, None) and rows["b.wav"][-1].startswith("unsupported")
    whole = {r.path.rsplit("/", 1)[1]: (r.left, r.right) for r in audio.read_waves(spark, str(tmp_path)).where("error is null").collect()}
    for name in ("a.wav", "c.wav"):
        for start, n in ((0, 5), (100, 50), (len(whole[name][0]) - 3, 10), (10**6, 5)):
            got = audio.decode_range((tmp_path / name).read_bytes(), start, n)
            assert [list(x) for x in got] == [x[start : start + n] for x in whole[name]]


def test_chunks_become_a_wave_file(spark):
    chunks = [("a", 1, [0.5, 2.0], [-0.5, -2.0]), ("a", 0, [0.00001, 1.0], [0.99999, -1.0]), ("a", 3, [1.0], [1.0]), ("b", 1, [1.0], [1.0])]
    df = spark.createDataFrame(chunks, "audio_hash string, index int, left array<double>, right array<double>")
    files = {r.audio_hash: bytes(r.content) for r in audio.as_waves(df).collect()}
    with wave.open(io.BytesIO(files["a"])) as w:
        assert (w.getnchannels(), w.getframerate(), w.getnframes()) == (2, 44100, 4)
        assert np.frombuffer(w.readframes(4), "<i2").tolist() == [0, 32766, 32767, -32767, 16383, -16383, 32767, -32767]
    with wave.open(io.BytesIO(files["b"])) as w:  # its first chunk is missing
        assert w.getnframes() == 0
