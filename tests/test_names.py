from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mediamill.functions import names
from mediamill.operators import search

#: (title, artist, name, singer), each for one rule.
TITLES = [
    ("Glass Harbour | Piano Only", None, "Glass Harbour", None),  # what follows a bar
    ("月光海岸 伴奏", "何小雲(版本)", "月光海岸", None),  # a tag in a script without blanks, at the end
    ("伴奏", None, "伴奏", None),  # a tag that is all there is
    ("【8K】趙六《山风》翻唱", None, "山风", "趙六"),  # quoted, the singer before, noise behind
    ("「春」の歌", None, "「春」の歌", None),  # quoted, but more follows
    ("Ivy Lane - Tin Roof (Lyric Video)", "IvyLaneVEVO", "Tin Roof", None),  # A is the singer, under the channel's name
    ("Ivy Lane - Tin Roof", "A Stranger", "Tin Roof", "Ivy Lane"),  # A isn't the singer given
    ("Tin Roof - Ivy Lane", "Ivy Lane", "Tin Roof", None),  # B is the singer
    ("Tin Roof - Ivy Lane", None, "Tin Roof", None),  # no singer given
    ("Tin Roof - Stereo Mix 1999", "Ivy Lane", "Tin Roof", None),  # B names a version
    ("Tin Roof - Live in Leeds", "Ivy Lane", "Tin Roof", None),
    ("Tin Roof - Mono", "Ivy Lane", "Mono", "Tin Roof"),  # a modifier alone names none
    ("Ivy Lane - Live Wire", "Ivy Lane", "Live Wire", None),  # a tag beside other words doesn't either
    ("Tin Roof - From the Attic", "Ivy Lane", "Tin Roof", None),
    ("Ivy Lane - From the Attic", "Ivy Lane", "From the Attic", None),  # but A is the singer
    ("Tin (Alive) (Acoustic Demo)", None, "Tin (Alive)", None),  # of round brackets those stay that aren't noise
    ("Tin [Alive]", None, "Tin", None),
    ("Open (never closed [HD]", None, "Open (never closed [HD]", None),
    ("[HD]", None, "[HD]", None),  # nothing left
    ("", None, "", None),
    (None, "Ivy Lane", None, None),
]


def test_titles(spark):
    rows = spark.createDataFrame([(i, t, a) for i, (t, a, *_) in enumerate(TITLES)], "i int, t string, a string").select("i", names.clean_title("t", "a").alias("c"))
    assert {r.i: (r.c.name, r.c.singer) for r in rows.collect()} == {i: tuple(x[2:]) for i, x in enumerate(TITLES)}


def test_artists(spark):
    want = {"何小雲(版本)": ["何小雲"], "何小雲 (Ho Siu Wan)": ["何小雲", "Ho Siu Wan"], "Ho Siu Wan - Topic": ["Ho Siu Wan"], "IvyLaneVEVO": ["IvyLane"], "Ivy Official vevo": ["Ivy"], "VEVO": ["VEVO"], "": [], None: None}
    rows = spark.createDataFrame([(a,) for a in want], "a string").select("a", names.clean_artist("a").alias("n"))
    assert {r.a: r.n for r in rows.collect()} == want


def test_uploads(spark):
    want = {("Bo & the Oaks - Slow Tram (Official Video) [HD]", "BoVEVO"): ("Slow Tram", "Bo & the Oaks"), ("Slow Karaoke", "Ann Lee - Topic - Topic"): ("Slow Karaoke", "Ann Lee"), ("Tune [4K]", None): ("Tune", None), ("Tune (videos)", "x"): ("Tune (videos)", "x")}
    rows = spark.createDataFrame(list(want), "t string, u string").select("t", "u", names.upload_names("t", "u").alias("n"))
    assert {(r.t, r.u): (r.n.title, r.n.artist) for r in rows.collect()} == want


def test_guesses(spark):
    want = {
        ("Ivy Lane ft. Bo - Tin Roof (MV)", "IvyLaneVEVO"): [("Tin Roof", "Ivy Lane"), ("Ivy Lane", "Tin Roof")],
        ("X/Y - Tin Roof", "xyVEVO"): [("Tin Roof", "X/Y"), ("X/Y", "Tin Roof")],
        ("Tin Roof", None): [],
        ("王小明-早晨", "早晨官方频道"): [("王小明-早晨", "早晨官方频道"), ("早晨", "王小明"), ("王小明", "早晨")],
        (None, "x"): None,
    }
    uploads = spark.createDataFrame([(t, c, "clash") for t, c in want], "t string, c string, _own_pairs string")
    rows = names.name_guesses(uploads, "t", "c")
    assert rows.columns == ["t", "c", "_own_pairs", "guesses"]
    assert {(r.t, r.c): r.guesses and [tuple(g) for g in r.guesses] for r in rows.collect()} == {k: v and v for k, v in want.items()}
    many = spark.createDataFrame([(" | ".join(f"part{i}" for i in range(9)), "owner")], "t string, c string")
    assert len(names.name_guesses(many, "t", "c").first().guesses) == names.GUESSES


#: Query and titles found, best first: parts of words in several scripts, folded forms, one edit, words over title and artist.
SEARCHES = {
    "光海": ["月光海岸の夜"], "해안": ["달빛 해안"], "corazon": ["Corazón de Lata"], "ＧＬＡＳＳ": ["Glass Harbour"], "harbuor": ["Glass Harbour"], "harbor": ["Glass Harbour"],
    "らじお": ["ラジオの朝"], "nora tin": ["Tin Roof"], "gla": ["Glass Harbour", "Slow Tram"], "qqzx": [], "  ": [],
}


@pytest.mark.parametrize("query", SEARCHES)
def test_search(spark, query):
    songs = ["月光海岸の夜", "달빛 해안", "Corazón de Lata", "Glass Harbour", "ラジオの朝", ("Tin Roof", "Nora Vale"), ("Slow Tram", "Gladys")]
    rows = [(i, *((s, None) if isinstance(s, str) else s), None) for i, s in enumerate(songs)]
    tracks = spark.createDataFrame(rows, "id long, title string, artist string, album string")
    assert [r.title for r in search.search(tracks, query, 10).collect()] == SEARCHES[query]


def test_likeness(spark):
    want = {("Ivy", "Ivy Lane"): 1, ("Ivy", "Privy Council"): 0, ("Ivy", "ivy"): 2, ("Gladys", "Gladis"): 1, ("Gladys", "The Gladys Band"): 1, ("Bo", "Bo Diaz"): 0, ("何小雲", "何小雲與朋友"): 1, ("", ""): 0}
    pairs = spark.createDataFrame(list(want), "a string, b string").select("a", "b", *[names.fold(c).alias(f"f{c}") for c in "ab"])
    k = lambda c: names.squeezed(F.col(f"f{c}"))
    rows = pairs.select("a", "b", search.likeness(k("a"), k("b"), F.col("fa"), F.col("fb")).alias("n")).collect()
    assert {(r.a, r.b): r.n for r in rows} == want


def _plain_edit(a: str, b: str) -> bool:
    if a == b:
        return True
    letters = set(a + b)
    near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters}
    return b in near | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}


@given(st.text("abc", max_size=5), st.text("abc", max_size=5))
@settings(max_examples=300, deadline=None)
def test_one_edit(a, b):
    assert search.one_edit(a, b) == _plain_edit(a, b)


def test_one_edit_pairs_and_columns(spark):
    from pyspark.sql import functions as F

    from mediamill.functions import columns as x

    words = ["cat", "act", "cart", "ca", "dog", "tac", "caat"]
    got = {(r.a, r.b) for r in search.one_edit_pairs(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()}
    assert got == {(a, b) for a in words for b in words if a < b and _plain_edit(a, b)}
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    assert all(r.e == _plain_edit(r.a, r.b) for r in pairs.select("a", "b", x.within_one_edit(F.col("a"), F.col("b")).alias("e")).collect())


def test_instrumental_and_voice(spark):
    from pyspark.sql import functions as F

    yes = ["Tin Roof (Instrumental)", "Slow Tram - Karaoke", "Tin Roof (Off Vocal)", "Slow Tram off-vocal mix", "Tin Roof [Inst.]", "月光海岸 伴奏", "月光海岸 カラオケ"]
    no = ["Instant Coffee", "The Instrument", "Vocal Lines"]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", names.looks_instrumental(F.col("t")).alias("i")).collect()
    assert {r.t for r in rows if r.i} == set(yes)
    lines = spark.createDataFrame([("M: hi",), ("Time: x",), ("v2:la",)], "t string").select(names.split_voice(F.col("t")).alias("v")).collect()
    assert [(r.v.voice, r.v.rest) for r in lines] == [("M", "hi"), (None, "Time: x"), ("F", "la")]
