from __future__ import annotations

import math
import random
import re

from mediamill.functions import names
from mediamill.operators import search
from mediamill.plans import text


def key_text(text):
    return "".join(c for c in names.fold_text(text) if c.isalnum())


def plain_like(a, b):
    x, y = key_text(a), key_text(b)
    if x == y:
        return 2 if x else 0
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if len(short) <= 2:
        return 0
    if len(short) <= 4 and short.isascii():
        return int(short in names.fold_text(b if long == y else a).split())
    return int(short in long or search.one_edit(short, long))


def plain_best(spark, wanted, hits):
    """All pairs, one by one; names cleaned by the rules that are tested by themselves."""
    made = lambda rows, schema, column: [r.c for r in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], f"i int, {schema}").select("i", column.alias("c")).orderBy("i").collect()]
    clean = made([h[:2] for h in hits], "t string, a string", names.clean_title("t", "a")["name"])
    all_singers = sorted({x[2] or "" for x in wanted} | {x[1] or "" for x in hits})
    singers = dict(zip(all_singers, made([(s,) for s in all_singers], "a string", names.clean_artist("a"))))
    sorted_ = lambda s: "".join(sorted(w for w in re.split(r"[\W_]+", names.fold_text(s)) if w))
    out = {}
    for i, t, a, n in wanted:
        found = []
        for (ht, ha, hn, timed, ord_), ct in zip(hits, clean):
            if t is None or ht is None or n is None or (hn is None and n != 0) or not key_text(t) or not key_text(ct):
                continue
            k, hk, off = key_text(t), key_text(ct), abs(n - hn) if n else 0
            known = max((plain_like(p, q) for p in singers[a or ""] for q in singers[ha or ""]), default=0)
            same = k == hk
            if (off <= 60 and (same or search.one_edit(sorted_(t), sorted_(ct)))) if known else (same and off <= (3 if a else 10)):
                found.append(((2 if same else 1) + known + 1 - math.floor(off + 0.5) / 60, timed, -ord_, ht, ha))
        if found:
            p, _, o, ht, ha = max(found, key=lambda x: x[:3])
            out[i] = (ht, ha, -o, round(p, 6))
    return out


def got(df):
    return {r.id: (r.hit_title, r.hit_artist, r.ord, r.points) for r in df.collect()}


def test_best_match_equals_brute_force(spark):
    r = random.Random(4)
    titles = ["Red Ring", "red ring", "Red Rings", "Red  Rign", "The Red Ring of Old", "Old", "Ring", "String Red", "Café 夜 Song", "cafe 夜 song", "a", "A B", "!!!", None, "Redring", "The Long Way Home Again", "The Long Way Home Agian", "Home Again the Long Way", "Red Ring (Official Video)", "Ann - Red Ring", "《Old》"]
    singers = ["Ann", "Anna", "ann", "Anne Lee (李安)", "李安", "Bob", "Bo", "Brand#1", "Brand#13", "VEVO", "", None, "Lee Official", "Robert Long", "Robret Long"]
    lengths = [0.0, 60.0, 61.5, 62.0, 62.5, 70.0, 119.5, 122.0, 123.0, 180.25, None]
    song = lambda: (r.choice(titles), r.choice(singers), r.choice(lengths))
    wanted = [(i, *song()) for i in range(250)]
    hits = [(*song(), r.choice([0, 5, 9]), i) for i in range(120)]
    w = spark.createDataFrame(wanted, "id long, title string, artist string, length double")
    h = spark.createDataFrame(hits, "hit_title string, hit_artist string, hit_length double, timed_lines int, ord long")
    want = plain_best(spark, wanted, hits)
    assert len(want) > 100 and len({p for *_, p in want.values()}) > 10
    assert got(search.best_match(w, h)) == want


def test_best_match_query_answers_every_song(spark):
    rows = [(i, f"{a} ring", f"Brand#{i % 5}", i % 9) for i, a in enumerate(["red", "hot", "cold", "small"] * 5)]

    class Tables:
        part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int")

    wanted = [(i, t, a, n * 10.0) for i, t, a, n in rows]
    found = got(text.q_best_match(Tables))
    assert len(found) == 20 and found == plain_best(spark, wanted, [(t, a, n, 5, i) for i, t, a, n in wanted])


def test_best_synced(spark):
    wanted = spark.createDataFrame([(1, "Tin Roof", "Ivy Lane", 0.0), (2, "None", "Ivy Lane", 0.0)], "id long, title string, artist string, length double")
    hits = [("Tin Roof", "Ivy Lane", 100.0, "no stamps", 0), ("Tin Roof", "Ivy Lane", None, "[00:01.00]a", 1), ("Tin Roof", "Ivy Lane", 9.0, "[00:01.00]a\n[00:02.00]b", 2), ("Tin Roof", "Ivy Lane", 9.0, None, 3)]
    rows = search.best_synced(wanted, spark.createDataFrame(hits, "hit_title string, hit_artist string, hit_length double, lyrics string, ord long")).collect()
    assert [(r.id, r.ord, r.lyrics) for r in rows] == [(1, 2, hits[2][3])]


def test_only_distinct_hits_are_cleaned(spark, monkeypatch):
    cleaned = []
    monkeypatch.setattr(search, "kept", lambda df: cleaned.append(df.count()) or df.localCheckpoint() if "name" in df.columns else df.localCheckpoint())
    wanted = spark.createDataFrame([(i, "Tin Roof", "Ivy Lane", 9.0) for i in range(40)], "id long, title string, artist string, length double")
    hits = wanted.selectExpr("title as hit_title", "artist as hit_artist", "length as hit_length", "5 as timed_lines", "id as ord")
    rows = search.best_match(wanted, hits).collect()
    assert sorted((r.id, r.ord) for r in rows) == [(i, 0) for i in range(40)]
    assert cleaned == [1]
