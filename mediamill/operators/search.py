"""Fuzzy search and matching of names."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names
from ..functions.columns import within_one_edit
from .lineage import kept, spread


def one_edit(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or a[k : k + 2][::-1] == b[k : k + 2] and a[k + 2 :] == b[k + 2 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _word_score(word: str, text: str) -> int:
    """Points of a word in a folded text: as a run most, at a word's start more, else in order with gaps; 0 if absent."""
    at = text.find(word)
    if at >= 0:
        return 16 * len(word) + (8 if at == 0 or not text[at - 1].isalnum() else 0) + (4 if at == 0 else 0)
    if len(word) < 3:
        return 0
    at, points, last = -1, 0, -1
    for c in word:
        at = text.find(c, at + 1)
        if at < 0:
            return 0
        points += 12 if at == last + 1 and last >= 0 else 4
        last = at
    return points if points >= 8 * len(word) - 8 else 0


def score_text(query: list[str], text: str) -> int | None:
    """The sum over all folded query words, which all must match; 1 if only near; None otherwise."""
    points = [_word_score(w, text) for w in query]
    if all(points):
        return sum(points)
    tokens = text.split()
    near = all(any(one_edit(w, t) for t in tokens) if len(w) >= 5 else w in text for w in query)
    return 1 if near else None


def search(tracks: DataFrame, query: str, limit: int, order: str = "id") -> DataFrame:
    """The best ``limit`` tracks (id, title, artist, album) for a query, best first, ties by ``order``.

    A title counts a tenth more than title, artist and album together. No query words: no rows.
    """
    words = names.fold_text(query).split()

    @F.pandas_udf("int")
    def score(title: pd.Series, whole: pd.Series) -> pd.Series:
        def one(t: str, w: str) -> int | None:
            own, all_ = score_text(words, names.fold_text(t)), score_text(words, names.fold_text(w))
            both = [x for x in (own + own // 10 if own is not None else None, all_) if x is not None]
            return max(both, default=None)

        return pd.Series([one(t, w) for t, w in zip(title, whole)], dtype="Int32")

    if not words:
        return tracks.limit(0).withColumn("score", F.lit(0))
    scored = tracks.withColumn("score", score(F.coalesce("title", F.lit("")), F.concat_ws(" ", "title", "artist", "album")))
    return scored.where("score is not null").orderBy(F.desc("score"), order).limit(limit)


def one_edit_pairs(words: DataFrame, column: str) -> DataFrame:
    """All pairs a < b of distinct words within one edit or swap.

    Words meet under the word itself and each form with one letter left out: words within one edit
    share such a form, as do swapped ones; the exact test follows. A list under one form is short.
    """
    w = F.col(column)
    forms = F.array_union(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))
    posted = words.select(w.alias("own"), F.explode(forms).alias("form"))
    pairs = posted.alias("x").join(posted.alias("y"), "form").where("x.own < y.own").select(F.col("x.own").alias("a"), F.col("y.own").alias("b")).distinct()
    return pairs.where(within_one_edit(F.col("a"), F.col("b")))


def likeness(a: Column, b: Column, folded_a: Column, folded_b: Column) -> Column:
    """Of two singers by their keys and folded names: 2 the same key, 1 close (the shorter key in the longer or within one edit; of three or four ASCII letters a word of it; never shorter), 0 unlike."""
    swap = F.length(a) > F.length(b)
    x, y, long = (F.when(swap, p).otherwise(q) for p, q in ((b, a), (a, b), (folded_a, folded_b)))
    word = F.array_contains(F.split(long, r"\s+"), x)
    close = F.when(F.length(x) <= 2, False).when(x.rlike("^[ -~]{3,4}$"), word).otherwise(y.contains(x) | within_one_edit(x, y))
    return F.when((a == b) & (a != ""), 2).when(close, 1).otherwise(0)


#: Characters of a key's beginning by which longer keys that contain it are found.
GRAM = 8


def _left_out(key: Column) -> Column:
    """The key and its forms with one letter left out, marked: keys within one edit share one."""
    forms = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key))))
    return F.transform(F.array_union(F.array(key), forms), lambda f: F.concat(F.lit("-"), f))


#: Keys that count inside another name only as one of its words.
_SHORT = "^[ -~]{3,4}$"


def _inside(key: Column, folded: Column) -> Column:
    """What a key that is found inside this name may begin with, marked; short ones by the name's words."""
    starts = F.transform(F.sequence(F.lit(3), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1))), lambda i: F.substring(key, i, n)))
    begun = F.transform(F.filter(F.flatten(starts), lambda g: (F.length(g) >= 3) & ~g.rlike(_SHORT)), lambda g: F.concat(F.lit("+"), g))
    words = F.transform(F.filter(F.split(folded, r"\s+"), lambda w: w.rlike(_SHORT)), lambda w: F.concat(F.lit("#"), w))
    return F.array_distinct(F.concat(begun, words))


def _begin(key: Column) -> Column:
    """How a key is looked for inside others; keys of one or two letters never are."""
    return F.when(F.length(key) <= 2, F.array().cast("array<string>")).when(key.rlike(_SHORT), F.array(F.concat(F.lit("#"), key))).otherwise(F.array(F.concat(F.lit("+"), F.substring(key, 1, GRAM))))


def _like_titles(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """Of distinct titles (key, sorted) and (hit_key, hit_sorted) the pairs with equal keys (same) or whose sorted words are within one edit."""
    k, h, w, v = (F.col(c) for c in ("key", "hit_key", "sorted", "hit_sorted"))
    posts = lambda key, words: F.explode(F.array_append(_left_out(words), F.concat(F.lit("="), key)))
    own = wanted.select(k, w).distinct().withColumn("post", posts(k, w))
    other = hits.select(h, v).distinct().withColumn("post", posts(h, v))
    pairs = own.join(other, "post").where((k == h) | within_one_edit(w, v))
    return pairs.select(k, w, h, v, (k == h).alias("same")).distinct()


def _like_singers(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """Of distinct singers (artist) and (hit_artist) the pairs of a likeness above 0 (known): the greatest of their names."""

    def posted(df: DataFrame, c: str, f: str, k: str) -> DataFrame:
        each = df.select(c).where(f"{c} <> ''").distinct().withColumn("one", F.explode(F.array_distinct(names.clean_artist(c))))
        return each.withColumn(f, names.fold("one")).withColumn(k, names.squeezed(F.col(f))).drop("one").where(f"{k} <> ''")

    a, b = posted(wanted, "artist", "f", "k"), posted(hits, "hit_artist", "g", "h")
    k, h, f, g = (F.col(c) for c in "khfg")
    under = lambda df, *forms: df.withColumn("post", F.explode(F.array_distinct(F.concat(*forms))))
    up = under(a, _begin(k), _left_out(k)).join(under(b, _inside(h, g), _left_out(h)), "post")
    down = under(a, _inside(k, f)).join(under(b, _begin(h)), "post")
    met = up.unionByName(down).drop("post").distinct()
    return met.groupBy("artist", "hit_artist").agg(F.max(likeness(k, h, F.col("f"), F.col("g"))).alias("known")).where("known > 0")


def best_match(wanted: DataFrame, hits: DataFrame, simplify: Callable[[Column | str], Column] | None = None) -> DataFrame:
    """For each wanted song (id, title, artist, length) the best hit (hit_title, hit_artist, hit_length, timed_lines, ord).

    A hit's title counts as ``clean_title`` gives it. A like singer allows 60 s between the lengths and a
    close title: its words, in any order, within one edit. An unlike singer allows 3 s, none known 10 s, and then titles must be
    equal. A song of length 0 matches any length; else hits without a length drop out. Points: title 2
    or 1, singer 0 to 2, closeness of length up to 1; ties by more timed lines, then the first hit.
    Songs and hits without a letter in their title, songs without length and songs that nothing matches have no row.

    Only distinct values are cleaned and meet: titles by left-out letters of their words, singers also by beginnings of their keys,
    lengths in spans of time. Of hits that score alike for a song the best goes on, so rows of
    one title count no more than its distinct lengths. An unlike singer scores least whoever it is, so
    for equal titles singers need not meet: a hit whose singer is like scores more by the other way.
    With ``simplify`` (see ``scripts.converter``) names are compared in one script, and hits come as they are.
    """
    hits = hits.withColumn("_hit", F.struct("hit_title", "hit_artist", "ord"))
    if simplify is not None:
        wanted = wanted.withColumns({c: simplify(c) for c in ("title", "artist")})
        hits = hits.withColumns({c: simplify(c) for c in ("hit_title", "hit_artist")})
    sorted_ = lambda c: F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(names.fold(c), r"[^\p{IsAlphabetic}\p{N}]+", " ")), " ")), "")
    song = ["key", "sorted", "artist", "length"]
    best = lambda df, *by: df.groupBy(*by).agg(F.max_by("hit", "rank").alias("hit"), F.max("rank").alias("rank"))
    asked = wanted.select("id", "title", F.coalesce("artist", F.lit("")).alias("artist"), F.col("length").cast("double").alias("length")).where("length is not null and not isnan(length)")
    w = spread(asked.select("title", "artist", "length").distinct()).withColumns({"key": names.key("title"), "sorted": sorted_("title")})
    h = hits.select("hit_title", "hit_artist", F.nanvl(F.col("hit_length").cast("double"), F.lit(None)).alias("hit_length"), F.struct("timed_lines", (-F.col("ord")).alias("o")).alias("rank"), F.col("_hit").alias("hit"))
    # written before they are folded: cleaning folds too, and such calls of Python don't nest
    h = kept(spread(best(h, "hit_title", "hit_artist", "hit_length")).withColumn("name", names.clean_title("hit_title", "hit_artist")["name"]))
    h = h.select(names.key("name").alias("hit_key"), sorted_("name").alias("hit_sorted"), "hit_artist", "hit_length", "rank", "hit")
    w, h = kept(w).where("key <> ''"), kept(best(h, "hit_key", "hit_sorted", "hit_artist", "hit_length")).where("hit_key <> ''")
    songs = w.select(*song).distinct()
    titles = kept(_like_titles(w, h))

    def near(of: list[str], offers: DataFrame, most: int) -> DataFrame:
        """Songs with the offers of the columns ``of`` whose lengths are at most ``allowed`` apart, itself at most ``most``; songs of length 0 with the best of all lengths."""
        spans = songs.where("length <> 0").withColumn("span", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("length") / most) + d)))
        off = F.abs(F.col("length") - F.col("hit_length"))
        met = spans.join(offers.withColumn("span", F.floor(F.col("hit_length") / most)), [*of, "span"]).withColumn("off", off)
        allowed = F.lit(60) if most == 60 else F.when(F.col("artist") == "", 10).otherwise(3)
        timed = met.where(F.col("off") <= allowed).select(*song, (F.col("base") + 1 - F.round("off") / 60).alias("points"), "rank", "hit")
        any_length = songs.where("length = 0").join(best(offers, *of, "base"), of).select(*song, (F.col("base") + F.lit(1.0)).alias("points"), "rank", "hit")
        return timed.unionByName(any_length)

    title = F.when(F.col("same"), 2).otherwise(1)
    known = songs.select("key", "sorted", "artist").distinct().join(kept(_like_singers(songs, h)), "artist").join(titles, ["key", "sorted"]).join(h, ["hit_key", "hit_sorted", "hit_artist"])
    known = best(known.withColumn("base", title + F.col("known")), "key", "sorted", "artist", "base", "hit_length")
    unknown = best(titles.where("same").join(h, ["hit_key", "hit_sorted"]).withColumn("base", F.lit(2)), "key", "sorted", "base", "hit_length")
    scored = near(["key", "sorted", "artist"], known, 60).unionByName(near(["key", "sorted"], unknown, 10))
    found = scored.groupBy(*song).agg(F.max_by("hit", F.struct("points", "rank")).alias("hit"), F.max(F.struct("points", "rank")).alias("top"))
    rows = asked.join(w.join(found, song).select("title", "artist", "length", "hit", "top"), ["title", "artist", "length"])
    return rows.groupBy("id").agg(F.max_by("hit", "top").alias("hit"), F.round(F.max("top.points"), 6).alias("points")).select("id", "hit.hit_title", "hit.hit_artist", "hit.ord", "points")


def best_synced(wanted: DataFrame, hits: DataFrame, lyrics: str = "lyrics") -> DataFrame:
    """``best_match`` among the hits whose lyrics have a time stamp, with their timed lines counted; the match comes with its lyrics."""
    synced = kept(spread(hits).withColumn("timed_lines", names.timed_lines(F.col(lyrics))).where("timed_lines > 0"))
    return best_match(wanted, synced).join(synced.select("ord", lyrics), "ord")
