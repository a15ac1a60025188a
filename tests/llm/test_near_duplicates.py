from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

import corpus_pipeline
from mediamill.llm import common, embeddings, minhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def plain_components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def made_texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    base = [[word() for _ in range(n)] for n in (4, 5, 9, 60, 200, 400)]
    texts = [None, "", " \t\n", "a", "A", "a b", "B A", "x " * 3000]
    for words in base:
        for k in range(8):
            own = list(words)
            for _ in range(k // 3 * max(1, len(own) // 150)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own) if k % 3 else "\n".join(own).upper())
    common_part = " ".join(word() for _ in range(50))
    texts += [f"{common_part} {' '.join(word() for _ in range(40))}" for _ in range(12)]
    return texts


def test_equals_brute_force(spark):
    texts = made_texts()
    rows = [(i, t, "tokens", 0, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, side int, component long")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent=85).collect()}
    sets = {i: plain_sets(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    roots = plain_components(sets, links)
    assert len(links) > 30
    assert got == {i: (len(s), roots[i], roots[i] == i) for i, s in sets.items()}
    kept = minhash.keep_one(docs, percent=85)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in sets if roots[i] == i}


def test_large_group_of_near_copies_meets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "SALT_ROWS", 4)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        own = list(base)
        for _ in range(r.randint(1, 3)):
            own[r.randrange(120)] = f"z{r.randrange(99)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: plain_sets(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    roots = plain_components(sets, links)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, percent=85).collect()} == roots


def test_pipeline_stage_links_from_0_80(spark):
    r = random.Random(11)
    texts = []
    for k in range(30):
        base = [f"w{k}x{i}" for i in range(150)]
        own = list(base)
        for at in r.sample(range(10, 140), r.choice([2, 3, 5])):
            own[at] = f"z{k}x{at}"
        texts += [" ".join(base), " ".join(own)]
    sets = {i: plain_sets(t) for i, t in enumerate(texts)}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    assert sum(0.8 <= x < 0.85 for x in alike.values()) > 5 and any(0 < x < 0.8 for x in alike.values())
    roots = plain_components(sets, [pair for pair, x in alike.items() if x >= 0.8])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {i for i in sets if roots[i] == i}
    assert (minhash.fitting_matches(85), minhash.fitting_matches(80)) == (15, 12)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (0, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(twice).collect()) == [(0, 0), (1, 0), (1, 0)]


def test_repeated_ids_with_different_texts(spark):
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(5, [*a, "x"]), (5, [*b, "x"]), (6, [*a, "y"]), (7, [*b, "z"]), (9, ["q"] * 30), (9, [])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert got == [(5, 5), (5, 5), (6, 5), (7, 5), (9, 9), (9, 9)]


def test_list_of_several_groups_in_blocks(spark, monkeypatch):
    """Chains of neighbours under shared tokens: no member is near to all others, so lists stay open after the stars."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "SALT_ROWS", 2)
    r = random.Random(8)
    shared = [f"s{i}" for i in range(200)]
    texts = []
    for k in range(5):
        own = [*shared, *(f"g{k}x{i}" for i in range(60))]
        for step in range(9):
            own = list(own)
            for at in r.sample(range(200, 260), 3):
                own[at] = f"n{k}x{step}x{at}"
            texts.append(" ".join(own))
    sets = {i: plain_sets(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = plain_components(sets, links)
    assert 1 < len(set(roots.values())) < 45 and len(links) < 45 * 44 // 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(docs).collect()} == roots


def test_rows_with_full_sets_grow_with_the_group(spark, monkeypatch):
    """Near copies of one text, most not similar enough to each other, between chains that are: twice the copies bring at most about twice the rows, and all links."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "CELL", 4)
    kept, plain = [], minhash.checkpointed
    monkeypatch.setattr(minhash, "checkpointed", lambda df: kept.append(plain(df)) or kept[-1])

    def rows_of(n):
        r = random.Random(n)
        base = [f"w{i}" for i in range(200)]
        texts = []
        for k in range(n):
            own = list(base)
            for at in r.sample(range(200), 4):
                own[at] = f"z{k}x{at}"
            texts.append(" ".join(own))
            if k % 5 == 0:
                own[r.randrange(200)] = f"y{k}"
                texts.append(" ".join(own))
        sets = {i: plain_sets(t) for i, t in enumerate(texts)}
        links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
        kept.clear()
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {x.doc_id: x.component_id for x in minhash.near_duplicates(docs, percent=85).collect()} == plain_components(sets, links)
        met = [df for df in kept if {"token", "i", "j"} <= set(df.columns)]
        return sum(df.where("cell >= 0" if "cell" in df.columns else "true").count() for df in met)

    few, many = rows_of(60), rows_of(120)
    assert many <= 3 * few + 60 and many < 20 * 144


def test_chains_meet_in_cells(spark, monkeypatch):
    """As links inside and across cells and blocks, with forests first."""
    monkeypatch.setattr(minhash, "BLOCK", 6)
    monkeypatch.setattr(minhash, "CELL", 2)
    monkeypatch.setattr(minhash, "SALT_ROWS", 2)
    r = random.Random(4)
    texts = []
    for k in range(4):
        own = [f"s{i}" for i in range(120)] + [f"g{k}x{i}" for i in range(60)]
        for step in range(14):
            own = list(own)
            for at in r.sample(range(120, 180), 3):
                own[at] = f"n{k}x{step}x{at}"
            texts.append(" ".join(own))
    r.shuffle(texts)
    sets = {i: plain_sets(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = plain_components(sets, links)
    assert 1 < len(set(roots.values())) < 56
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(docs).collect()} == roots


def test_parities_lose_no_alike_pair():
    r = np.random.default_rng(6)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [np.unique(np.concatenate([pool[: n - n // 9], r.choice(pool, k), r.integers(0, 1 << 63, k).astype(np.uint64)])) for n in (1, 3, 60, 64, 70, 900, 1000, 1100) for k in (0, 1, 4, 12, n // 10)]
    rows = pd.DataFrame({"n_shingles": [len(s) for s in sets], "parity": [minhash._parity(s) for s in sets]})
    inter = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    union = rows.n_shingles.to_numpy()[:, None] + rows.n_shingles.to_numpy()[None, :] - inter
    for percent in (80, 85, 100):
        got = minhash._near_enough(rows, rows, np.ones_like(inter, dtype=bool), percent)
        assert got[100 * inter >= percent * union].all()
        assert not got[100 * inter < (percent - 20) * union].any()


def test_forest_of_close_pairs():
    close = np.ones((4, 4), bool)
    assert minhash._spanning(close, np.array([1, 2, 3, 4]), np.array([5, 6, 7, 8])).sum() == 7
    assert minhash._spanning(close, np.array([1, 1, 2, 2]), np.array([2, 2, 1, 1])).sum() == 1
    assert not minhash._spanning(~close, np.array([1, 2, 3, 4]), np.array([5, 6, 7, 8])).any()


def test_collisions_decide():
    tokens = np.arange(8)[None, :] + np.array([[0], [0], [100]])
    tokens[1, 5:] += 50
    rows = pd.DataFrame({"node": [1, 2, 3], "component": [1, 2, 3], "side": [0, 1, 1], "tokens": list(tokens)})
    assert minhash._collide(5)(rows).node.tolist() == [1, 2] and not len(minhash._collide(6)(rows))
    assert not len(minhash._collide(5)(rows.assign(component=7)))


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, r.randrange(101, 180)) for _ in range(60)] + [(7, 7), (200, 199)]
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    want = plain_components(nodes, [e for e in edges if e[0] != e[1]])
    assert got == want


def test_id_filter(spark):
    ids = spark.range(0, 500, 7)
    df = spark.range(500).withColumn("_word", F.lit("clash"))
    assert sorted(r.id for r in common.without_ids(df, "id", ids).collect()) == [i for i in range(500) if i % 7]


@pytest.mark.parametrize("cell", [4, 256])
def test_embeddings_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    r = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 1):
        centres = r.normal(size=(6, 8))
        for c in centres:
            for _ in range(9):
                rows.append((n, (c + r.normal(size=8) * r.choice([0, 0.1, 0.3])).tolist(), label))
                n += 1
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0]]
    rows += [(n + k, v, 0) for k, v in enumerate(odd)] + [(n + 7, rows[0][1], None), (n + 8, [x * 3 for x in rows[0][1]], 0), (n + 9, [-0.0 if x == 0 else x for x in rows[0][1]], 0)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("cell", T.StringType())])
    df = spark.createDataFrame([(*x, "clash") for x in rows], schema)
    good = {i: (np.array(v, float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93]
    roots = plain_components([i for i, *_ in rows], links)
    count = {i: sum(i in e for e in links) for i, *_ in rows}
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicates(df, cell=cell).collect()}
    assert len(links) > 20
    assert got == {i: (count[i], roots[i], roots[i] == i) for i, *_ in rows}
    kept = embeddings.keep_one(df, cell=cell)
    assert kept.columns == df.columns and kept.count() == sum(roots[i] == i for i, *_ in rows)


@pytest.mark.parametrize("cell", [4, 256])
def test_rows_of_one_id_count_for_themselves(spark, cell):
    """Repeated ids with other vectors or labels, repeated rows, and one vector under several ids, against comparing all rows."""
    r = np.random.default_rng(9)
    base = r.normal(size=(12, 4))
    rows = [(int(r.integers(0, 25)), (base[r.integers(0, 12)] + r.choice([0, 0.02, 0.6]) * r.normal(size=4)).tolist(), int(r.integers(0, 3))) for _ in range(70)]
    rows += rows[:8] + [(1, [1.0, 0.0], 7), (1, [0.0, 1.0], 7), (2, [0.0, 1.0], 7), (3, [-0.0, 1.0], 7), (1, [0.0, 1.0], 8), (None, [0.0, 1.0], 7), (2, None, 7)]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<double>, label int, name string, _row int")
    ok = [i is not None and v is not None for i, v, _ in rows]

    def linked(a, b):
        (_, v, x), (_, w, y) = rows[a], rows[b]
        return ok[a] and ok[b] and x == y and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93

    links = [[b for b in range(len(rows)) if b != a and linked(a, b)] for a in range(len(rows))]
    want = []
    for a, (i, v, label) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            new = [b for b in links[todo.pop()] if b not in seen]
            seen.update(new)
            todo += new
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        want.append((i, len(links[a]), least, None if i is None else i == least))
    assert sorted(map(tuple, embeddings.near_duplicates(df, cell=cell).collect()), key=str) == sorted(want, key=str)
    kept = embeddings.keep_one(df, cell=cell)
    assert kept.columns == df.columns
    stay = [(i, v, label) for (i, v, label), (_, _, _, k), good in zip(rows, want, ok) if k or not good]
    assert sorted(((x.vec_id, x.embedding, x.label) for x in kept.collect()), key=str) == sorted(stay, key=str)


def test_cells_that_tell_nothing_apart_become_one(spark):
    """Vectors in no order at all: rows placed stay near their number."""
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist(), 1, 1) for k, v in enumerate(x)], "vec_id long, v array<double>, label long, n_copies int")
    classes, _ = embeddings._classes(df.select("vec_id", "label", "v"))
    centres = embeddings._centres(classes.withColumn("n", F.lit(900)), 16, 0.93)
    placed = classes.mapInArrow(embeddings._assign(spark.sparkContext.broadcast(centres), 0.93), "name long, label long, dim long, n_copies long, vector binary, cell long, home boolean")
    assert placed.count() <= 3 * 900


def test_embeddings_of_extreme_sizes(spark):
    rows = [(0, [1e200, 1e200], 1), (1, [2e200, 2e200], 1), (2, [1e-200, 1e-200], 1), (3, [1.0, 1.0], 1), (4, [1e200, -1e200], 1), (5, [1.0, 1.0], 2)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (0, 5)}


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
