"""Divergence audit, conversation repair and token counts against plain versions, odd rows included."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from mediamill.llm import conversations, divergence, tokencounts

# ---- conversation repair


def damage(rows):
    """By the rule, one row after the other: (conv, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [row] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """All edits of a short conversation, tried one by one (up to two insertions anywhere)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        signs = re.sub(r"[ \t-\r]", "", text)
        faults.append("blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else "")
        seen.add((role, text))
    best = (float("inf"), "", None)
    n = len(rows)
    for edits in itertools.product("DKR", repeat=n):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits)):
            continue
        for inserted in itertools.chain([()], itertools.combinations_with_replacement(range(n + 1), 1), itertools.combinations_with_replacement(range(n + 1), 2)):
            audit, roles, lines = "", "", []
            options = [("", "", [], 0)]
            for k in range(n + 1):
                for _ in range(inserted.count(k)):
                    options = [(a + "I", r + x[0], ls + [f"{x}:"], c + 5) for a, r, ls, c in options for x in ("user", "assistant")]
                if k < n:
                    _, _, role, text = rows[k]
                    more = 5 * (faults[k] == "truncated")
                    if edits[k] == "D":
                        options = [(a + "D", r, ls, c + 2) for a, r, ls, c in options]
                    elif edits[k] == "K":
                        options = [(a + "K", r + (role[:1] or "-"), ls + [f"{role}:{text}"], c + more) for a, r, ls, c in options]
                    else:
                        options = [(a + "R", r + x[0], ls + [f"{x}:{text}"], c + 1 + more) for a, r, ls, c in options for x in ("user", "assistant")]
                options = [o for o in options if re.fullmatch("(s?(ua)*u?)?", o[1])]
            for audit, roles, lines, cost in options:
                if re.fullmatch("(s?(ua)+)?", roles) and (cost, audit) < best[:2]:
                    best = (cost, audit, "\n".join(lines))
    times = {r[1] for r in rows if r[1] is not None}
    gaps = max(times) - min(times) + 1 - len(times) if times else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


@pytest.fixture(scope="module")
def talks():
    r = random.Random(3)
    texts = ["Yes.", "No!", "what", "  \t", "", None, "Is it?  ", "end ."]
    rows = [(c, r.choice([None, *range(6)]) if r.random() < 0.2 else t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice(texts)) for c in range(120) for t in range(r.randint(1, 4))]
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes.")]


def repaired(spark, rows, **bounds):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    return {r.conv: tuple(r[c] for c in COLUMNS) for r in conversations.repair(conversations.damaged(df), **bounds).collect()}


@pytest.mark.parametrize("longest", [1024, 2, 0])
def test_repair_equals_trying_all_edits(spark, talks, longest):
    """As arrays, row by row, and some this way and some that."""
    want = defaultdict(list)
    for row in damage(talks):
        want[row[0]].append(row)
    got = repaired(spark, talks, longest=longest)
    assert set(got) == {r[0] for r in talks}
    for conv, found in got.items():
        assert found == plain_repair(want[conv]), conv


def test_long_conversations_go_row_by_row(spark):
    rows = [(1, t, ["user", "assistant", "assistant"][t % 3], f"Text {t}.") for t in range(1500)] + [(2, 0, "user", "A."), (2, 1, "assistant", "B.")]
    got = repaired(spark, rows)
    assert got == repaired(spark, rows, longest=5000)
    assert len(got[1][6].replace("I", "")) == len([r for r in damage(rows) if r[0] == 1])


def test_no_conversations(spark):
    assert repaired(spark, []) == {}


# ---- token counts


@pytest.fixture(scope="module")
def mixed():
    r = random.Random(5)
    bits = ["a", "b", "the ", "'s", "'", "''", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "<|endof", "text|>", "1", "22", "…", "中文", "。", "ü", "!", "?'ll", " '", " ", "　", "é", "😀", "x" * 30, "\x85", "ꟲ", "𞤀"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 400))) for _ in range(150)]
    return [None, "", *texts, "a" * 3000, "'" * 500 + "s" * 500, " " * 1000, "<|endoftext|>" * 200, "ab " * 700, "é" * 999]


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (100, 40), (1 << 14, 128)])
def test_counts_equal_whole_texts(spark, mixed, chunk, overlap):
    library = Tokenizer.from_file(tokencounts.default_vocabulary())
    rows = [(None if k == 7 else k % 100, t, "other") for k, t in enumerate(mixed + mixed[:20])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokencounts.count_tokens(df, chunk=chunk, overlap=overlap).collect()), key=str)
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    assert got == sorted([(i, len((t or "").encode()), n, n > 1024) for (i, t, _), n in zip(rows, counts)], key=str)


def test_stable_places_are_boundaries_in_every_surrounding(mixed):
    library = Tokenizer.from_file(tokencounts.default_vocabulary())
    for text in mixed[2:60]:
        for b in tokencounts.stable(text, ["<|endoftext|>"], 0, len(text)):
            for a, z in ((0, len(text)), (max(0, b - 14), len(text)), (0, b + 14)):
                begins = {x for x, _ in library.encode(text[a:z], add_special_tokens=False).offsets}
                assert b - a in begins


def test_count_tokens_of_nothing(spark):
    assert tokencounts.count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---- divergence audit


def plain_audit(docs, least=10):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in docs]
    df, per, groups = defaultdict(Counter), defaultdict(Counter), sorted({t[:2] for t in terms})
    for lang, source, found in terms:
        df[lang].update(set(found))
        per[lang, source].update(found)
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]
        every = Counter()
        for key, found in per.items():
            every.update(found if key[0] == lang else {})

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        p, q, f = share(per[lang, source]), share(every), lambda a, b: (a - b) ** 2 // (a + b)
        peers = [(s, share(per[lang, s])) for x, s in groups if x == lang and s != source]
        pairs = [(s, sum(f(p[t], other[t]) for t in kept)) for s, other in peers]
        telling = [(t, f(p[t], q[t])) for t in kept if per[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", telling)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                if part == "pair" or rank <= 10:
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"shard": 64, "slot": 2}])
def test_audit_equals_counting(spark, bounds):
    r = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)] + ["É", "x_y", "Ab9c", "中文"]
    docs = [(r.choice(["en", "en", "de", None, "xx"]), r.choice([*"abcdefg", None, ""]), " ".join(r.choices(words, k=r.randint(0, 60)))) for _ in range(400)]
    docs += [("fr", "only", "one two"), ("it", "a", "due"), ("it", "b", None), ("en", "none", None)] + [("en", "a", "spam spam")] * 12
    df = spark.createDataFrame([(*d, 1) for d in docs], "lang string, source string, text string, rank int")
    assert sorted(map(tuple, divergence.audit(df, **bounds).collect())) == plain_audit(docs)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_shares_stay_exact_for_large_counts():
    for n, total, kinds in ((7_123_456_789_012, 8_999_999_999_999_000, 10**6), (0, 0, 1), (5, 5, 1), (10**13, 10**13, 3)):
        assert int(divergence.share(n, total, kinds)) == 1 + 10**9 * (n + 2) // (total + 2 * kinds)


@pytest.mark.parametrize("slots", [2, 4, 6, 16])
def test_a_tournament_has_each_meeting_once(slots):
    met = [frozenset((s, divergence.opponent(s, turn, slots))) for turn in range(slots - 1) for s in range(slots)]
    assert Counter(met) == {frozenset(x): 2 for x in itertools.combinations(range(slots), 2)}
