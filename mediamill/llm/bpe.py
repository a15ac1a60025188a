"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words."""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import checkpointed, put, slices, span_hashes, with_fields

#: Frequent words in the lexicon, at most.
LEXICON = 1 << 15
#: Words that a Python worker remembers before it starts anew.
REMEMBERED = 120_000
#: Longer words are merged with a heap, one at a time.
LONG = 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_names() -> list[str]:
    """Printable stand-ins of the 256 bytes: visible Latin-1 stands for itself, the others for U+0100 on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in visible else next(rest)) for b in range(256)]


_HEAD = "'s|'t|'re|'ve|'m|'ll|'d"
_FEW = 0x250


class Pieces:
    """Texts to words: special strings, NFC, lower case by character, then contractions, runs of letters, single digits and runs of other signs.

    Texts of characters below U+0250 are cut together as arrays; others, and texts that may hold a special string, one by one.
    """

    def __init__(self, special: list[str]) -> None:
        kind = {"L": 1, "N": 2}
        self.kinds = np.array([kind.get(unicodedata.category(chr(c))[0], 3) for c in range(_FEW)], np.uint8)
        self.kinds[[*range(9, 14), 32, 0x85, 0xA0]] = 0
        self.full = regex.compile(rf"{_HEAD}|\p{{L}}+|\p{{N}}|[^\p{{White_Space}}\p{{L}}\p{{N}}]+").findall
        self.far = re.compile(f"[^\x00-{chr(_FEW - 1)}]").search
        self.special = set(special)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.may_hold = [s[:2] for s in special]

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def one(self, text: str) -> list[str]:
        """The words of any text."""
        out: list[str] = []
        for part in self.split(text) if self.split else [text]:
            out += [part] if part in self.special else self.full(self.normal(part))
        return out

    def many(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, list[str]]]:
        """Of the texts cut as arrays: their places, codes, word starts and ends, and where each text's words begin; of the others, by place, the words."""
        quick, parts, others = [], [], {}
        for k, text in enumerate(texts):
            if any(s in text for s in self.may_hold) or self.far(low := self.normal(text)):
                others[k] = self.one(text)
            else:
                quick.append(k)
                parts.append(low)
        codes = np.frombuffer(("\n".join(parts) + "\n\n\n\n").encode("utf-16-le"), np.uint16)
        kinds = self.kinds[codes]
        begin = np.zeros(len(codes), bool)
        begin[0] = kinds[0] != 0
        begin[1:] = (kinds[1:] != 0) & ((kinds[1:] != kinds[:-1]) | (kinds[1:] == 2))
        at = np.flatnonzero((codes[:-1] == 39) & begin[:-1] & (kinds[1:] == 1))
        one, two = codes[at + 1], codes[at + 2]
        size = np.isin(one, [ord(c) for c in "stmd"]) + 2 * (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        at, size = at[size > 0], size[size > 0]
        begin[at + 1] = False
        rest = at + 1 + size
        begin[rest[kinds[rest] == 1]] = True
        ends = np.flatnonzero((kinds[:-1] != 0) & (begin[1:] | (kinds[1:] == 0))) + 1
        starts = np.flatnonzero(begin)
        first = np.cumsum([0, *(len(p) + 1 for p in parts)])
        return quick, codes, starts, ends, np.searchsorted(starts, first), others


class Vocabulary:
    """Token ids, merge ranks and names of a word-end BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in added}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.names = [""] * size
        for name, i in (ids | self.special).items():
            self.names[i] = name
        names = _byte_names()
        self.inner = np.array([ids[c] for c in names], np.int64)
        self.final = np.array([ids[c + end] for c in names], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}
        table = np.array([(a << 20 | b, r, to) for (a, b), (r, to) in self.merges.items()], np.int64)
        table = table[np.argsort(table[:, 0])]
        self.keys, self.ranks, self.made = table.T.copy()

    def merge_one(self, word: bytes) -> list[int]:
        """The ids of one word: a heap of adjacent pairs by rank and place."""
        ids = [int(self.inner[b]) for b in word[:-1]] + [int(self.final[word[-1]])]
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (m := self.merges.get((ids[i], ids[after[i]]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i] = self.merges[a, b][1]
            ids[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of many short words at once: in each round every word merges its pair of lowest rank, from the left."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        ids = self.inner[data]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.final[data[ends]]
        done_ids, done_words = [], []
        while len(ids):
            key = np.where(word[1:] == word[:-1], ids[:-1] << 20 | ids[1:], -1)
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where(self.keys[at] == key, self.ranks[at], 1 << 40)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(np.append(rank, 1 << 40), first)
            runs = np.diff(np.append(first, len(ids)))
            least = np.repeat(low, runs)
            pick = np.flatnonzero((rank == least[:-1]) & (rank < 1 << 40))
            if len(pick) > 1:  # of overlapping pairs in a row every second
                new = np.concatenate(([True], np.diff(pick) != 1))
                begin = np.maximum.accumulate(np.where(new, np.arange(len(pick)), 0))
                pick = pick[(np.arange(len(pick)) - begin) % 2 == 0]
            ids[pick] = self.made[at[pick]]
            keep = np.ones(len(ids), bool)
            keep[pick + 1] = False
            rest = least >= 1 << 40
            done_ids.append(ids[rest])
            done_words.append(word[rest])
            keep &= ~rest
            ids, word = ids[keep], word[keep]
        if not done_ids:
            return []
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return np.split(ids[order], np.searchsorted(word[order], np.arange(1, len(words))))


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """A minimal acyclic transducer from words to ids, as bytes to map.

    Words come in order; states with equal futures are shared (incremental minimisation). An arc's
    output is the number of words before it, so the outputs along a word sum to its number, which
    finds its ids.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # of each letter of the last word: final, arcs so far

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            shape = (final, tuple(arcs))
            if shape not in register:
                register[shape] = len(states)
                states.append(shape)
            label = path[-1][1][-1][0]
            path[-1][1][-1] = (label, register[shape])

    entries = sorted({w: ids for w, ids in entries if w}.items())
    last = b""
    for word, _ in entries:
        same = len(os.path.commonprefix([last, word]))
        close(same)
        for c in word[same:]:
            path[-1][1].append((c, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    below = []
    for final, arcs in states:  # targets stand before their sources
        below.append(final + sum(below[t] for _, t in arcs))
    keys, targets, outputs = [], [], []
    for s, (final, arcs) in enumerate(states):
        skip = int(final)
        for c, t in arcs:
            keys.append(s << 8 | c)
            targets.append(t)
            outputs.append(skip)
            skip += below[t]
    ids = [i for _, x in entries for i in x]
    at = np.concatenate(([0], np.cumsum([len(x) for _, x in entries]))).astype(np.int64)
    parts = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64), np.array([f for f, _ in states], np.int64), at, np.array(ids, np.int64)]
    head = np.array([len(p) for p in parts], np.int64)
    return head.tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, mapped from a file of the worker's own that is gone when the worker ends."""

    def __init__(self, data: bytes) -> None:
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.map, np.int64, 6)
        at, parts = 48, []
        for n in sizes.tolist():
            parts.append(np.frombuffer(self.map, np.int64, n, at))
            at += 8 * n
        self.keys, self.targets, self.outputs, self.finals, self.at, self.ids = parts

    def find(self, words: list[bytes]) -> list[np.ndarray | None]:
        """For each word its ids, or None; all words walk through the automaton together."""
        if not len(self.keys) or not words:
            return [None] * len(words)
        sizes = np.array([len(w) for w in words])
        state = np.full(len(words), len(self.finals) - 1)
        number = np.zeros(len(words), np.int64)
        live = np.flatnonzero(sizes <= LONG)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        ok = np.zeros(len(words), bool)
        k = 0
        while len(live):
            over = sizes[live] == k
            ok[live[over]] = self.finals[state[live[over]]] == 1
            live = live[~over]
            key = state[live] << 8 | data[begin[live] + k]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            there = self.keys[at] == key
            live, at = live[there], at[there]
            number[live] += self.outputs[at]
            state[live] = self.targets[at]
            k += 1
        return [self.ids[self.at[n] : self.at[n + 1]] if good else None for n, good in zip(number.tolist(), ok.tolist())]


class Encoder:
    """Texts to packed ids; words once met are remembered within a worker, by hash or, from uncommon texts, as they are."""

    def __init__(self, path: str, lexicon: bytes) -> None:
        self.vocabulary = Vocabulary(path)
        self.lexicon = Lexicon(lexicon)
        self.pieces = Pieces(list(self.vocabulary.special))
        self.hashed: dict[int, bytes] = {}
        self.known: dict[str, bytes] = {}
        names = [n.encode() + b" " for n in self.vocabulary.names]
        self.name_sizes = np.array([len(n) for n in names], np.int64)
        self.name_starts = np.cumsum(self.name_sizes) - self.name_sizes
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)

    def words(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words: those of the lexicon, else merged."""
        raw = [w.encode() for w in words]
        found = self.lexicon.find(raw)
        short = [k for k, ids in enumerate(found) if ids is None and len(raw[k]) <= LONG]
        for k, ids in zip(short, self.vocabulary.merge_all([raw[k] for k in short])):
            found[k] = ids
        return [np.asarray(self.vocabulary.merge_one(r) if ids is None else ids, "<u4").tobytes() for r, ids in zip(raw, found)]

    def encode(self, texts: list[str]) -> list[bytes]:
        quick, codes, starts, ends, at, others = self.pieces.many(texts)
        out = [b""] * len(texts)
        if len(self.hashed) > REMEMBERED:
            self.hashed.clear()
        if len(starts):
            names, index, inverse = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
            keys = names.tolist()
            packed = list(map(self.hashed.get, keys))
            new = [k for k, x in enumerate(packed) if x is None]
            spelled = [codes[starts[i] : ends[i]].tobytes().decode("utf-16-le") for i in index[new].tolist()]
            for k, ids in zip(new, self.words(spelled)):
                self.hashed[keys[k]] = packed[k] = ids
            pool = np.frombuffer(b"".join(packed), "<u4")
            sizes = np.array([len(x) for x in packed], np.int64) // 4
            pool_at = np.cumsum(sizes) - sizes
            own = sizes[inverse]
            total = np.concatenate(([0], np.cumsum(own)))
            ids = pool[np.repeat(pool_at[inverse] - total[:-1], own) + np.arange(total[-1])]
            for k, a, b in zip(quick, total[at[:-1]], total[at[1:]]):
                out[k] = ids[a:b].tobytes()
        for k, words in others.items():
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = [w for w in dict.fromkeys(words) if w not in self.known and w not in self.vocabulary.special]
            self.known.update(zip(new, self.words(new)))
            self.known.update({w: np.array([i], "<u4").tobytes() for w, i in self.vocabulary.special.items()})
            out[k] = b"".join([self.known[w] for w in words])
        return out

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The file names no decoder, so token names are joined by spaces, special ones too."""
        ids = np.frombuffer(b"".join(packed), "<u4")
        own = self.name_sizes[ids]
        total = np.concatenate(([0], np.cumsum(own)))
        text = self.name_bytes[np.repeat(self.name_starts[ids] - total[:-1], own) + np.arange(total[-1])]
        at = total[np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed])))]
        return [text[a : b - 1].tobytes() if b > a else b"" for a, b in zip(at[:-1], at[1:])]


_encoders: dict[tuple[str, int], Encoder] = {}


def frequent_words(docs: DataFrame, text_col: str, path: str, limit: int) -> list[str]:
    """The most frequent words over all texts, by whole levels of frequency (sixteenths of a doubling), at most ``limit``; tasks sum their own counts first."""
    special = list(Vocabulary(path).special)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = Pieces(special), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(w, n) for w, n in seen.items() if w not in pieces.special and len(w) <= LONG]
            seen.clear()
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + 20_000]], pa.string()), pa.array([r[1] for r in rows[k : k + 20_000]], pa.int64())], names=["word", "n"])

        for whole in batches:
            for batch in slices(whole, "t"):
                _, codes, starts, ends, _, others = pieces.many([t or "" for t in batch.column(0).to_pylist()])
                _, index, n = np.unique(span_hashes(codes, starts, ends), return_index=True, return_counts=True)
                for i, k in zip(index.tolist(), n.tolist()):
                    seen[codes[starts[i] : ends[i]].tobytes().decode("utf-16-le")] += k
                for words in others.values():
                    seen.update(words)
                if len(seen) > REMEMBERED:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    rows = checkpointed(rows.withColumn("level", F.floor(F.log2("n") * 16).cast("int")))
    levels = sorted(rows.groupBy("level").count().collect(), reverse=True)
    total, least = 0, None
    for level, n in levels:
        total += n
        if total > limit:
            break
        least = level
    return [] if least is None else sorted(r.word for r in rows.where(F.col("level") >= least).select("word").collect())


def build_lexicon(docs: DataFrame, text_col: str = "text", path: str | None = None, limit: int = LEXICON) -> bytes:
    """The compiled lexicon of the corpus' frequent words (at most ``limit``, so at most a few MB)."""
    path = path or default_vocabulary()
    words = [w.encode() for w in frequent_words(docs, text_col, path, limit)]
    return compile_lexicon(list(zip(words, [x.tolist() for x in Vocabulary(path).merge_all(words)])))


def _as_lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, lexicon: bytes | None = None, lists: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids (packed little-endian unsigned 32-bit integers; lists: an array) and decoded (their text).

    Equals the tokenizers library on the same file without added special tokens; their strings in a
    text become their ids. Null counts as empty: no ids, empty decoded text. ``path`` must be a file
    at the same place on every node. Columns of ``docs`` named as an output give way.
    """
    path = path or default_vocabulary()
    spark: SparkSession = docs.sparkSession
    docs = docs.drop("n_tokens", "ids", "decoded")
    if lexicon is None:
        lexicon = build_lexicon(docs, text_col, path)
    key, shared = hashlib.sha256(lexicon).hexdigest(), spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, key) not in _encoders:
            _encoders.clear()
            _encoders[path, key] = Encoder(path, shared.value)
        encoder = _encoders[path, key]
        for whole in batches:
            for batch in slices(whole, text_col):
                ids = encoder.encode([t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()])
                yield put(batch, n_tokens=pa.array([len(a) // 4 for a in ids], pa.int64()), ids=_as_lists(ids) if lists else pa.array(ids, pa.binary()), decoded=pa.array(encoder.decode(ids), pa.binary()).cast(pa.string()))

    return docs.mapInArrow(run, with_fields(docs.schema, ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()) if lists else T.BinaryType()), ("decoded", T.StringType())))
