"""Benchmark decontamination: an FM-index per training shard, searched backwards for test phrases."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from .common import U, put, slices, span_hashes, texts_of, with_fields

WINDOW = 10
#: Bytes of training text under one index. Windows (about) of one benchmark block: at most 80 bytes each, so a block of about 20 MB; a worker holds one block at a time.
SHARD_BYTES, PHRASES = 1 << 20, 1 << 18
#: Words of a piece into which long items are cut (with overlap, so that no window is lost).
PIECE = 1 << 14
#: Every so many text positions the index keeps a suffix position.
SAMPLE = 8

#: For ``bytes.translate``: A-Z to lower case; a word is a run of 0-9, a-z and all beyond ASCII.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (bytes in their text) of all words, and where each text's words begin."""
    joined = b"\n".join(texts).translate(_LOWER) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    flips = np.flatnonzero(np.diff(np.concatenate(([False], _IN_WORD[data])).astype(np.int8)))
    starts, ends = flips[::2], flips[1::2]
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    at = np.searchsorted(starts, begins)
    own = np.repeat(begins[:-1], np.diff(at))
    return span_hashes(data, starts, ends), starts - own, ends - own, at


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector a level, the zeros of each level moved to the front."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.bits = max(1, int(sigma - 1).bit_length())
        for k in reversed(range(self.bits)):
            bit = (symbols >> k & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(U)
            sums = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.levels.append((words, sums, int(len(bit) - bit.sum())))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    @staticmethod
    def _ones(words: np.ndarray, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = (U(1) << (at & 63).astype(U)) - U(1)
        return sums[at >> 6] + np.bitwise_count(words[at >> 6] & low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        begin = np.zeros_like(at)
        for k, (words, sums, zeros) in zip(reversed(range(self.bits)), self.levels):
            bit = (symbol >> k & 1).astype(bool)
            one, first = self._ones(words, sums, at), self._ones(words, sums, begin)
            at = np.where(bit, zeros + one, at - one)
            begin = np.where(bit, zeros + first, begin - first)
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the places."""
        out = np.zeros(len(at), np.int64)
        for words, sums, zeros in self.levels:
            bit = (words[at >> 6] >> (at & 63).astype(U) & U(1)).astype(bool)
            one = self._ones(words, sums, at)
            at = np.where(bit, zeros + one, at - one)
            out = out * 2 + bit
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling; each 0 ends the comparison and sorts by its place."""
    n = len(text)
    stops = np.flatnonzero(text == 0)
    rank = text + len(stops)
    rank[stops] = np.arange(len(stops))
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (int(nxt.max(initial=0)) + 2) + nxt
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if not n or fresh[order[-1]] == n - 1:
            return order
        rank, step = fresh, step * 2


class FMIndex:
    """Over symbols 1 .. sigma-1 in runs that each begin after a 0."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        order = suffix_order(text)
        before = text[order - 1]
        self.size = len(text)
        self.tree = WaveletTree(before, sigma)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept = kept
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.samples = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each phrase (phrases stand at the right end of their rows)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for k in range(1, phrases.shape[1] + 1):
            live = live[(lengths[live] >= k) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, -k]
            low[live] = self.below[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back through the text until a kept position."""
        out, steps = np.zeros(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            there = self.kept[rows]
            out[todo[there]] = self.samples[self.kept_before[rows[there]]] + steps
            todo, rows, steps = todo[~there], rows[~there], steps + 1
            if len(rows):
                symbol = self.tree.access(rows)
                rows = self.below[symbol] + self.tree.rank(symbol, rows)
        return out


class Phrases:
    """The distinct windows of a block of benchmark items, over a vocabulary of word hashes."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int) -> None:
        hashes, _, _, at = words_of([t for _, t in items])
        self.words = np.unique(hashes)
        ids = np.concatenate((np.searchsorted(self.words, hashes) + 1, [0])).astype(np.int32)
        sizes = np.diff(at)
        n = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        item = np.repeat(np.arange(len(items)), n)
        first = at[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        length = np.minimum(sizes[item], window)
        rows = np.zeros((len(item), window), np.int32)
        for k in range(1, window + 1):  # windows stand at the right end of their rows
            rows[:, -k] = np.where(length >= k, ids[np.where(length >= k, first + length - k, -1)], 0)
        _, index, inverse = np.unique(rows.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)
        self.table, self.lengths = rows[index], length[index]
        self.shortest = int(self.lengths.min(initial=window))
        named = np.array([i is not None for i, _ in items], bool)
        names = np.array([i or 0 for i, _ in items], np.int64)
        pairs = np.unique(np.stack([inverse[named[item]], names[item][named[item]]], axis=1), axis=0) if named[item].any() else np.zeros((0, 2), np.int64)
        self.owners, self.owners_at = pairs[:, 1].copy(), np.searchsorted(pairs[:, 0], np.arange(len(index) + 1))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for a word of no phrase."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, at + 1, 0)

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]], np.ndarray, np.ndarray]:
        """For each text the number of words, the merged word spans inside occurrences and the items; the words' starts and ends."""
        hashes, starts, ends, at = words_of(texts)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[int]] = [set() for _ in texts]
        symbol = self.ids(hashes)
        # a word of no phrase, and the end of a text, end a run; runs too short for any phrase hold none
        new = np.concatenate(([True], symbol[1:] == 0, [True])) if len(symbol) else np.array([True])
        if len(symbol):
            new[1:-1] |= symbol[:-1] == 0
            new[at[:-1][at[:-1] < len(symbol)]] = True
        edges = np.flatnonzero(new)
        a, b = edges[:-1], edges[1:]
        good = (b - a >= self.shortest) & (symbol[a] != 0) if len(a) else np.zeros(0, bool)
        a, b = a[good], b[good]
        if len(a) and len(self.table):
            sizes = b - a + 1
            place = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            word = np.arange(sizes.sum()) - np.repeat(place - a + 1, sizes)
            text = symbol[word]
            text[place] = 0
            index = FMIndex(text, len(self.words) + 1)
            low, high = index.search(self.table, self.lengths)
            found = np.flatnonzero(high > low)
            n = high[found] - low[found]
            phrase = np.repeat(found, n)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[found], n)
            first = word[index.locate(rows)]
            cover = np.zeros(len(symbol) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + self.lengths[phrase], -1)
            inside = np.cumsum(cover)[:-1] > 0
            owner = np.searchsorted(at, first, "right") - 1
            for d, p in set(zip(owner.tolist(), phrase.tolist())):
                items[d].update(self.owners[self.owners_at[p] : self.owners_at[p + 1]].tolist())
            for d in set(owner.tolist()):
                f = np.flatnonzero(np.diff(np.concatenate(([False], inside[at[d] : at[d + 1]], [False])).astype(np.int8)))
                spans[d] = list(zip(f[::2].tolist(), f[1::2].tolist()))
        return np.diff(at), spans, items, np.split(starts, at[1:-1]), np.split(ends, at[1:-1])


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _pieces(window: int):
    """Items as pieces of at most ``PIECE`` words that together hold all their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch, "t")):
                _, starts, ends, _ = words_of([text])
                cuts = [(k, min(len(starts), k + PIECE)) for k in range(0, max(1, len(starts) - window + 1), PIECE - window + 1)] if len(starts) else []
                if cuts:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(cuts), pa.int64()), pa.array([text[starts[a] : ends[b - 1]] for a, b in cuts], pa.binary()), pa.array([b - a for a, b in cuts], pa.int64())], names=["i", "t", "n"])

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list[Broadcast]:
    """Broadcast phrases, each of about ``PHRASES`` windows at most; the driver holds one block at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").mapInArrow(_pieces(window), "i long, t binary, n long")
    parts = math.ceil((items.agg(F.sum("n")).first()[0] or 0) / PHRASES) or 1
    block = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(Phrases([(r.i, bytes(r.t)) for r in items.where(block == k).collect()], window)) for k in range(parts)]


def _each(blocks: list[Broadcast]) -> Iterator[Phrases]:
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            vars(b).pop("_value", None)  # read again for the next shard, so that one block is held at a time


def _scan(blocks: list[Broadcast], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, SHARD_BYTES):
                texts = texts_of(batch, text_col)
                spans, items = [[] for _ in texts], [set() for _ in texts]
                for phrases in _each(blocks):
                    n, more, own, _, _ = phrases.hits(texts)
                    spans = [_merge(a + b) if a else b for a, b in zip(spans, more)]
                    items = [a | b for a, b in zip(items, own)]
                made = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield put(batch, n_words=pa.array(n, pa.int64()), hit_spans=made, item_ids=pa.array([sorted(i) for i in items], pa.list_(pa.int64())))

    return run


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, hit_spans (merged [start, end) word spans inside occurrences) and item_ids.

    Words are runs of 0-9, a-z (A-Z lowered) and characters beyond ASCII. Each shard of texts
    becomes one sequence of symbols: a word that no phrase has ends a run, and runs shorter than
    any phrase hold none. Its FM-index is built, searched backwards for all phrases at once and let go. An item with
    fewer words than ``window``, but not none, is one phrase. Null and empty texts have no words and
    no hits; a longer text is a shard of its own, whole; null items have no phrases, items without id hit without being named; repeated rows each get their result; columns of ``docs``
    named as an output give way; an empty table gives an empty one. No shuffle; the benchmark is broadcast in blocks of bounded size, whatever its own.
    """
    docs = docs.drop("n_words", "hit_spans", "item_ids")
    return docs.mapInArrow(_scan(_blocks(benchmark, item_col, item_text, window), text_col), with_fields(docs.schema, ("n_words", T.LongType()), ("hit_spans", _SPANS), ("item_ids", T.ArrayType(T.LongType()))))


def _without(text: bytes, spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, text[at:]])


def _cut(blocks: list[Broadcast], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, SHARD_BYTES):
                texts = texts_of(batch, text_col)
                live, cut = list(range(len(texts))), set()
                while live:  # each round shortens the texts that stay in it by a word at least
                    hit = set()
                    for phrases in _each(blocks):
                        _, spans, _, starts, ends = phrases.hits([texts[k] for k in live])
                        for k, s, a, b in zip(live, spans, starts, ends):
                            if s:
                                texts[k] = _without(texts[k], s, a, b)
                                hit.add(k)
                    cut |= hit
                    live = sorted(hit)
                place = batch.schema.get_field_index(text_col)
                column = batch.column(place).to_pylist()
                for k in cut:
                    column[k] = texts[k].decode()
                yield batch.set_column(place, batch.schema.field(place), pa.array(column, batch.schema.field(place).type))

    return run


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with all removal spans cut from the text, until no phrase is left, also where cuts join.

    Texts of a shard that were cut are searched again together, so the number of rounds is that of
    the text with the most; other rows and columns stay as they are; null texts stay null.
    """
    return docs.mapInArrow(_cut(_blocks(benchmark, item_col, item_text, window), text_col), docs.schema)
