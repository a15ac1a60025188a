"""Token counts of whole texts: huge documents are encoded as overlapping chunks and spliced where both encodings must agree."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, slices

#: Characters of a chunk, and by how many it reaches over a cut on either side, in the first round; either grows by GROWTH where no common boundary is found.
CHUNK, OVERLAP, GROWTH = 1 << 14, 128, 8
#: Documents of more tokens are over the limit.
LIMIT = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_tokenizers: dict = {}


def _tokenizer(path: str):
    """The worker's tokenizer, on one thread: Spark deals out the work."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _tokenizers[path] = made, sorted(t.content for t in made.get_added_tokens_decoder().values())
    return _tokenizers[path]


_old = unicodedata.ucd_3_2_0.category


def stable(text: str, special: list[str], start: int, end: int) -> list[int]:
    """The places in (start, end) before which a word must end, whatever stands further away on either side.

    The tokenizer cuts texts into special strings and then, in what lies between, from the left into contractions,
    runs of letters, of digits and of other signs (each with at most one space before it), and runs of white
    space. None of these goes on from a letter to anything but a letter, from a digit to anything but a
    digit, or from a sign to white space; what follows such a place depends on what stands to its right
    alone, what precedes it on what stands to its left. Special strings are the exception, so places inside one
    aren't stable; nor are those that lie so close to an end of ``text`` that one may reach over it. Kinds of
    characters are those of Unicode 3.2, which later versions keep; newer characters give no place.
    """
    margin = max(map(len, special), default=0)
    start, end = max(start, margin + 1), min(end, len(text) - margin - 1)
    taken: set[int] = set()
    for s in special:
        at = text.find(s, max(0, start - margin), end + margin)
        while at >= 0:
            taken.update(range(at + 1, at + len(s)))
            at = text.find(s, at + 1, end + margin)
    out = []
    for b in range(start, end):
        one, two = text[b - 1], text[b]
        if two in " \t\n\r" and one not in " \t\n\r":
            kind = _old(one)[0]
            ok = kind in "LNPSM"
        else:
            kind, other = _old(one)[0], _old(two)
            ok = kind in "LN" and other[0] in "LNPS" and other[0] != kind
        if ok and b not in taken:
            out.append(b)
    return out


def _kinds() -> tuple[str, str, str, str]:
    """White space, letters, digits and other signs as regular expression classes: characters below U+10000 that Unicode 3.2 knew and that are of one kind still."""
    space = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    kind = lambda category: category if category in "LNZ" else "*"
    of = []
    for c in range(0xD800):
        old, new = _old(chr(c)), unicodedata.category(chr(c))
        of.append("Z" if c in space else kind(new[0]) if old != "Cn" and kind(old[0]) == kind(new[0]) != "Z" else "")
    classes = []
    for wanted in "ZLN*":
        at = [c for c, k in enumerate(of) if k == wanted]
        runs, begin = [], at[0]
        for c, after in zip(at, [*at[1:], -1]):
            if after != c + 1:
                runs.append(f"\\U{begin:08x}-\\U{c:08x}")
                begin = after
        classes.append("".join(runs))
    return tuple(classes)


class Words:
    """Tokens of texts by their words, each distinct word encoded once while it is remembered."""

    REMEMBERED = 200_000

    def __init__(self, path: str) -> None:
        encoder, self.special = _tokenizer(path)
        self.encoder = encoder
        z, letters, digits, signs = _kinds()
        self.plain = re.compile(f"[{z}{letters}{digits}{signs}]*").fullmatch
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[{signs}]+|[{z}]+(?![{letters}{digits}{signs}])|[{z}]+").findall
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

        class Known(dict):
            def __missing__(known, word: str) -> int:  # noqa: N805
                known[word] = n = len(encoder.encode(word, add_special_tokens=False).ids)
                return n

        self.known = Known()

    def cut(self, text: str) -> list[str] | None:
        """The words of a text, special strings included; None if it holds characters whose kind the tokenizer might know otherwise."""
        if not self.plain(text):
            return None
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        if not any(s in text for s in self.special):
            return self.words(text)
        out: list[str] = []
        for part in self.split(text):
            out += [part] if part in self.special else self.words(part)
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts: the sum over their words; texts of uncommon characters go to the library as they are."""
        cut = [self.cut(t) for t in texts]
        rest = [k for k, words in enumerate(cut) if words is None]
        out = [0 if words is None else sum(map(self.known.__getitem__, words)) for words in cut]
        for k, found in zip(rest, self.encoder.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = len(found.ids)
        return out

    def boundaries(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of tokens, and of each place where a word (or, of uncommon texts, a token) begins: the place and the tokens before it."""
        words = self.cut(text)
        if words is not None:
            before = np.cumsum([0, *map(self.known.__getitem__, words)])
            return int(before[-1]), np.cumsum([0, *map(len, words)])[:-1], before[:-1]
        spans = np.array(self.encoder.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] >= spans[:-1, 1]))) if len(spans) else np.zeros(0, np.int64)
        return len(spans), spans[first, 0], first


_words: dict[str, Words] = {}


def _worker(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def _cut(chunk: int, overlap: int):
    """Texts as overlapping chunks: the k-th owns [k * chunk, (k + 1) * chunk) and reaches over either cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                text = one.column(one.schema.get_field_index("text"))[0].as_py()
                n = max(1, -(-len(text) // chunk))
                step = max(1, (1 << 22) // (chunk + 2 * overlap))
                for k in range(0, n, step):  # a few MB at a time
                    ks = range(k, min(n, k + step))
                    pieces = [text[max(0, i * chunk - overlap) : (i + 1) * chunk + overlap] for i in ks]
                    same = [one.column(one.schema.get_field_index(c)).take(pa.array([0] * len(ks))) for c in ("id", "sha")]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(ks, pa.int64()), pa.array([n] * len(ks), pa.int64()), pa.array(pieces, pa.string())], names=["id", "sha", "k", "n", "piece"])

    return run


def _encoded(path: str, chunk: int, overlap: int):
    """For each chunk and each end of it that is a cut: stable token boundaries near the cut (from the cut on) and the tokens between; a whole document gives its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker(path)
        special = words.special
        for batch in batches:
            out: dict[str, list] = {"cut": [], "places": [], "before": []}
            take = []
            for row, (k, n, piece) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k", "n", "piece")))):
                total, places, before = words.boundaries(piece)
                begin = max(0, k * chunk - overlap)
                known = dict(zip(places.tolist(), before.tolist()))
                for cut in ([k] if k else []) + ([k + 1] if k + 1 < n else []):
                    at = cut * chunk - begin
                    found = [b for b in stable(piece, special, at - overlap + 1, at + overlap) if b in known]
                    take.append(row)
                    out["cut"].append(cut)
                    out["places"].append([b - at for b in found])
                    # a left end counts what is dropped before it, a right end what is kept before it
                    out["before"].append([known[b] if cut > k else -known[b] for b in found])
                if k + 1 == n:
                    take.append(row)
                    out["cut"].append(-1)
                    out["places"].append([0])
                    out["before"].append([total])
            same = [batch.column(batch.schema.get_field_index(c)).take(pa.array(take, pa.int64())) for c in ("id", "sha")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(out["cut"], pa.int64()), pa.array(out["places"], pa.list_(pa.int64())), pa.array(out["before"], pa.list_(pa.int64()))], names=["id", "sha", "cut", "places", "before"])

    return run


def _spliced(ends: DataFrame) -> DataFrame:
    """(id, sha, n_tokens): at each cut both sides take the common boundary nearest to it; null if a cut has none."""
    place = F.explode_outer(F.arrays_zip("places", "before"))
    at = ends.withColumn("p", place).groupBy("id", "sha", "cut", F.col("p.places").alias("place")).agg(F.count("*").alias("sides"), F.sum("p.before").alias("tokens"))
    common = (F.col("cut") < 0) | (F.col("sides") == 2)
    best = at.groupBy("id", "sha", "cut").agg(F.min(F.when(common & F.col("place").isNotNull(), F.struct(F.abs("place").alias("far"), "place", "tokens"))).alias("best"))
    return best.groupBy("id", "sha").agg(F.when(F.count("best") == F.count("*"), F.sum("best.tokens")).alias("n_tokens"))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens as the tokenizers library counts whole texts, over_limit (more than ``limit`` tokens).

    No special tokens are added; special strings in a text count as one token each, as is the library's default. Null and
    empty texts have no bytes and no tokens. Each row counts for itself, repeated rows and ids too; a null id stays null. An
    empty table gives an empty one; other columns don't come along. ``path`` must be a file at the same place on every node.

    Words don't depend on each other, so each distinct one is encoded once while a worker remembers it; texts with characters that Unicode
    3.2 didn't know go to the library whole. Texts of at most ``chunk`` characters are counted as they are. A longer one becomes chunks that overlap,
    dealt out over all tasks and encoded with offsets. Two neighbours are spliced at the place nearest to their cut that
    is stable (see ``stable``) and a boundary of both encodings. If a cut of a document has no such place, the
    document goes into another round with chunks and overlaps GROWTH times as large, until a chunk holds it
    whole: a text without any stable place is one word to the library too. So a task holds one chunk and
    one text, and rounds end after the logarithm of the longest text.
    """
    path = path or default_vocabulary()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker(path)
        for one in batches:
            for batch in slices(one, "text"):
                texts = batch.column(1).to_pylist()
                counts = words.count(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    done = rows.where(F.length("text") <= chunk).mapInArrow(whole, f"id {kind}, n_bytes long, n_tokens long")
    key = F.struct("id", "sha")
    large = rows.where(F.length("text") > chunk).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    # equal rows are encoded once
    left = large.groupBy("id", "sha").agg(F.count("*").alias("copies"), F.max(F.octet_length("text")).cast("long").alias("n_bytes"), F.max(F.length("text")).alias("n_chars"))
    left = checkpointed(left)
    counted = left.limit(0).select("id", "sha", F.lit(0).cast("long").alias("n_tokens"))
    open_keys, longest = None, left.agg(F.max("n_chars")).first()[0]
    while longest is not None:
        texts = large if open_keys is None else large.withColumn("key", key).join(open_keys, "key", "left_semi").drop("key")
        pieces = texts.select("id", "sha", "text").mapInArrow(_cut(chunk, overlap), f"id {kind}, sha string, k long, n long, piece string")
        pieces = pieces.groupBy("id", "sha", "k", "n").agg(F.first("piece").alias("piece"))
        ends = pieces.mapInArrow(_encoded(path, chunk, overlap), f"id {kind}, sha string, cut long, places array<long>, before array<long>")
        found = checkpointed(_spliced(ends))
        counted = counted.unionByName(found.where("n_tokens IS NOT NULL"))
        if chunk >= longest or found.where("n_tokens IS NULL").isEmpty():
            break
        open_keys = found.where("n_tokens IS NULL").select(key.alias("key"))
        chunk, overlap = chunk * GROWTH, overlap * GROWTH
    joined = left.withColumn("key", key).join(counted.select(key.alias("key"), "n_tokens"), "key")
    many = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("id", "n_bytes", "n_tokens")
    return done.unionByName(many).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
