"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import U, put, slices, with_fields
from .letters import is_letter, lower_codes

SIZES, BITS = (1, 2, 3), 15
#: Languages whose counts a task holds before it hands them on.
HELD = 64
#: Added to each count.
SMOOTHING = 0.5


def gram_features(texts: list[str], sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: buckets of all n-grams of the letters (other characters: one blank), and where each text's begin."""
    codes, begins = lower_codes(texts)
    letter = is_letter(codes)
    keep = letter | np.concatenate(([False], letter[:-1]))
    stream = np.where(letter, codes, np.uint32(32))
    keep[begins[1:] - 1] = True
    stream[begins[1:] - 1] = 10
    at = np.concatenate(([0], np.cumsum(keep)))[begins]
    stream = stream[keep].astype(U)
    h = np.zeros(len(stream), U)
    end = stream == 10  # of a text; no gram runs over it
    for n in range(1, max(sizes) + 1):
        m = len(stream) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ stream[n - 1 :]) * U(0x9FB21C651E98DF25)
        h ^= h >> U(29)
        if n in sizes:
            bucket = ((h * U(0xC2B2AE3D27D4EB4F)) >> U(64 - bits)).astype(np.int64)
            ok = ~np.logical_or.reduce([end[k : k + m] for k in range(n)])
            if n == 1:
                ok &= stream != 32
            total = np.concatenate(([0], np.cumsum(ok)))
            yield bucket[ok], total[np.minimum(at, m)]


@dataclass
class LanguageModel:
    """Log-probabilities of buckets (a row a language, by name) and of languages."""

    languages: list[str]
    log_probability: np.ndarray
    log_prior: np.ndarray
    bits: int = BITS

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior; ``und`` and 0 without a letter or a learned language. Ties: the first by name."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        scores = np.repeat(self.log_prior[:, None], len(texts), axis=1)
        letters = np.zeros(len(texts), np.int64)
        for buckets, at in gram_features(texts, bits=self.bits):
            some = np.diff(at) > 0
            if not letters.any():
                letters = np.diff(at)
            if some.any():
                for k, row in enumerate(self.log_probability):
                    scores[k, some] += np.add.reduceat(row[buckets], at[:-1][some])
        best = scores.argmax(axis=0)
        posterior = 1 / np.exp(scores - scores.max(axis=0)).sum(axis=0)
        return [self.languages[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist())], np.where(letters > 0, posterior, 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, row in held.items():
            where = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where - 1, pa.int32()), pa.array(row[where], pa.int64())], names=["lang", "bucket", "n"])
        held.clear()

    for whole in batches:
        for batch in slices(whole, "text"):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.searchsorted(names, langs)
            for name in names:
                held.setdefault(name, np.zeros((1 << BITS) + 1, np.int64))
            for name, n in zip(names, np.bincount(code, minlength=len(names))):
                held[name][0] += n
            for buckets, at in gram_features(texts):
                owner = np.repeat(code, np.diff(at))
                for k, name in enumerate(names):
                    held[name][1:] += np.bincount(buckets[owner == k], minlength=1 << BITS)
            if len(held) > HELD:
                yield from flush()
    yield from flush()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts over all rows with a language: tasks sum their own, Spark sums by (language, bucket), the driver takes logs."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums.lang.unique())
    table = np.zeros((len(languages), 1 << BITS))
    prior = np.zeros(len(languages))
    code = np.searchsorted(languages, sums.lang) if len(sums) else np.zeros(0, int)
    own, bucket, n = np.asarray(code), sums.bucket.to_numpy(), sums.n.to_numpy()
    prior[own[bucket < 0]] = n[bucket < 0]
    table[own[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    table += SMOOTHING
    return LanguageModel(languages, np.log(table / table.sum(axis=1, keepdims=True)), np.log(prior / prior.sum()) if len(prior) else prior)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from whole texts.

    Null, empty and letterless texts are ``und`` with score 0; repeated rows get equal results; an
    empty table gives an empty one; columns of ``docs`` named as an output give way.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                langs, scores = shared.value.score([t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()])
                yield put(batch, lang_pred=pa.array(langs, pa.string()), score=pa.array(scores, pa.float64()))

    return docs.mapInArrow(run, with_fields(docs.schema, ("lang_pred", T.StringType()), ("score", T.DoubleType())))
