"""Keyed streams: admissions with a lock-out, and level meters; each with a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import ordered_fold

#: Wrong codes that close the door, for how long; and how long a guest's place is kept.
WRONG, CLOSED_MS, KEPT_MS = 5, 10_000, 120_000
ADMISSION = "user_id long, event_id long, now_ms long, verdict string"


def admit(state: tuple[int, int, int], now: int, good: bool) -> tuple[tuple[int, int, int], str]:
    """One knock: state is (wrong codes in a row, closed until, last seen); known guests pass a closed door."""
    wrong, until, seen = state
    if good and seen >= 0 and now - seen <= KEPT_MS:
        return (0, until, now), "back"
    if now < until:
        return (wrong, until, seen), "closed"
    if good:
        return (0, until, now), "joined"
    wrong += 1
    return (0, now + CLOSED_MS, seen) if wrong >= WRONG else (wrong, until, seen), "wrong"


def _fold(pdf: pd.DataFrame, state: tuple[int, int, int]) -> tuple[pd.DataFrame, tuple[int, int, int]]:
    pdf = pdf.sort_values(["now_ms", "event_id"])
    verdicts = []
    for now, good in zip(pdf.now_ms, pdf.good_code):
        state, verdict = admit(state, int(now), bool(good))
        verdicts.append(verdict)
    return pdf[["user_id", "event_id", "now_ms"]].assign(verdict=verdicts), state


def admissions(joins: DataFrame) -> DataFrame:
    """The verdict on each knock (user_id, event_id, now_ms, good_code), in batch."""
    return ordered_fold(joins, "user_id", ["now_ms", "event_id"], lambda: (0, 0, -1), _fold, ADMISSION)


def stream_admissions(joins: DataFrame) -> DataFrame:
    """The same on a stream: the state of a user goes on from batch to batch."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, 0, -1)
        out, now = _fold(pd.concat(list(parts)), now)
        state.update(now)
        yield out

    return joins.groupBy("user_id").applyInPandasWithState(run, ADMISSION, "wrong long, until long, seen long", "append", GroupStateTimeout.NoTimeout)


def levels(samples: DataFrame, time: str, width: str = "80 milliseconds") -> DataFrame:
    """The peak of each phone by tumbling window; works on batches and on streams with a watermark."""
    return samples.groupBy("phone", F.window(time, width).alias("w")).agg(F.max(F.abs("value")).alias("peak")).select("phone", F.col("w.start").alias("at"), "peak")
