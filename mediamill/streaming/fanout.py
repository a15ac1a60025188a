"""Events to those who show the song: a join of two streams, views that go out only when they change, and a sink that may be asked twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def for_queued(events: DataFrame, queue: DataFrame, delay: str = "10 seconds", shown: str = "1 hour") -> DataFrame:
    """Each event (track_id, at, event) with every queue row (track_id, queued_at, entry) of its song that was queued at most ``shown`` before it.

    The same on batches and on two streams; there each side waits ``delay`` for late rows, and what can no longer meet leaves the state.
    """
    left = events.withWatermark("at", delay).alias("e")
    right = queue.withWatermark("queued_at", delay).alias("q")
    near = (F.col("e.at") >= F.col("q.queued_at")) & (F.col("e.at") <= F.col("q.queued_at") + F.expr(f"interval {shown}"))
    return left.join(right, (F.col("e.track_id") == F.col("q.track_id")) & near).select("e.track_id", "e.at", "e.event", "q.entry", "q.queued_at")


def _differing(pdf: pd.DataFrame, last: str | None) -> tuple[pd.DataFrame, str | None]:
    pdf = pdf.sort_values(["at_ms", "seq"])
    before = pdf["view"].shift()
    before.iloc[0] = last
    return pdf[pdf["view"] != before], pdf["view"].iloc[-1]


VIEW = "guest long, at_ms long, seq long, view string"


def on_change(views: DataFrame) -> DataFrame:
    """Of a stream's rows (guest, at_ms, seq, view) those whose view isn't the one that the guest had before; views aren't null. State is one view a guest."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, last = _differing(pd.concat(list(parts))[["guest", "at_ms", "seq", "view"]], state.get[0] if state.exists else None)
        state.update((last,))
        yield out

    return views.groupBy("guest").applyInPandasWithState(run, VIEW, "view string", "append", GroupStateTimeout.NoTimeout)


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink of Parquet in which each batch has a folder by its number: a batch that is written again, after a restart, takes its own place and nothing is told twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put
