"""Delay buffers of live keyed sample streams: how much waits, and how much should, frame by frame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import ordered_fold

#: Milliseconds: least and largest wanted delay, its steps up and down, how long a steady stream takes to step down, slack, most held.
LEAST, MOST, UP, DOWN, STEADY, SLACK, HELD = 20.0, 60.0, 10.0, 2.0, 10_000.0, 30.0, 200.0
LEVELS = "phone string, seq long, arrive_ms double, fill_ms double, target_ms double, playing boolean, underruns long"


@dataclass
class Delay:
    """State of one phone's buffer; ``last`` is the time of the last frame, below 0 before the first."""

    fill: float = 0.0
    target: float = LEAST
    playing: bool = False
    last: float = -1.0
    steady: float = 0.0
    underruns: int = 0

    def frame(self, now: float, length: float) -> None:
        """A frame of ``length`` ms arrives: what was played since leaves first."""
        if self.playing:
            self.fill -= now - self.last
            if self.fill < 0:
                self.fill, self.playing, self.steady = 0.0, False, now
                self.target = min(MOST, self.target + UP)
                self.underruns += 1
        self.last = now
        self.fill = min(HELD, self.fill + length)
        if not self.playing and self.fill >= self.target:
            self.playing = True
        if self.playing and self.fill > self.target + SLACK:
            self.fill = self.target
        if self.playing and now - self.steady >= STEADY:
            self.target, self.steady = max(LEAST, self.target - DOWN), now


def _fold(pdf: pd.DataFrame, state: Delay) -> pd.DataFrame:
    pdf = pdf.sort_values(["arrive_ms", "seq"])
    rows = []
    for phone, seq, now, length in zip(pdf.phone, pdf.seq, pdf.arrive_ms, pdf.length_ms):
        state.frame(float(now), float(length))
        rows.append((phone, seq, now, state.fill, state.target, state.playing, state.underruns))
    return pd.DataFrame(rows, columns=["phone", "seq", "arrive_ms", "fill_ms", "target_ms", "playing", "underruns"])


def delays(frames: DataFrame) -> DataFrame:
    """The buffer after each frame (phone, seq, arrive_ms, length_ms), in batch."""
    return ordered_fold(frames, "phone", ["arrive_ms", "seq"], Delay, lambda pdf, state: (_fold(pdf, state), state), LEVELS)


def stream_delays(frames: DataFrame) -> DataFrame:
    """The same on a stream: each phone's state goes on from batch to batch."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Delay(*state.get) if state.exists else Delay()
        out = _fold(pd.concat(list(parts)), now)
        state.update(astuple(now))
        yield out

    schema = "fill double, target double, playing boolean, last double, steady double, underruns long"
    return frames.groupBy("phone").applyInPandasWithState(run, LEVELS, schema, "append", GroupStateTimeout.NoTimeout)
