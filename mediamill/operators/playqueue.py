"""The play queue: a fold over each session's ordered commands."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .folds import ordered_fold


@dataclass
class Queue:
    """Entries (key, track), the place of the current one, and whether it has ended."""

    entries: list[tuple[int, int]] = field(default_factory=list)
    current: int = 0
    ended: bool = True
    next_key: int = 0

    @property
    def upcoming_from(self) -> int:
        return len(self.entries) if self.ended else self.current + 1

    def apply(self, op: str, track: int | None = None, key: int | None = None, to: int | None = None, delta: int | None = None) -> None:
        if op in ("add", "next"):
            at = len(self.entries) if self.ended or op == "add" else self.current + 1
            self.entries.insert(at, (self.next_key, track))
            self.next_key += 1
            if self.ended:
                self.current, self.ended = at, False
        elif op == "skip" and self.entries:
            base = self.current if not self.ended else len(self.entries)
            if 0 <= base + delta < len(self.entries):
                self.current, self.ended = base + delta, False
        elif op == "finish" and not self.ended:
            self.ended = self.current + 1 >= len(self.entries)
            self.current += not self.ended
        elif op in ("move", "remove"):
            at = next((i for i, (k, _) in enumerate(self.entries) if k == key and i >= self.upcoming_from), None)
            if at is not None:
                entry = self.entries.pop(at)
                if op == "move":
                    self.entries.insert(min(max(to, self.upcoming_from), len(self.entries)), entry)
        elif op == "remove_track":
            before = sum(t == track for _, t in self.entries[: self.current])
            gone = not self.ended and self.entries[self.current][1] == track
            left = [e for e in self.entries if e[1] != track]
            self.current -= before
            self.entries = left
            if gone or self.ended:
                self.ended = self.ended or self.current >= len(left)
                self.current = min(self.current, max(0, len(left) - 1))


def fold(commands: DataFrame) -> DataFrame:
    """The last state of each session: session, tracks, current (null when ended), length.

    ``commands``: session, seq, op, track, key, to, delta. A task holds the queue of one session, not its commands.
    """

    def step(pdf: pd.DataFrame, q: Queue) -> tuple[None, Queue]:
        for row in pdf.itertuples():
            value = lambda x: None if pd.isna(x) else int(x)
            q.apply(row.op, value(row.track), value(row.key), value(row.to), value(row.delta))
        return None, q

    def last(session: int, q: Queue) -> pd.DataFrame:
        now = None if q.ended else q.entries[q.current][1]
        return pd.DataFrame({"session": [session], "tracks": [",".join(str(t) for _, t in q.entries)], "current": pd.Series([now], dtype="Int64"), "length": [len(q.entries)]})

    return ordered_fold(commands, "session", ["seq"], Queue, step, "session long, tracks string, current long, length long", last)
