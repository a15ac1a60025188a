"""Who is in a room: silence and expiry by event-time timers on a stream, with a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import ordered_fold

#: A connection without a word for so long is dropped; a dropped guest's row goes after so long.
SILENT_MS, GONE_MS = 5_000, 120_000
OUTPUT = "phone long, at_ms long, seq long, what string"

#: (status, since, removed): away, live (last heard), dropped (since then); removed guests stay out.
Seat = tuple[str, int, bool]
EMPTY: Seat = ("away", 0, False)


def deadline(seat: Seat, silent: int, gone: int) -> int | None:
    """When something happens by itself."""
    return seat[1] + {"live": silent, "dropped": gone}[seat[0]] if seat[0] != "away" else None


def expire(seat: Seat, upto: int | None, silent: int, gone: int) -> tuple[Seat, list[tuple[int, str]]]:
    """What happens by itself until ``upto`` (that moment included; None: for ever)."""
    out = []
    while (due := deadline(seat, silent, gone)) is not None and (upto is None or due <= upto):
        live = seat[0] == "live"
        out.append((due, "silent" if live else "gone"))
        seat = ("dropped" if live else "away", due, seat[2])
    return seat, out


def hear(seat: Seat, at: int, kind: str) -> tuple[Seat, str | None]:
    """One message: join, leave, kick, or any other, which keeps a live connection awake."""
    status, _, removed = seat
    if kind == "join":
        return (seat, "refused") if removed else (("live", at, False), "joined" if status == "away" else "back")
    if kind == "kick":
        return ("away", at, True), None if removed else "kicked"
    if status == "away":
        return seat, None
    if kind == "leave":
        return ("away", at, removed), "left"
    return (("live", at, removed) if status == "live" else seat), None


def _walk(seat: Seat, rows: Iterator[tuple[int, int, str]], silent: int, gone: int) -> tuple[Seat, list[tuple[int, int | None, str]]]:
    out = []
    for at, seq, kind in rows:
        seat, own = expire(seat, at, silent, gone)
        out += [(t, None, what) for t, what in own]
        seat, what = hear(seat, at, kind)
        if what:
            out.append((at, seq, what))
    return seat, out


def _frame(phone: int, rows: list[tuple[int, int | None, str]]) -> pd.DataFrame:
    return pd.DataFrame({"phone": [phone] * len(rows), "at_ms": [r[0] for r in rows], "seq": pd.array([r[1] for r in rows], "Int64"), "what": pd.Series([r[2] for r in rows], dtype=object)})


def presence(messages: DataFrame, silent: int = SILENT_MS, gone: int = GONE_MS, until: int | None = None) -> DataFrame:
    """What happens in the room (phone, at_ms, seq, what), from messages (phone, at_ms, seq, kind) in batch.

    what: joined, back, refused, left, kicked, and without a message (seq null) silent and gone. A
    deadline that falls on a message's time comes first. After a phone's last message time runs on to ``until``, or for ever. A
    phone's messages are read in order from sorted partitions, one state at a time.
    """

    def step(pdf: pd.DataFrame, seat: Seat) -> tuple[pd.DataFrame, Seat]:
        seat, out = _walk(seat, zip(pdf.at_ms.tolist(), pdf.seq.tolist(), pdf.kind.tolist()), silent, gone)
        return _frame(pdf.phone.iloc[0], out), seat

    def last(phone: int, seat: Seat) -> pd.DataFrame:
        return _frame(phone, [(t, None, what) for t, what in expire(seat, until, silent, gone)[1]])

    return ordered_fold(messages.select("phone", "at_ms", "seq", "kind"), "phone", ["at_ms", "seq"], lambda: EMPTY, step, OUTPUT, last)


class Room(StatefulProcessor):
    """Holds a phone's messages until the watermark has passed them, so that order within and across batches doesn't matter; timers do the rest."""

    def __init__(self, silent: int, gone: int) -> None:
        self.silent, self.gone = silent, gone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seat = handle.getValueState("seat", "status string, since long, removed boolean")
        self.waiting = handle.getListState("waiting", "at_ms long, seq long, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for pdf in rows:
            new = list(zip(pdf.at_ms.tolist(), pdf.seq.tolist(), pdf.kind.tolist()))
            self.waiting.appendList(new)
            times.update(t for t, _, _ in new)
        for t in times:
            self.handle.registerTimer(t)
        yield _frame(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed, at the first timer that tells of it; later ones find nothing left."""
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        seat = tuple(self.seat.get()) if self.seat.exists() else EMPTY
        seat, out = _walk(seat, iter(ready), self.silent, self.gone)
        seat, own = expire(seat, now, self.silent, self.gone)
        out += [(t, None, what) for t, what in own]
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if seat == EMPTY or seat[0] == "away" and not seat[2]:
            self.seat.clear()  # nothing is kept of guests that have gone
        else:
            self.seat.update(seat)
            if (due := deadline(seat, self.silent, self.gone)) is not None:
                self.handle.registerTimer(due)
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def stream_presence(messages: DataFrame, delay: str = "10 seconds", silent: int = SILENT_MS, gone: int = GONE_MS) -> DataFrame:
    """The same on a stream of (phone, at timestamp, at_ms, seq, kind): rows come out once the watermark (the latest time less ``delay``) has passed them.

    Messages that come later than that drop out. Needs the RocksDB state store. State is one seat for each phone that
    hasn't gone and the messages of the last ``delay``.
    """
    return messages.withWatermark("at", delay).groupBy("phone").transformWithStateInPandas(Room(silent, gone), OUTPUT, "Append", "EventTime")
