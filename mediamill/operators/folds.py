"""Folds over each key's rows in order, with a small state, in batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, key: str, order: list[str], fresh: Callable[[], Any], step: Callable[[pd.DataFrame, Any], tuple[pd.DataFrame | None, Any]], schema: str, last: Callable[[Any, Any], pd.DataFrame] | None = None) -> DataFrame:
    """``step(rows of one key in order, state)`` gives output (or none) and the next state; a key's rows come in runs.

    Spark deals rows by key and sorts each partition, spilling where it must; a task reads batches
    and holds only the state of the key it is at, so a key of any size is never in memory whole.
    ``last(key, state)``, if given, adds rows after a key's last run. Null keys are one key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for batch in batches:
            if not len(batch):
                continue
            own = batch[key]
            new = (own != own.shift()) & ~(own.isna() & own.shift().isna())
            new.iloc[0] = True
            for _, part in batch.groupby(new.cumsum(), sort=False):
                name = part[key].iloc[0]
                if not begun or not (name == now or (pd.isna(name) and pd.isna(now))):
                    if begun and last:
                        yield last(now, state)
                    now, state, begun = name, fresh(), True
                out, state = step(part, state)
                if out is not None:
                    yield out
        if begun and last:
            yield last(now, state)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
