from __future__ import annotations

import pandas as pd

from mediamill.operators import folds


def test_fold_equals_a_plain_loop_over_small_batches(spark):
    """Keys longer than a batch, a null key and ties; the state of a key goes on from batch to batch."""
    rows = [(k, (i * 7) % 50, i) for i in range(300) for k in [(None, 1, 1, 1, 2)[i % 5]]]
    df = spark.createDataFrame(rows, "k long, at long, id long")

    def step(pdf, total):
        out = []
        for i in pdf.id:
            total += int(i)
            out.append(total)
        return pd.DataFrame({"id": pdf.id, "total": out}), total

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        found = folds.ordered_fold(df, "k", ["at", "id"], lambda: 0, step, "id long, total long", lambda k, total: pd.DataFrame({"id": [-1], "total": [total]})).collect()
        none = folds.ordered_fold(df.limit(0), "k", ["at"], lambda: 0, step, "id long, total long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in (None, 1, 2):
        total = 0
        for _, _, i in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]):
            total += i
            want.append((i, total))
        want.append((-1, total))
    assert sorted(map(tuple, found)) == sorted(want) and none == []
