from __future__ import annotations

import pandas as pd

from mediamill.streaming import delays


def frames(seconds, stall_at=None, stall_ms=150.0):
    """Frames of 5 ms, of which those of a stall arrive together at its end."""
    rows = []
    for k in range(int(seconds * 200)):
        at = k * 5.0
        if stall_at is not None and stall_at * 1000 <= at < stall_at * 1000 + stall_ms:
            at = stall_at * 1000 + stall_ms
        rows.append(("a", k, at, 5.0))
    return pd.DataFrame(rows, columns=["phone", "seq", "arrive_ms", "length_ms"])


def test_steady_stream_stays_at_the_least_delay():
    out = delays._fold(frames(30), delays.Delay())
    assert (out.target_ms == 20).all() and out.underruns.max() == 0
    assert out.fill_ms.iloc[100:].between(12, 28).all()


def test_stall_raises_the_delay_and_it_comes_back():
    out = delays._fold(frames(70, 5), delays.Delay()).set_index("arrive_ms", drop=False)
    assert out[out.arrive_ms >= 6000].target_ms.iloc[0] == 30
    assert out[out.arrive_ms >= 6000].fill_ms.max() < 61
    assert out.target_ms.iloc[-1] == 20 and out.underruns.max() == 1


def test_stream_equals_batch(spark, tmp_path):
    pdf = pd.concat([frames(4, 1), frames(3).assign(phone="b", length_ms=4.9)])
    df = spark.createDataFrame(pdf)
    for low, high in ((0, 1500), (1500, 9000)):
        df.where(f"arrive_ms >= {low} and arrive_ms < {high}").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = delays.stream_delays(stream).writeStream.format("memory").queryName("delays").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda t: t.sort_values(["phone", "seq"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(key(spark.table("delays").toPandas()), key(delays.delays(df).toPandas()))
