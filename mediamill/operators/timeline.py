"""Time-ordered rows: as-of lookups, gaps, sessions, carried values, series by bins. Windows see one key at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, tie: str, span: Callable[[Column], Column] | None = None) -> DataFrame:
    """Left rows with the value of the last right row of the key at or before their time (null if none).

    Both sides are united and the latest (time, tie, value) so far is carried on by one window, so
    the key is shuffled once and no pairs arise. With ``span`` (a rising function of time, such as its day) a key's rows are
    dealt out by spans: the latest of each span is found first and handed on to the later ones, so that windows see one key and span only.
    """
    seen = F.struct(F.col(right_time).alias("t"), F.col(tie).alias("i"), F.col(value).alias("v"))
    r = right.select(F.col(key), F.col(right_time).alias("_t"), seen.alias("_seen"), F.lit(0).alias("_side"))
    row = left.select(F.col(key), F.col(left_time).alias("_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.lit(1).alias("_side"))
    both = row.unionByName(r, allowMissingColumns=True)
    by = [key]
    if span is not None:
        both, by = both.withColumn("_span", span(F.col("_t"))), [key, "_span"]
        earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        ends = both.groupBy(*by).agg(F.max("_seen").alias("_own")).select(*by, F.max("_own").over(earlier).alias("_seen"))
        handed = ends.where("_seen is not null").select(*by, F.col("_seen.t").alias("_t"), "_seen", F.lit(0).alias("_side"))
        both = both.unionByName(handed, allowMissingColumns=True)
    at = Window.partitionBy(*by).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_last", F.max("_seen").over(at)).where("_side = 1").select("_row.*", F.col("_last.v").alias(value))


def line_ends(lines: DataFrame, key: str, start: str, order: str, last_end: Column) -> DataFrame:
    """Each line's end: the next line's start, for the last ``last_end``."""
    w = Window.partitionBy(key).orderBy(start, order)
    return lines.withColumn("end", F.coalesce(F.lead(start).over(w), last_end))


def gaps(spans: DataFrame, key: str, start: str, end: str, order: str, least: float) -> DataFrame:
    """Gap rows before spans that begin more than ``least`` after the previous end (0 before the first)."""
    w = Window.partitionBy(key).orderBy(start, order)
    before = F.lag(end, 1).over(w)
    return spans.withColumn("gap_start", F.coalesce(before, F.lit(0))).where(F.col(start) - F.col("gap_start") > least).select(key, "gap_start", F.col(start).alias("gap_end"))


def carry_forward(df: DataFrame, key: str, order: list[str], column: str, into: str) -> DataFrame:
    """The last value that isn't null so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(into, F.last(column, ignorenulls=True).over(w))


def fill_breaths(hops: DataFrame, key: str, index: str, on: str, most: int) -> DataFrame:
    """Silent hops between sung ones no further apart than ``most`` silent hops count as sung."""
    sung = F.when(F.col(on), F.col(index))
    back = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(key).orderBy(index).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    near = F.min(sung).over(ahead) - F.max(sung).over(back) <= most + 1
    return hops.withColumn(on, F.col(on) | F.coalesce(near, F.lit(False)))


def local_peaks(scores: DataFrame, key: str, index: str, score: str, reach: int) -> DataFrame:
    """Rows whose score is the largest within ``reach`` rows on both sides."""
    w = Window.partitionBy(key).orderBy(index).rowsBetween(-reach, reach)
    return scores.withColumn("_top", F.max(score).over(w)).where(F.col(score) == F.col("_top")).drop("_top")


def sessions(events: DataFrame, key: str, seconds: Column, order: str, timeout: float) -> DataFrame:
    """Runs of a key's events with pauses of at most ``timeout`` seconds: number, start, end, events."""
    w = Window.partitionBy(key).orderBy("_s", order)
    timed = events.withColumn("_s", seconds)
    fresh = F.when(F.col("_s") - F.lag("_s").over(w) <= timeout, 0).otherwise(1)
    numbered = timed.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "session").agg(F.min("_s").alias("start_s"), F.max("_s").alias("end_s"), F.count("*").alias("n_events"))


def tumbling(events: DataFrame, key: str, seconds: Column, width: int, **aggregates: Column) -> DataFrame:
    """Aggregates by key and bin of ``width`` seconds."""
    return events.groupBy(key, F.floor(seconds / width).alias("bin")).agg(*[a.alias(n) for n, a in aggregates.items()])


def mark_intervals(spans: DataFrame, start: str, end: str, step: int) -> DataFrame:
    """All hops [start, end) covers, by counting up rather than a range join; each hop once."""
    hops = F.sequence(F.floor(F.col(start) / step), F.ceil(F.col(end) / step) - 1)
    return spans.where(F.col(end) > F.col(start)).select(F.explode(hops).alias("hop")).distinct()


def phi(n11: Column, n1x: Column, nx1: Column, n: Column) -> Column:
    """Correlation of two yes/no series from counts; 0 where one is constant."""
    spread = F.sqrt((n1x * (n - n1x) * nx1 * (n - nx1)).cast("double"))
    return F.coalesce(F.try_divide((n * n11 - n1x * nx1).cast("double"), spread), F.lit(0.0))


def best_lag(scores: DataFrame, least: float) -> DataFrame:
    """The lag of the largest score, of equal ones the last, if it reaches ``least``."""
    return scores.agg(F.max_by("lag", F.struct("phi", "lag")).alias("lag"), F.max("phi").alias("phi")).where(F.col("phi") >= least)


def with_next(rows: DataFrame, key: str, order: str, column: str, name: str) -> DataFrame:
    """Each row with the value of the next one of its key."""
    return rows.withColumn(name, F.lead(column).over(Window.partitionBy(key).orderBy(order)))


def arrival_rate(reports: DataFrame, key: str, time: str, done: str, order: str) -> DataFrame:
    """(key, rate): time per unit of progress from a key's reports; null before any progress.

    It counts from the first report, or from the last one whose progress lay below all it had counted from: a run that starts over is timed anew.
    """
    by = Window.partitionBy(key).orderBy(time, order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # a report below every one before it begins anew; later ones are above it
    fresh = F.coalesce(F.col(done) < F.min(done).over(before), F.lit(True))
    marked = reports.withColumn("_start", F.when(fresh, F.struct(F.col(time).alias("t"), F.col(done).alias("n"))))
    last = F.struct(F.col(time).alias("t"), F.col(order).alias("o"), F.col(done).alias("n"))
    ends = marked.groupBy(key).agg(F.max_by("_start", F.when(F.col("_start").isNotNull(), F.struct(time, order))).alias("a"), F.max(last).alias("b"))
    return ends.select(key, F.when(F.col("b.n") > F.col("a.n"), (F.col("b.t") - F.col("a.t")) / (F.col("b.n") - F.col("a.n"))).alias("rate"))
