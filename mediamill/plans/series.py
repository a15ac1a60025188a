"""Queries over time-ordered rows: events play the clock and the phones, conversations the lyric lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as x
from ..operators import alignment, catalogue as c, timeline as tl
from .registry import Tables, query


def seconds(column: str = "ts") -> Column:
    """Whole seconds since 1970 of a zoneless timestamp."""
    return F.unix_seconds(F.col(column).cast("timestamp"))


def millis(column: str = "ts") -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


@query(
    """SELECT q.user_id, q.event_id, q.ts AS at_time, (SELECT max(struct_pack(t := e.ts, i := e.event_id, v := e.value)) FROM events e WHERE e.event_type = 'click' AND e.user_id = q.user_id AND e.ts <= q.ts).v AS clock
    FROM events q WHERE q.event_type = 'purchase'"""
)
def q_asof_clock(t: Tables) -> DataFrame:
    left = t.events.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("at_time"))
    right = t.events.where("event_type = 'click'").select("user_id", "ts", "event_id", F.col("value").alias("clock"))
    return tl.as_of(left, right, "user_id", "at_time", "ts", "clock", "event_id", F.to_date).select("user_id", "event_id", "at_time", "clock")


@query(
    """SELECT q.user_id, q.event_id, CASE WHEN l.l.t IS NULL THEN NULL WHEN l.l.k = 'error' THEN l.l.v ELSE round(l.l.v + ((epoch_us(q.ts) // 1000) - l.l.t) / 1000.0, 3) END AS position
    FROM events q, LATERAL (SELECT max(struct_pack(t := (epoch_us(e.ts) // 1000), i := e.event_id, v := e.value, k := e.event_type)) AS l FROM events e WHERE e.event_type IN ('click', 'error') AND e.user_id = q.user_id AND e.ts <= q.ts) l WHERE q.event_type = 'view'"""
)
def q_clock_extrapolate(t: Tables) -> DataFrame:
    left = t.events.where("event_type = 'view'").select("user_id", "event_id", millis().alias("at"))
    right = t.events.where("event_type in ('click', 'error')").select("user_id", millis().alias("t"), "event_id", F.struct("value", "event_type", millis().alias("t")).alias("seen"))
    found = tl.as_of(left, right, "user_id", "at", "t", "seen", "event_id")
    moving = F.round(F.col("seen.value") + (F.col("at") - F.col("seen.t")) / 1000.0, 3)
    return found.select("user_id", "event_id", F.when(F.col("seen").isNotNull(), F.when(F.col("seen.event_type") == "error", F.col("seen.value")).otherwise(moving)).alias("position"))


@query("SELECT c_custkey AS user_id, coalesce(p.peak, 0.0) AS peak FROM customer LEFT JOIN (SELECT user_id, max(abs(value)) AS peak FROM events GROUP BY 1) p ON p.user_id = c_custkey")
def q_levels_default(t: Tables) -> DataFrame:
    peaks = t.events.groupBy("user_id").agg(F.max(F.abs("value")).alias("peak"))
    return c.with_default(t.customer.select(F.col("c_custkey").alias("user_id")), peaks, "user_id", "peak", 0.0)


@query("SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS bin, max(abs(value)) AS peak, count(*) AS n FROM events GROUP BY 1, 2")
def q_peak_hold(t: Tables) -> DataFrame:
    return tl.tumbling(t.events, "user_id", seconds(), 3600, peak=F.max(F.abs("value")), n=F.count("*"))


@query("SELECT DISTINCT CAST(h AS BIGINT) AS hop FROM (SELECT unnest(range(CAST(event_id * 37 // 50 AS BIGINT), CAST(ceil((event_id * 37 + CAST(floor(value) AS BIGINT)) / 50.0) AS BIGINT))) AS h FROM events WHERE event_type = 'click' AND floor(value) > 0)")
def q_interval_mark(t: Tables) -> DataFrame:
    spans = t.events.where("event_type = 'click'").select((F.col("event_id") * 37).alias("s"), (F.col("event_id") * 37 + F.floor("value")).alias("e"))
    return tl.mark_intervals(spans, "s", "e", 50)


@query("SELECT event_type, list_sort(list(value))[CAST(round((count(*) - 1) * 0.95) AS INTEGER) + 1] AS p95 FROM events GROUP BY 1")
def q_nearest_rank_p95(t: Tables) -> DataFrame:
    # ranks by a count per value: only distinct values of a key come together, not its rows
    n = t.events.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("event_type")
    ranked = n.withColumn("upto", F.sum("n").over(by.orderBy("value"))).withColumn("all", F.sum("n").over(by))
    wanted = F.round((F.col("all") - 1) * F.lit(0.95)) + 1
    return ranked.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)).select("event_type", F.col("value").alias("p95"))


def _hours(t: Tables, kind: str) -> DataFrame:
    hour = F.floor((seconds() - F.lit(1704067200)) / 3600)
    counts = t.events.groupBy(hour.alias("hop")).agg(F.count_if(F.col("event_type") == kind).alias("k"))
    return counts.select("hop", (F.col("k") >= 3).alias("on"))


_PHI = """WITH h AS (SELECT CAST((epoch_us(ts) // 1000000 - 1704067200) // 3600 AS BIGINT) AS hop, count(*) FILTER (event_type = 'click') >= 3 AS a, count(*) FILTER (event_type = 'view') >= 3 AS b FROM events GROUP BY 1),
    j AS (SELECT CAST(g.lag AS INTEGER) AS lag, x.a, y.b FROM h x, (SELECT unnest(range(-12, 13)) AS lag) g, h y WHERE y.hop = x.hop + g.lag),
    s AS (SELECT lag, count(*) AS n, count(*) FILTER (a AND b) AS n11, count(*) FILTER (a) AS n1x, count(*) FILTER (b) AS nx1 FROM j GROUP BY 1),
    p AS (SELECT lag, round(CASE WHEN n < 100 OR n1x = 0 OR n1x = n OR nx1 = 0 OR nx1 = n THEN 0.0 ELSE CAST(n * n11 - n1x * nx1 AS DOUBLE) / sqrt(CAST(n1x * (n - n1x) * nx1 * (n - nx1) AS DOUBLE)) END, 6) AS phi FROM s)"""


@query(_PHI + " SELECT lag, phi FROM p")
def q_phi_by_lag(t: Tables) -> DataFrame:
    return alignment.phi_at_lags(_hours(t, "click"), _hours(t, "view"), -12, 12, 100)


@query(_PHI + " SELECT lag, phi FROM p ORDER BY phi DESC, lag DESC LIMIT 1")
def q_best_lag(t: Tables) -> DataFrame:
    return tl.best_lag(alignment.phi_at_lags(_hours(t, "click"), _hours(t, "view"), -12, 12, 100), -1.0)


@query(
    """SELECT user_id, CASE WHEN max(event_id) > min(event_id) THEN round((max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) / CAST(max(event_id) - min(event_id) AS DOUBLE), 6) END AS ms_per_event FROM events GROUP BY 1"""
)
def q_arrival_rate(t: Tables) -> DataFrame:
    e = t.events.withColumn("ms", millis())
    span = lambda f: f("ms", "event_id")
    rate = F.try_divide((span(F.max_by) - span(F.min_by)).cast("double"), F.max("event_id") - F.min("event_id"))
    return e.groupBy("user_id").agg(F.round(rate, 6).alias("ms_per_event"))


@query("SELECT conv_id, turn, turn * 4000 AS start_ms, coalesce(lead(turn * 4000) OVER (PARTITION BY conv_id ORDER BY turn), turn * 4000 + 5000) AS end_ms FROM (SELECT conv_id, turn FROM conversations GROUP BY 1, 2)")
def q_line_end_lead(t: Tables) -> DataFrame:
    lines = t.conversations.select("conv_id", "turn", (F.col("turn") * 4000).alias("start_ms")).distinct()
    return tl.line_ends(lines, "conv_id", "start_ms", "turn", F.col("start_ms") + 5000).withColumnRenamed("end", "end_ms")


@query("SELECT user_id, gap_start, gap_end FROM (SELECT user_id, coalesce(lag(s + 60) OVER (PARTITION BY user_id ORDER BY s, event_id), 0) AS gap_start, s AS gap_end FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 - 1704067200 AS s FROM events)) WHERE gap_end - gap_start > 40000")
def q_gap_rows(t: Tables) -> DataFrame:
    s = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000) - 1704067200
    spans = t.events.select("user_id", "event_id", s.alias("s"), (s + 60).alias("e"))
    return tl.gaps(spans, "user_id", "s", "e", "event_id", 40000)


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS voice FROM events")
def q_voice_ffill(t: Tables) -> DataFrame:
    e = t.events.withColumn("mark", F.when(F.col("event_type") == "signup", F.col("value")))
    return tl.carry_forward(e, "user_id", ["ts", "event_id"], "mark", "voice").select("user_id", "event_id", "voice")


@query(
    """WITH h AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value > 60 AS on_ FROM events),
    n AS (SELECT *, max(CASE WHEN on_ THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p, min(CASE WHEN on_ THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM h)
    SELECT user_id, i, on_ OR coalesce(q - p <= 3, false) AS sung FROM n"""
)
def q_breath_fill(t: Tables) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    hops = t.events.select("user_id", i.alias("i"), (F.col("value") > 60).alias("sung"))
    return tl.fill_breaths(hops, "user_id", "i", "sung", 2)


@query("SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top FROM events) WHERE value = top")
def q_local_peaks(t: Tables) -> DataFrame:
    return tl.local_peaks(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value", 5)


@query(
    """WITH e AS (SELECT user_id, event_id, CAST((epoch_us(ts) // 1000) // 1000 AS BIGINT) AS s FROM events), f AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) <= 7200 THEN 0 ELSE 1 END AS fresh FROM e),
    g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f) SELECT user_id, session, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events FROM g GROUP BY 1, 2"""
)
def q_sessions(t: Tables) -> DataFrame:
    return tl.sessions(t.events, "user_id", F.floor(millis() / 1000), "event_id", 7200).withColumn("session", F.col("session").cast("long"))


@query("SELECT user_id, event_id FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS errors FROM events) WHERE errors >= 3 AND event_type = 'error'")
def q_lockout(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, 0)
    e = t.events.withColumn("errors", F.sum((F.col("event_type") == "error").cast("int")).over(w))
    return e.where("errors >= 3 and event_type = 'error'").select("user_id", "event_id")


@query("SELECT user_id, CAST((epoch_us(ts) // 1000) // 600000 AS BIGINT) AS bin, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def q_debounce(t: Tables) -> DataFrame:
    return tl.tumbling(t.events, "user_id", F.floor(millis() / 1000), 600, value=F.max_by("value", "event_id"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS draft, max(event_id) AS seq FROM events GROUP BY 1, 2")
def q_latest_draft(t: Tables) -> DataFrame:
    latest = c.latest_per_key(t.events.select(F.struct("user_id", "event_type").alias("k"), "event_id", F.col("value").alias("draft")), "k", "event_id")
    return latest.select("k.user_id", "k.event_type", "draft", F.col("event_id").alias("seq"))


@query("SELECT a.user_id, a.event_id, a.value FROM events a JOIN (SELECT user_id, max(event_id) AS last_click FROM events WHERE event_type = 'click' GROUP BY 1) q ON q.user_id = a.user_id WHERE a.event_type = 'view' AND a.event_id > q.last_click")
def q_stale_suppress(t: Tables) -> DataFrame:
    asked = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.max("event_id").alias("last_click"))
    return t.events.where("event_type = 'view'").join(asked, "user_id").where("event_id > last_click").select("user_id", "event_id", "value")


@query("SELECT user_id, event_id, value > 50 AND (p IS NULL OR p <= 50) AS changed FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)")
def q_publish_changes(t: Tables) -> DataFrame:
    p = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.withColumn("p", p).select("user_id", "event_id", ((F.col("value") > 50) & (F.col("p").isNull() | (F.col("p") <= 50))).alias("changed"))


@query("SELECT user_id, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'added' WHEN 'error' THEN 'failed' ELSE 'pending' END AS state, max(event_id) AS event_id FROM events GROUP BY 1")
def q_pending_done(t: Tables) -> DataFrame:
    last = c.latest_per_key(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id")
    return last.select("user_id", F.when(F.col("event_type") == "purchase", "added").when(F.col("event_type") == "error", "failed").otherwise("pending").alias("state"), "event_id")


@query("SELECT event_id, ms % 1000 AS part, CAST(ms // 60000 % 60 AS VARCHAR) || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events)")
def q_clock_format(t: Tables) -> DataFrame:
    ms = millis()
    return t.events.select("event_id", (ms % 1000).alias("part"), x.clock_text(ms % 3600000).alias("clock"))


@query("SELECT event_id, (CAST(event_id % 60 AS BIGINT) * 60 + event_id % 59) * 1000 AS clock_ms, (event_id % 60) * 60000 + (event_id % 59) * 1000 + (event_id % 100) * 10 AS stamp_ms FROM events")
def q_clock_parse(t: Tables) -> DataFrame:
    pad = lambda c_, n: F.lpad(c_.cast("string"), n, "0")
    m, s, h = F.col("event_id") % 60, F.col("event_id") % 59, F.col("event_id") % 100
    return t.events.select("event_id", x.clock_ms(F.concat(m.cast("string"), F.lit(":"), pad(s, 2))).alias("clock_ms"), x.stamp_ms(F.concat(m.cast("string"), F.lit(":"), pad(s, 2), F.lit("."), pad(h, 2))).alias("stamp_ms"))


@query("SELECT event_id, event_type = 'error' AND (epoch_us(TIMESTAMP '2024-01-20') // 1000) - (epoch_us(ts) // 1000) > 604800000 AS due FROM events")
def q_retry_due(t: Tables) -> DataFrame:
    now = 1705708800000
    return t.events.select("event_id", ((F.col("event_type") == "error") & (F.lit(now) - millis() > 7 * 86400000)).alias("due"))


@query("SELECT user_id, event_id FROM (SELECT *, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS wall FROM events) WHERE wall - 36000000 > 10000")
def q_sleep_gap(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("wall", millis() - F.lag(millis()).over(w)).where("wall - 36000000 > 10000").select("user_id", "event_id")


@query(
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN 0.0 WHEN event_id % 3 = 0 THEN value ELSE 1.5 END AS lyric_offset, event_type <> 'signup' AND event_id % 3 = 0 AS manual FROM events"""
)
def q_offset_rules(t: Tables) -> DataFrame:
    reset, manual = F.col("event_type") == "signup", F.col("event_id") % 3 == 0
    own = t.events.select("event_id", "event_type", F.lit(1.5).alias("lyric_offset"), F.lit(False).alias("manual"), "value")
    own = c.guarded_update(own, manual, lyric_offset=F.col("value"), manual=F.lit(True))
    return c.guarded_update(own, reset, lyric_offset=F.lit(0.0), manual=F.lit(False)).select("event_id", "lyric_offset", "manual")


@query("SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_id FROM events")
def q_next_in_queue(t: Tables) -> DataFrame:
    return tl.with_next(t.events.select("event_id", "user_id"), "user_id", "event_id", "event_id", "next_id")
