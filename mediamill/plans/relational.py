"""Catalogue queries: part plays the track, orders the collection, lineitem the membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import catalogue as c
from .registry import Tables, query


def tracks(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"))


def members(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("collection_id"), F.col("l_partkey").alias("track_id"), F.col("l_linenumber").cast("long").alias("position"))


def collections(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("kind"), "o_orderstatus")


@query(
    """SELECT o.o_orderkey AS id, o.o_orderpriority || ' ' || o.o_orderkey AS name, count(*) AS n_tracks,
    array_to_string(list_slice(list(p.p_name ORDER BY l.l_linenumber, l.l_partkey, p.p_name), 1, 4), '|') AS covers
    FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2"""
)
def q_cards(t: Tables) -> DataFrame:
    return c.cards(collections(t), members(t), tracks(t)).withColumn("covers", F.array_join("covers", "|"))


@query("SELECT l_orderkey AS collection_id, CAST(l_linenumber AS BIGINT) AS position, l_partkey AS track_id, p_name AS title, p_brand AS artist FROM lineitem JOIN part ON p_partkey = l_partkey")
def q_collection_tracks(t: Tables) -> DataFrame:
    return c.collection_tracks(members(t), tracks(t)).select("collection_id", "position", "track_id", "title", "artist")


@query("SELECT o_orderkey AS id, o_orderpriority || ' ' || o_orderkey AS name FROM orders WHERE o_orderpriority = '5-LOW'")
def q_optional_filter(t: Tables) -> DataFrame:
    every = c.optional_filter(collections(t), "kind", None)
    return c.optional_filter(every, "kind", "5-LOW").select("id", "name")


@query("SELECT l_orderkey AS collection_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def q_leave_kind(t: Tables) -> DataFrame:
    return c.without_members_of(members(t), collections(t), F.col("kind") == "1-URGENT").groupBy("collection_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) OR o_orderpriority <> '5-LOW'")
def q_prune_empty(t: Tables) -> DataFrame:
    empty = c.unused(collections(t), members(t), "id", "collection_id").where("kind = '5-LOW'")
    return collections(t).join(empty.select("id"), "id", "left_anti").select("id")


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def q_orphans(t: Tables) -> DataFrame:
    return c.unused(tracks(t), t.lineitem.where("l_quantity > 49"), "id", "l_partkey").select("id", "title")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q_used_sources(t: Tables) -> DataFrame:
    return c.used(t.customer, t.orders.where("o_orderstatus = 'P'"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT l_orderkey AS collection_id, l_partkey AS track_id, position FROM (SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS position, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def q_first_selected(t: Tables) -> DataFrame:
    return c.first_per_key(members(t), "collection_id", F.col("position"), F.col("track_id"))


@query("SELECT count(*) AS n_left, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def q_cascade(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return c.without_keys(t.lineitem, gone).agg(F.count("*").alias("n_left"), F.sum("l_quantity").cast("long").alias("quantity"))


@query(
    """SELECT c_custkey, coalesce(o.n, 0) AS n_orders, CASE WHEN o.n IS NULL THEN 'not started' WHEN o.open = 0 THEN 'ready' ELSE 'running' END AS state
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey"""
)
def q_folder_state(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") != "F").alias("open"))
    joined = c.with_default(t.customer.select("c_custkey"), o, "c_custkey", "n_orders", 0).join(o.select("c_custkey", "open"), "c_custkey", "left")
    return joined.select("c_custkey", "n_orders", F.when(F.col("open").isNull(), "not started").when(F.col("open") == 0, "ready").otherwise("running").alias("state"))


@query("SELECT l_orderkey AS collection_id, CAST(max(l_linenumber) + 1 AS BIGINT) AS next_position, CAST(min(l_linenumber) - 1 AS BIGINT) AS front_position FROM lineitem GROUP BY 1")
def q_next_positions(t: Tables) -> DataFrame:
    return c.next_positions(members(t))


@query("SELECT coalesce(max(o_orderkey), -1) + 1 AS next_id, CAST(count(*) AS BIGINT) AS n FROM orders")
def q_next_id(t: Tables) -> DataFrame:
    return t.orders.agg((F.coalesce(F.max("o_orderkey"), F.lit(-1)) + 1).alias("next_id"), F.count("*").alias("n"))


@query("SELECT p_brand AS artist, CAST(round(sum(CAST(coalesce(p_retailprice, 0) * 100 AS BIGINT)) / 60000.0) AS BIGINT) AS minutes FROM part GROUP BY 1")
def q_total_minutes(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("artist")).agg(F.round(F.sum(F.round(F.coalesce("p_retailprice", F.lit(0.0)) * 100).cast("long")) / 60000.0).cast("long").alias("minutes"))


@query("SELECT p_name AS title, p_partkey AS id, p_brand AS artist FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def q_first_occurrence(t: Tables) -> DataFrame:
    return c.distinct_by_first(tracks(t).select("title", "id", "artist"), F.lower("title"), "id")


_OFFER = "SELECT s_suppkey * 20 AS c_custkey, s_name AS c_name, s_acctbal AS c_acctbal FROM supplier"


@query(
    f"""SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(o.c_acctbal, n.c_acctbal) AS c_acctbal
    FROM customer o FULL OUTER JOIN ({_OFFER}) n ON n.c_custkey = o.c_custkey"""
)
def q_upsert(t: Tables) -> DataFrame:
    new = t.supplier.select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return c.upsert(t.customer.select("c_custkey", "c_name", "c_acctbal"), new, ["c_custkey"], keep=["c_acctbal"])


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def q_replace_latest(t: Tables) -> DataFrame:
    return c.latest_per_key(t.events.select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query(
    """SELECT c_custkey AS id, c_name AS name FROM customer
    UNION ALL SELECT s_suppkey * 20, s_name FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)"""
)
def q_insert_ignore(t: Tables) -> DataFrame:
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.insert_ignore(old, t.supplier.select((F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("name")), ["id"])


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'renamed ' || c_name ELSE c_name END AS c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def q_guarded_update(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return c.guarded_update(df, F.col("c_mktsegment") == "BUILDING", c_name=F.concat(F.lit("renamed "), "c_name"), c_acctbal=F.lit(0.0)).drop("c_mktsegment")


_HOLES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS balance FROM customer"


@query(f"SELECT h.id, coalesce(h.name, s.s_name) AS name, coalesce(h.balance, s.s_acctbal) AS balance FROM ({_HOLES}) h LEFT JOIN supplier s ON s.s_suppkey = h.id")
def q_fill_missing(t: Tables) -> DataFrame:
    own = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("balance"))
    return c.fill_missing(own, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), "id", ["name", "balance"])


_UNIQUE = "SELECT l_orderkey, l_partkey, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2"


@query(
    f"""WITH m AS ({_UNIQUE}), mv AS (SELECT l_orderkey, max(l_partkey) AS moved FROM m GROUP BY 1),
    r AS (SELECT m.*, moved, l_partkey = moved AS is_moved, sum(CASE WHEN l_partkey = moved THEN 0 ELSE 1 END) OVER (PARTITION BY m.l_orderkey ORDER BY p, l_partkey ROWS UNBOUNDED PRECEDING) - 1 AS rest FROM m JOIN mv USING (l_orderkey))
    SELECT l_orderkey AS collection_id, l_partkey AS track_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN is_moved THEN 2.0 WHEN rest >= 1 THEN rest * 2 + 1 ELSE rest * 2 - 1 END, l_partkey) - 1 AS position FROM r"""
)
def q_move_in_list(t: Tables) -> DataFrame:
    m = members(t).groupBy("collection_id", "track_id").agg(F.min("position").alias("position"))
    moves = m.groupBy("collection_id").agg(F.max("track_id").alias("track_id")).withColumn("to", F.lit(1).cast("long"))
    return c.move_in_list(m, moves).withColumn("position", F.col("position").cast("long"))


@query("SELECT l_orderkey AS collection_id, l_partkey AS track_id FROM lineitem WHERE NOT (l_orderkey, l_partkey) IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def q_delete_keys(t: Tables) -> DataFrame:
    gone = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("collection_id"), F.col("l_partkey").alias("track_id"))
    return c.without_keys(members(t), gone).select("collection_id", "track_id")


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS title, least(greatest(p_size - 20, -6), 6) AS key_semitones FROM part")
def q_setters(t: Tables) -> DataFrame:
    own = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_size", F.greatest(F.least(F.col("p_size") - 20, F.lit(6)), F.lit(-6)).alias("key_semitones"))
    return c.guarded_update(own, F.col("p_size") > 25, title=F.upper("title")).drop("p_size")


@query(
    """SELECT 'lineitem.part' AS fk, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + 10 WHERE p_partkey IS NULL
    UNION ALL SELECT 'lineitem.order', count(*) FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL
    UNION ALL SELECT 'orders.customer', count(*) FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_custkey IS NULL
    UNION ALL SELECT 'nation.region', count(*) FROM nation LEFT JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey IS NULL"""
)
def q_fk_check(t: Tables) -> DataFrame:
    checks = [
        ("lineitem.part", t.lineitem.withColumn("l_partkey", F.col("l_partkey") + 10), "l_partkey", t.part, "p_partkey"),
        ("lineitem.order", t.lineitem, "l_orderkey", t.orders, "o_orderkey"),
        ("orders.customer", t.orders, "o_custkey", t.customer, "c_custkey"),
        ("nation.region", t.nation, "n_regionkey", t.region, "r_regionkey"),
    ]
    out = None
    for name, child, fk, parent, pk in checks:
        n = c.dangling(child, fk, parent, pk).agg(F.lit(name).alias("fk"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderstatus IN ('F', 'O') AS known, o_totalprice BETWEEN 1000 AND 400000 AS in_range FROM orders")
def q_domain_check(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderstatus").isin("F", "O").alias("known"), F.col("o_totalprice").between(1000, 400000).alias("in_range"))


@query("SELECT n_name AS name, 'nation' AS kind, 1 AS ord FROM nation UNION ALL SELECT r_name, 'region', 2 FROM region UNION ALL SELECT DISTINCT p_brand, 'brand', 3 FROM part")
def q_union_rank(t: Tables) -> DataFrame:
    parts = [(t.nation.select(F.col("n_name").alias("name")), "nation"), (t.region.select(F.col("r_name").alias("name")), "region"), (t.part.select(F.col("p_brand").alias("name")).distinct(), "brand")]
    out = None
    for k, (df, kind) in enumerate(parts, 1):
        own = df.withColumns({"kind": F.lit(kind), "ord": F.lit(k)})
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT DISTINCT p_brand AS brand, p_name AS name FROM part WHERE p_size > 25 EXCEPT SELECT p_brand, p_name FROM part WHERE p_size <= 25")
def q_minus(t: Tables) -> DataFrame:
    names = lambda large: t.part.where((F.col("p_size") > 25) == large).select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    return names(True).subtract(names(False))


@query(
    """SELECT a.p_brand AS brand, len(list_filter(a.names, lambda x: NOT list_contains(b.names, x))) = 0 AS covered FROM
    (SELECT p_brand, list(DISTINCT p_type) AS names FROM part WHERE p_size > 40 GROUP BY 1) a JOIN (SELECT p_brand, list(DISTINCT p_type) AS names FROM part WHERE p_size <= 40 GROUP BY 1) b USING (p_brand)"""
)
def q_contains(t: Tables) -> DataFrame:
    sets = lambda cond, name: t.part.where(cond).groupBy(F.col("p_brand").alias("brand")).agg(F.collect_set("p_type").alias(name))
    return sets("p_size > 40", "a").join(sets("p_size <= 40", "b"), "brand").select("brand", (F.size(F.array_except("a", "b")) == 0).alias("covered"))


@query(
    """SELECT brand, name, CASE WHEN NOT in_b THEN 'missing' WHEN NOT in_a THEN 'extra' ELSE 'both' END AS report FROM
    (SELECT p_brand AS brand, p_name AS name, bool_or(p_size > 25) AS in_a, bool_or(p_size <= 25) AS in_b FROM part GROUP BY 1, 2)"""
)
def q_key_sets(t: Tables) -> DataFrame:
    side = lambda large, flag: t.part.where((F.col("p_size") > 25) == large).select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).distinct().withColumn(flag, F.lit(True))
    both = side(True, "a").join(side(False, "b"), ["brand", "name"], "full_outer")
    return both.select("brand", "name", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("both").alias("report"))


@query("SELECT p_partkey AS id, lower(p_name) AS sort_title, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS place FROM part")
def q_title_sort(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("artist").orderBy(F.lower("title"), "id"))
    return tracks(t).select("id", F.lower("title").alias("sort_title"), place.cast("long").alias("place"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type IN ('click', 'view')")
def q_newest_first(t: Tables) -> DataFrame:
    newest = t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return newest.where(F.col("event_type").isin("click", "view")).select("user_id", "event_id", "event_type").orderBy("user_id", F.desc("event_id"))


@query(
    """WITH e AS (SELECT c_custkey AS id, c_nationkey AS scope, CAST(c_acctbal * 100 AS BIGINT) + 100000 AS size, c_custkey % 7 AS last_used, c_mktsegment = 'BUILDING' AS ready FROM customer WHERE c_mktsegment <> 'MACHINERY'),
    r AS (SELECT *, sum(size) OVER (PARTITION BY scope) - coalesce(sum(size) OVER (PARTITION BY scope ORDER BY ready, last_used, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM e)
    SELECT id, CAST(scope AS INTEGER) AS scope, size FROM r WHERE rest > 3000000"""
)
def q_evict_lru(t: Tables) -> DataFrame:
    entries = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("scope"), (F.round(F.col("c_acctbal") * 100).cast("long") + 100000).alias("size"), (F.col("c_custkey") % 7).alias("last_used"), (F.col("c_mktsegment") == "BUILDING").alias("ready"), (F.col("c_mktsegment") == "MACHINERY").alias("protected")
    )
    return c.evict(entries, F.lit(3000000), "scope").select("id", "scope", "size")


@query("SELECT k, CAST(sum(CASE WHEN i = r THEN 1 ELSE 0 END) AS BIGINT) AS contiguous FROM (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS r FROM (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber - 1 AS BIGINT) AS i FROM lineitem WHERE l_quantity > 10)) GROUP BY k")
def q_contiguous_prefix(t: Tables) -> DataFrame:
    chunks = t.lineitem.where("l_quantity > 10").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).cast("long").alias("i"))
    return c.prefix_length(chunks, "k", "i")


@query("SELECT l_orderkey AS id, CASE WHEN done >= total THEN 'ready' WHEN status IN ('ready', 'running') THEN 'queued' ELSE status END AS status FROM (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS done, count(*) AS total, CASE l_orderkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'running' ELSE 'failed' END AS status FROM lineitem GROUP BY 1)")
def q_reconcile(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count("*").alias("total"))
    rows = rows.withColumn("status", F.when(F.col("id") % 3 == 0, "ready").when(F.col("id") % 3 == 1, "running").otherwise("failed"))
    return c.reconcile(rows).select("id", "status")


@query("SELECT o_orderkey AS id, CASE WHEN l.total IS NULL THEN NULL WHEN o_orderstatus = 'F' THEN l.total ELSE l.done END AS chunks_done, l.total AS chunks_total FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS done FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def q_playback_status(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    joined = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus").join(rows, "id", "left")
    return joined.select("id", F.when(F.col("o_orderstatus") == "F", F.col("total")).otherwise(F.col("done")).alias("chunks_done"), F.col("total").alias("chunks_total"))


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2 HAVING count(*) < CASE event_type WHEN 'click' THEN 14 ELSE 15 END")
def q_limits(t: Tables) -> DataFrame:
    n = t.events.where(F.col("event_type").isin("click", "view")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.where(F.col("n") < F.when(F.col("event_type") == "click", 14).otherwise(15))
