"""The relational catalogue: collections, ordered membership, sources; changes as functions from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def cards(collections: DataFrame, members: DataFrame, tracks: DataFrame, covers: int = 4) -> DataFrame:
    """Each collection (id, name) with its number of tracks and the first titles by position.

    ``members``: collection_id, track_id, position; ``tracks``: id, title. Tasks count their own members and keep the first few
    of each collection before anything is shuffled by it, so a collection of any size costs a task no more than that.
    """
    titled = members.join(tracks.select(F.col("id").alias("track_id"), "title"), "track_id")
    counts = titled.groupBy("collection_id").agg(F.count("*").alias("n_tracks"))
    place = F.row_number().over(Window.partitionBy("collection_id").orderBy("position", "track_id", "title"))
    heads = titled.select("collection_id", "title", place.alias("place")).where(F.col("place") <= covers)
    first = heads.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("head"))
    lists = counts.join(first, "collection_id")
    return collections.join(lists, collections["id"] == lists["collection_id"]).select("id", "name", "n_tracks", F.transform("head", lambda x: x.title).alias("covers"))


def collection_tracks(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """Members joined with their tracks (unordered; sort by collection_id, position where order is shown)."""
    return members.join(tracks.withColumnRenamed("id", "track_id"), "track_id")


def optional_filter(df: DataFrame, column: str, value: object | None) -> DataFrame:
    """Rows of the value; all rows without one."""
    return df if value is None else df.where(F.col(column) == F.lit(value))


def without_members_of(members: DataFrame, collections: DataFrame, condition: Column, key: str = "collection_id") -> DataFrame:
    """Membership without that in the collections (id) that meet the condition."""
    return members.join(collections.where(condition).select(F.col("id").alias(key)), key, "left_anti")


def used(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents that some child refers to."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)), parent_key, "left_semi")


def unused(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents without a child; null child keys refer to nobody."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)), parent_key, "left_anti")


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key, by an aggregate that combines before the shuffle."""
    others = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*others), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_row")).select(key, "_row.*")


def distinct_by_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Distinct by key; the row of the least ``order`` stands for all."""
    return first_per_key(df.withColumn("_key", key), "_key", F.col(order)).drop("_key")


def with_default(df: DataFrame, lookup: DataFrame, key: str, column: str, default: object) -> DataFrame:
    """A left join that gives a default where the lookup has no row or a null."""
    return df.join(lookup.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def next_positions(members: DataFrame) -> DataFrame:
    """For each collection the position at its end and before its front."""
    return members.groupBy("collection_id").agg((F.max("position") + 1).alias("next_position"), (F.min("position") - 1).alias("front_position"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of both; where keys meet the new values win, except for the columns to keep."""
    others = [c for c in old.columns if c not in key]
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    value = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in key], *[value(c).alias(c) for c in others])


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key (insert or replace)."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, "_row.*")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(*old.columns))


def guarded_update(df: DataFrame, guard: Column, **values: Column) -> DataFrame:
    """New values only where the guard holds (null: it doesn't)."""
    return df.withColumns({c: F.when(F.coalesce(guard, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def fill_missing(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Nulls filled from another table's row of the key; what is there stays."""
    joined = df.alias("d").join(other.select(key, *columns).alias("x"), key, "left")
    return joined.select(key, *[(F.coalesce(f"d.{c}", f"x.{c}") if c in columns else F.col(f"d.{c}")).alias(c) for c in df.columns if c != key])


def move_in_list(members: DataFrame, moves: DataFrame) -> DataFrame:
    """Positions 0, 1, ... after moving one track of each collection; ``moves``: collection_id, track_id, to.

    A window numbers one collection at a time.
    """
    m = moves.select("collection_id", F.col("track_id").alias("_moved"), "to")
    ranked = members.join(m, "collection_id", "left")
    moved = F.coalesce(F.col("track_id") == F.col("_moved"), F.lit(False))
    by = Window.partitionBy("collection_id")
    rest = F.sum(F.when(moved, 0).otherwise(1)).over(by.orderBy("position", "track_id")) - 1
    order = F.when(moved, F.col("to") * 2).otherwise(rest * 2 + F.when(F.col("to").isNotNull() & (rest >= F.col("to")), 1).otherwise(-1))
    return ranked.withColumn("_at", order).select("collection_id", "track_id", (F.row_number().over(by.orderBy("_at", "track_id")) - 1).alias("position"))


def without_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose composite key isn't to be deleted."""
    return df.join(keys, keys.columns, "left_anti")


def dangling(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children whose non-null key has no parent."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def reconcile(rows: DataFrame, done: str = "done", total: str = "total", status: str = "status") -> DataFrame:
    """Status after a restart: all done is ready; what was ready or running otherwise is queued; the rest stays."""
    return rows.withColumn(status, F.when(F.col(done) >= F.col(total), "ready").when(F.col(status).isin("ready", "running"), "queued").otherwise(F.col(status)))


def evict(entries: DataFrame, budget: Column, scope: str) -> DataFrame:
    """Entries to remove, least ready and least recently used first, until the rest fits the budget of their scope.

    An entry goes if what remains without the ones before it is still over the budget; protected
    entries neither count nor go.
    """
    own = entries.where(~F.col("protected"))
    by = Window.partitionBy(scope)
    before = F.coalesce(F.sum("size").over(by.orderBy("ready", "last_used", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("_left", F.sum("size").over(by) - before).where(F.col("_left") > budget).drop("_left")


def prefix_length(chunks: DataFrame, key: str, index: str) -> DataFrame:
    """How many chunks 0, 1, ... each key has without a gap."""
    by = Window.partitionBy(key).orderBy(index)
    ranked = chunks.select(key, index).distinct().withColumn("_n", F.row_number().over(by) - 1)
    return ranked.groupBy(key).agg(F.sum((F.col(index) == F.col("_n")).cast("long")).alias("contiguous"))


class MissingError(LookupError):
    """Keys that must be there and aren't."""


def rows_of(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of some keys (all columns of ``keys``), which must all be there; MissingError names up to ten that aren't.

    Keys are looked up by a semi join; Spark broadcasts them if they are few.
    """
    lacking = keys.distinct().join(df.select(*keys.columns), keys.columns, "left_anti").limit(10).collect()
    if lacking:
        raise MissingError(", ".join(str(tuple(r)) for r in lacking))
    return df.join(keys, keys.columns, "left_semi")


def finish(separations: DataFrame, done: DataFrame, now_ms: int) -> DataFrame:
    """Separations (audio_hash, model_id, chunks_total, chunks_done, status, last_used_at) of which some are done: ready, all chunks, used now. Keys that aren't there are an error, as in ``rows_of``."""
    keys = ["audio_hash", "model_id"]
    rows_of(separations.select(*keys), done.select(*keys))
    news = {"status": F.lit("ready"), "chunks_done": F.col("chunks_total"), "last_used_at": F.lit(now_ms).cast("long")}
    marked = separations.join(done.select(*keys).distinct().withColumn("_done", F.lit(True)), keys, "left")
    return marked.select(*[F.when(F.col("_done"), news[c]).otherwise(F.col(c)).alias(c) if c in news else F.col(c) for c in separations.columns])


def may_start(tracks: DataFrame, queued: DataFrame, sources: DataFrame) -> DataFrame:
    """Tracks (id) that may be added now: neither queued (track_id) nor with fetched audio in a source (track_id, audio_hash)."""
    busy = queued.select("track_id").unionByName(sources.where("audio_hash is not null").select("track_id")).distinct()
    return tracks.join(busy, F.col("id") == F.col("track_id"), "left_anti")
