"""Source divergence audit: vectors of (lang, source) groups stay in their partitions while packed peers come round by round."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import LOWER, checkpointed, slices, texts_of

#: A lang's term is kept if so many of its documents hold it; ranks of part ``term`` go to TOP.
DOCUMENTS, TOP = 10, 10
#: Terms of a shard, about; sources of a slot at least; slots at most; numbers that a meeting holds, about.
SHARD, SLOT, SLOTS, CELLS = 1 << 12, 8, 16, 1 << 22
#: Entries that a task counts before it hands them on.
HELD = 200_000
_terms = re.compile(rb"[a-z\x80-\xff]+").findall  # of lower-cased UTF-8: no byte of other signs is in a longer character


def share(count: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)), by three steps of long division, so that numbers to 9 * 10^15 stay exact in 64 bits."""
    rest, whole = np.asarray(count, np.int64) + 2, total + 2 * kinds
    out = rest // whole
    rest = rest % whole
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each (lang, source) with their occurrences and documents, summed within a task."""
    n, df, held = defaultdict(Counter), defaultdict(Counter), 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in n.items():
            own = df[lang, source]
            items = list(terms.items())
            for k in range(0, len(items), 20_000):
                part = items[k : k + 20_000]
                columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array([t for t, _ in part], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([c for _, c in part], pa.int64()), pa.array([own[t] for t, _ in part], pa.int64())], names=["lang", "source", "term", "n", "df"])
        n.clear(), df.clear()

    for whole in batches:
        for batch in slices(whole, "text"):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, "text")):
                found = _terms(text.translate(LOWER))
                own = n[lang, source]
                held -= len(own)
                own.update(found)
                df[lang, source].update(set(found))
                held += len(own)
                if held > HELD:
                    yield from flush()
                    held = 0
    yield from flush()


def _pack(terms: list[dict]) -> bytes:
    """Places (as gaps) and counts of a group's terms in a shard, compressed."""
    at = np.array([t["at"] for t in terms], np.int64)
    order = np.argsort(at)
    return zlib.compress(np.concatenate((np.diff(at[order], prepend=0), np.array([t["n"] for t in terms], np.int64)[order])).astype("<i8").tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<i8")
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's terms of a shard as a packed vector, and its most telling ones, kept by a heap."""
    for batch in batches:
        packed, tops = [], []
        names = batch.schema.names
        for total, all_total, kinds, terms in zip(*(batch.column(names.index(c)).to_pylist() for c in ("total", "lang_total", "kinds", "terms"))):
            terms = terms or []
            packed.append(_pack(terms))
            p = share(np.array([t["n"] for t in terms], np.int64), total, kinds) if terms else np.zeros(0, np.int64)
            q = share(np.array([t["all"] for t in terms], np.int64), all_total, kinds) if terms else p
            f = distance(p, q)
            best = heapq.nsmallest(TOP, ((-int(f[k]), terms[k]["term"].encode()) for k in np.flatnonzero(p > q)))
            tops.append([{"item": t.decode(), "value": -v} for v, t in best])
        rest = [batch.column(names.index(c)) for c in ("lang", "source", "slot", "shard", "total", "kinds")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(packed, pa.binary()), pa.array(tops, pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())])))], names=["lang", "source", "slot", "shard", "total", "kinds", "packed", "top"])


def _dense(pdf: pd.DataFrame, places: np.ndarray, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """The groups' p over the places (one row each), and their p of a term that they lack."""
    rows = np.zeros((len(pdf), len(places)), np.int64)
    for row, (at, n) in enumerate(counts):
        rows[row, np.searchsorted(places, at)] = n
    for row, (total, kinds) in enumerate(zip(pdf.total.tolist(), pdf.kinds.tolist())):
        rows[row] = share(rows[row], total, kinds)
    return rows, np.array([share(0, t, k) if k else 0 for t, k in zip(pdf.total.tolist(), pdf.kinds.tolist())], np.int64)


def _pairs(lang: str, found: list[tuple[str, str, int]], same: bool) -> pd.DataFrame:
    both = [x for x in found if x[0] != x[1]] if same else found + [(b, a, v) for a, b, v in found]
    names = [pd.Series(x, dtype=object) for x in ([lang] * len(both), [x[0] for x in both], [x[1] for x in both])]
    return pd.DataFrame({"lang": names[0], "source": names[1], "item": names[2], "value": np.array([x[2] for x in both], np.int64)})


def _meet(hosts: pd.DataFrame, guests: pd.DataFrame, same: bool) -> pd.DataFrame:
    """Both directions of every pair of a host and a guest, over one shard.

    Terms that neither has are worth the same each; the first shard counts all terms as such, and every
    shard adds by how much its terms differ from that.
    """
    lang, first = (hosts.lang.iloc[0], int(hosts.shard.iloc[0]) == 0) if len(hosts) else ("", False)
    kinds = int(hosts.kinds.iloc[0]) if len(hosts) and len(guests) else 0
    if not kinds:
        return _pairs(lang, [(a, b, 0) for a in hosts.source for b in guests.source] if first else [], same)
    own = [_unpack(x) for x in hosts.packed]
    others = own if same else [_unpack(x) for x in guests.packed]
    places = np.unique(np.concatenate([at for at, _ in own + others]))
    p, p0 = _dense(hosts, places, own)
    q, q0 = (p, p0) if same else _dense(guests, places, others)
    found = []
    for k, item in enumerate(guests.source):
        bare = distance(p0, q0[k])
        value = (distance(p, q[k]) - bare[:, None]).sum(axis=1) + (kinds * bare if first else 0)
        found += zip(hosts.source, [item] * len(value), value.tolist())
    return _pairs(lang, found, same)


def opponent(slot, turn: int, slots: int):
    """Whom a slot meets in a turn of a tournament of an even number of slots (circle method); works for columns and integers."""
    last = slots - 1
    other = (2 * turn - slot + 2 * last) % last
    if isinstance(slot, int):
        return turn if slot == last else last if other == slot else other
    return F.when(slot == last, turn).when(other == slot, last).otherwise(other)


def audit(docs: DataFrame, least: int = DOCUMENTS, shard: int = SHARD, slot: int = SLOT) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's use of its lang's kept terms is from every other source's (``pair``), and its most telling terms (``term``).

    Null text, lang and source count as empty. Every lang and source that occurs is a group, even without terms; a lang without kept
    terms has pairs of value 0, one with a single source no pairs. Rows that come twice count twice. Equal
    values rank by item in UTF-8 order. An empty table gives an empty one; other columns don't come along.

    Counts are summed in tasks first, then by (lang, source, term). Kept terms fall into shards by hash, a lang's sources
    into slots; a partition holds the vectors of one slot over one shard, and stays. Packed copies of the other slots'
    vectors come by in the rounds of a round-robin tournament; a meeting gives both directions of its
    pairs and holds about CELLS numbers at most. Sums over shards are made before the shuffle. The result
    has a row for every pair of sources of a lang, as asked for; nothing else grows with the square of their number.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = rows.mapInArrow(_count, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    by_term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("all", F.sum("n").over(by_term)).withColumn("holders", F.sum("df").over(by_term)).where(F.col("holders") >= least)
    counts = checkpointed(counts.select("lang", "source", "term", "n", "all"))
    by_lang = Window.partitionBy("lang")
    terms = counts.groupBy("lang", "term").agg(F.first("all").alias("all"))
    kinds = terms.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("all").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kinds, "lang", "left").na.fill(0, ["total", "kinds", "lang_total"])
    groups = checkpointed(groups.withColumn("number", F.row_number().over(by_lang.orderBy("source")) - 1))
    most, largest = groups.agg(F.max("number"), F.max("kinds")).first()
    if most is None:
        return docs.sparkSession.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    slot = max(slot, -(-(most + 1) // SLOTS))
    shards = max(1, -(-largest // max(64, min(shard, CELLS // (2 * slot)))))
    slots = -(-(most + 1) // slot)
    slots += slots % 2
    numbered = counts.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))
    place = F.dense_rank().over(Window.partitionBy("lang", "shard").orderBy("term"))
    numbered = numbered.withColumn("at", place).groupBy("lang", "source", "shard").agg(F.collect_list(F.struct("at", "n", "all", "term")).alias("terms"))
    grid = groups.withColumn("slot", F.floor(F.col("number") / slot).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    made = T.StructType.fromDDL("lang string, source string, slot int, shard int, total long, kinds long, packed binary, top array<struct<item string, value long>>")
    vectors = checkpointed(grid.join(numbered, ["lang", "source", "shard"], "left").select("lang", "source", "slot", "shard", "total", "lang_total", "kinds", "terms").mapInArrow(_vectors, made))
    keys = ["lang", "shard", "slot"]
    peers = vectors.drop("top")
    # stays where it is through all rounds; what is lost with an executor is read again from the checkpoint
    resident = peers.repartition(*keys).persist(StorageLevel.DISK_ONLY)
    out = "lang string, source string, item string, value long"
    found = resident.groupBy(*keys).applyInPandas(lambda pdf: _meet(pdf, pdf, True), out)
    for turn in range(slots - 1):
        host = opponent(F.col("slot"), turn, slots)
        guests = peers.withColumn("host", host.cast("int")).where("host < slot")
        found = found.unionByName(resident.groupBy(*keys).cogroup(guests.groupBy("lang", "shard", "host")).applyInPandas(lambda a, b: _meet(a, b, False), out))
    pairs = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    telling = vectors.select("lang", "source", F.explode("top").alias("t")).select("lang", "source", F.lit("term").alias("part"), "t.item", "t.value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.unionByName(telling).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP))


#: The same result as DuckDB SQL.
ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
    SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= 10
), langs AS (
    SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang
), grouped AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(sum(c.n) OVER (PARTITION BY g.lang, g.source), 0)::BIGINT + 2 * l.v) AS p,
        1 + 1000000000 * (k.n + 2) // (l.n + 2 * l.v) AS q
    FROM grouped g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
