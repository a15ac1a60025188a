"""MinHash near-dedup by an inverted join over signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import LOWER, U, Forest, checkpointed, connected_components, id_filter, maybe_in, mix64, shingle_sets, slices, texts_of, without_ids

#: Signature coordinates, and the chance with which a pair at the least similarity may share too few of them to be compared on its full sets.
COORDINATES, MISSED = 32, 1e-7
#: Documents of a posting list whose signatures meet in one task; longer lists are cut into blocks, and blocks are paired.
BLOCK = 2048
#: Documents of one side whose full sets meet in one task.
CELL = 256
#: Centres that may be broadcast with the number of their groups.
FEW = 1 << 17
#: Rows of a star that meet its centre in one task.
SALT_ROWS = 128


def fitting_matches(percent: int, coordinates: int = COORDINATES) -> int:
    """The most coordinates (1 at least) that a pair of ``percent``/100 shares but for a chance below ``MISSED``: of 32, 15 at 85 and 12 at 80."""
    p, below, m = percent / 100, 0.0, 0
    while m < coordinates and (below := below + math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)) < MISSED:
        m += 1
    return max(1, m)


def _seeds(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def _signatures(id_col: str, text_col: str, width: int, n: int):
    seeds = _seeds(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                sets = shingle_sets([t.translate(LOWER) for t in texts_of(batch, text_col)], width)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                tokens = np.zeros((len(sets), n), U)
                d1, d2 = np.zeros(len(sets), U), np.zeros(len(sets), U)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    for j in range(n):
                        tokens[full, j] = mix64(np.minimum.reduceat(flat * seeds[j], at) ^ U((j + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
                    d1[full] = np.add.reduceat(mix64(flat ^ U(0x51)), at)
                    d2[full] = np.add.reduceat(mix64(flat ^ U(0x7A3)), at)
                folds = pa.array([_parity(s) for s in sets], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(sets) + 1, n, dtype=np.int32)), pa.array(tokens.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists, folds], names=["doc_id", "n_shingles", "d1", "d2", "tokens", "parity"])

    return run


def _parity(shingles: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls in each of 4 (256 at least) to 8 places a shingle, by the lowest bits: two sets differ in no fewer shingles than places."""
    places = max(256, 1 << (4 * len(shingles) - 1).bit_length()) if len(shingles) else 256
    odd = np.bincount((shingles & U(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sets(text_col: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                sets = [s for s in shingle_sets([t.translate(LOWER) for t in texts_of(batch, text_col)], width) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return run


def _name(shingles: np.ndarray) -> int:
    return int(mix64(shingles ^ U(0x51)).sum().view(np.int64))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two blocks of sorted sets."""
    if len(left) == 1:
        a = left[0]
        out = np.zeros((1, len(right)), np.int64)
        for k, b in enumerate(right):
            at = np.searchsorted(a, b)
            at[at == len(a)] = 0
            out[0, k] = np.count_nonzero(a[at] == b)
        return out
    both = np.concatenate(left + right)
    names, code = np.unique(both, return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for k in range(0, len(names), 4096):
        a, b = np.searchsorted(code, (k, k + 4096))
        grid = np.zeros((len(left) + len(right), 4096), np.float32)
        grid[row[a:b], code[a:b] - k] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return np.rint(out).astype(np.int64)


def _agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many coordinates each signature of one block agrees with each of the other."""
    return sum((left[:, k, None] == right[None, :, k]).astype(np.int16) for k in range(left.shape[1]))


def _near_enough(left: pd.DataFrame, right: pd.DataFrame, close: np.ndarray, percent: int) -> np.ndarray:
    """The close pairs but those that surely aren't ``percent``/100 alike: sizes and parities say in how many shingles two sets differ at least."""
    sizes = left.n_shingles.to_numpy()[:, None] + right.n_shingles.to_numpy()[None, :]
    apart = np.abs(left.n_shingles.to_numpy()[:, None] - right.n_shingles.to_numpy()[None, :])
    close = close & ((100 + percent) * apart <= (100 - percent) * sizes)
    for a, own in left.parity.groupby(left.parity.str.len().to_numpy()).indices.items():
        for b, other in right.parity.groupby(right.parity.str.len().to_numpy()).indices.items():
            i, j = np.nonzero(close[np.ix_(own, other)])
            if not len(i):
                continue
            words = min(a, b) // 8
            # the lowest bits of a place are its place among fewer
            x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(part.parity.iloc[at]), U).reshape(len(at), -1, words), axis=1) for part, at in ((left, own), (right, other)))
            step = max(1, (1 << 20) // words)
            for k in range(0, len(i), step):
                m, n = i[k : k + step], j[k : k + step]
                differ = np.bitwise_count(x[m] ^ y[n]).sum(axis=1, dtype=np.int64)
                far = (100 + percent) * differ > (100 - percent) * sizes[own[m], other[n]]
                close[own[m[far]], other[n[far]]] = False
    return close


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Side 0 meets side 1; rows of side 2 meet each other."""
    pdf = pdf.drop_duplicates(["node", "side"])
    own = pdf[pdf.side != 1]
    return own, own if (pdf.side == 2).any() else pdf[pdf.side == 1]


def _spanning(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of the close pairs a forest that joins the same components."""
    names, code = np.unique(np.concatenate([left, right]), return_inverse=True)
    label, left, right = np.arange(len(names)), code[: len(left)], code[len(left) :]
    out = np.zeros_like(close)
    for i in np.flatnonzero(close.any(axis=1)):
        j = np.flatnonzero(close[i])
        met, at = np.unique(label[right[j]], return_index=True)
        new = met != label[left[i]]
        if new.any():
            out[i, j[at[new]]] = True
            label[np.isin(label, met[new])] = label[left[i]]
    return out


def _collide(matches: int, percent: int | None = None, spanning: bool = False):
    """Of one block pair the rows that agree with a row of the other side, not yet connected with it, in at least ``matches`` coordinates, and may be ``percent``/100 alike: once for each pair of cells where they do.

    ``spanning``: only rows of a forest of such pairs, and once, as of cell -1, each row that has such a pair at all.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, other = _sides(pdf)
        out = [own[:0].assign(cell=0)]
        if len(own) and len(other):
            left, right = (np.stack(x.tokens.to_numpy()) for x in (own, other))
            close = (_agreeing(left, right) >= matches) & (own.component.to_numpy()[:, None] != other.component.to_numpy()[None, :])
            if percent is not None:
                close = _near_enough(own, other, close, percent)
            if spanning:
                out += [rows[close.any(axis=axis)].assign(cell=-1) for rows, axis in ((own, 1), (other, 0))]
                close = _spanning(close, own.component.to_numpy(), other.component.to_numpy())
                close = close | close.T if other is own else close
            width = -(-len(other) // CELL)
            for i in range(0, len(own), CELL):
                for j in range(i if other is own else 0, len(other), CELL):
                    part = close[i : i + CELL, j : j + CELL]
                    if part.any():
                        cell = i // CELL * width + j // CELL
                        sides = ((own[i : i + CELL], 1, 0), (other[j : j + CELL], 0, 1))
                        if other is own and i == j:
                            sides = ((own[i : i + CELL], 1, 2),)
                        out += [rows[part.any(axis=axis)].assign(cell=cell, side=side) for rows, axis, side in sides]
        return pd.concat(out).drop(columns=["n_shingles", "parity"], errors="ignore")

    return run


def _link(percent: int, matches: int):
    """Of one group the links, confirmed on full sets: only pairs not yet connected matter, so a spanning forest is enough. Signatures, if given, say which pairs collide enough."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, other = _sides(pdf)
        found: list[tuple[int, int]] = []
        if len(own) and len(other):
            left, right = ([np.frombuffer(x, U) for x in part.shingles] for part in (own, other))
            inter = _overlaps(left, right)
            union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - inter
            good = 100 * inter >= percent * union
            if "tokens" in pdf.columns:
                good &= _agreeing(*(np.stack(x.tokens.to_numpy()) for x in (own, other))) >= matches
            ids, more, c1, c2 = own.node.tolist(), other.node.tolist(), own.component.tolist(), other.component.tolist()
            forest = Forest()
            for i, j in zip(*np.nonzero(good)):
                if ids[i] != more[j] and forest.join(c1[i], c2[j]):
                    found.append((ids[i], more[j]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept.

    Documents link when the Jaccard similarity of their sets of distinct ``width``-word shingles
    (A-Z lowered; fewer words: the whole sequence) is at least ``percent``/100.

    1. Each task hashes whole texts to shingle sets and MinHash tokens (coordinate, value); equal
       sets form one class, and only classes go on, each under the 64-bit hash of its set.
    2. Classes are posted under their tokens. A pair is retained if it agrees in ``matches``
       coordinates (by default what fits ``percent``); then it shares one of either's
       ``coordinates - matches + 1`` rarest tokens (prefix), so only these make posting lists.
       The other, longer lists are never merged: their coordinates are looked up for the pairs that
       met (skip), which gives the pair's whole count of collisions.
    3. Each list's members meet its best-connected member first, in salted groups of ``SALT_ROWS``;
       retained pairs are confirmed on full sets. Documents so joined need not meet again: in lists
       that still hold several groups, those outside the largest meet all others, cut into blocks of
       ``BLOCK``; collisions are counted in each pair of blocks, and only rows of retained pairs
       bring their full sets.
    4. Components over the confirmed links.

    Null or wordless texts have an empty set and stay alone; rows of one id are one node: whatever
    links with any of their texts reaches all; rows without id have no component; ids are
    numbers (others raise); an empty table gives an empty result.
    """
    matches = fitting_matches(percent, coordinates) if matches is None else matches
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = checkpointed(source.mapInArrow(_signatures("doc_id", "text", width, coordinates), "doc_id long, n_shingles long, d1 long, d2 long, tokens array<long>, parity binary"))
    worded = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = checkpointed(worded.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.first("parity").alias("parity")).withColumn("node", F.col("d1")))
    tokens_of = classes.select("node", "tokens")
    posts = classes.select("node", F.explode("tokens").alias("token"))
    counts = posts.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    by_doc = posts.join(counts, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("shared"), F.sum("n").alias("weight"))
    by_doc = by_doc.where(F.size("shared") >= matches)
    prefix = checkpointed(by_doc.select("node", "weight", F.explode(F.slice("shared", F.lit(1), F.size("shared") - (matches - 1))).alias("s")).select("node", "weight", F.col("s.token").alias("token")))

    hubs = prefix.groupBy("token").agg(F.max(F.struct("weight", F.col("node").alias("hub"))).alias("h"), F.count("*").alias("m")).where("m > 1").select("token", F.col("h.hub").alias("hub"), "m")
    stars = checkpointed(prefix.join(hubs, "token").where("node <> hub").select("node", "hub").distinct())

    def confirmed(members: DataFrame, key: list[str]) -> DataFrame:
        """members: node, side, component and the key of the group in which they meet."""
        involved = checkpointed(members.select("node").distinct().join(classes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id")).distinct())
        sets = maybe_in(source, "doc_id", id_filter(involved, "doc_id")).select("text").mapInArrow(_sets("text", width), "node long, shingles binary")
        return members.join(sets, "node").groupBy(*key).applyInPandas(_link(percent, matches), "a long, b long")

    # few centres have more members than one group takes: without a shuffle of all rows by centre while they are few
    large = checkpointed(stars.groupBy("hub").agg(F.ceil(F.count("*") / SALT_ROWS).alias("parts")).where("parts > 1"))
    salted = stars.join(F.broadcast(large) if large.count() <= FEW else large, "hub", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))

    def around(rows: DataFrame) -> DataFrame:
        return rows.select("node", F.lit(1).alias("side"), "hub", "salt").unionByName(rows.select(F.col("hub").alias("node"), F.lit(0).alias("side"), "hub", "salt").distinct())

    centre = F.first("tokens").over(Window.partitionBy("hub", "salt").orderBy("side"))
    collisions = F.aggregate(F.zip_with("tokens", "centre", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    retained = checkpointed(around(salted).join(tokens_of, "node").withColumn("centre", centre).where((F.col("side") == 1) & (collisions >= matches)).select("node", "hub", "salt"))
    links = checkpointed(confirmed(around(retained).withColumn("component", F.col("node")), ["hub", "salt"]))
    # a document's mark is its smallest linked centre, or that one's: equal marks are surely connected
    mark = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
    first = mark.alias("m").join(mark.alias("n"), F.col("m.to") == F.col("n.node"), "left").select("m.node", F.coalesce("n.to", "m.to").alias("component"))
    first = checkpointed(first)

    def alike_in_lists(rows: DataFrame, components: DataFrame, spanning: bool) -> DataFrame:
        rest = rows.join(components, "node", "left").select("token", "node", F.coalesce("component", "node").alias("component"))
        parts = rest.groupBy("token", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
        lists = parts.groupBy("token").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), F.sum("mark").alias("mark")).where("size > main.n")
        lists = lists.groupBy("mark", "size").agg(F.min(F.struct("token", "main")).alias("l")).select(
            F.col("l.token").alias("token"), F.col("l.main.component").alias("main"), F.ceil(F.col("l.main.n") / BLOCK).alias("main_blocks"), F.ceil((F.col("size") - F.col("l.main.n")) / BLOCK).alias("other_blocks")
        )
        open_ = rest.join(lists, "token").withColumn("is_main", F.col("component") == F.col("main")).withColumn("block", F.pmod(F.xxhash64("node", "token"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("other_blocks"))))
        upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        pairing = F.when(F.col("is_main"), F.transform(upto("other_blocks"), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))).otherwise(
            F.concat(
                F.transform(upto("main_blocks"), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side"))),
                F.transform(
                    upto("other_blocks"),
                    lambda k: F.struct(F.least("block", k).alias("i"), (F.col("main_blocks") + F.greatest("block", k)).alias("j"), F.when(F.col("block") == k, 2).when(F.col("block") < k, 0).otherwise(1).alias("side")),
                ),
            )
        )
        met = open_.join(classes.select("node", "n_shingles", "tokens", "parity"), "node").select("node", "component", "token", "n_shingles", "tokens", "parity", F.explode(pairing).alias("p")).select("*", "p.*").drop("p")
        return checkpointed(met.groupBy("token", "i", "j").applyInPandas(_collide(matches, percent, spanning), "node long, component long, token long, tokens array<long>, i long, j long, side int, cell long"))

    # what a forest joins need not meet in full: rows with full sets stay near the number of components of a list
    cells = ["token", "i", "j", "cell"]
    close = alike_in_lists(prefix.join(hubs, "token").where("m > 2 and node <> hub").select("token", "node"), first, True)
    links = links.unionByName(checkpointed(confirmed(close.where("cell >= 0"), cells)))
    joined = connected_components(links, "a", "b")
    close = alike_in_lists(close.where("cell < 0").select("token", "node").distinct(), joined, False)
    links = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(checkpointed(confirmed(close, cells)))
    # rows of one id with different texts
    least = worded.groupBy("doc_id").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a <> b").select("doc_id", "a")
    links = links.unionByName(worded.join(least, "doc_id").where("d1 <> a").select("a", F.col("d1").alias("b")))
    found = connected_components(links, "a", "b")
    reps = classes.select("node", "rep")
    linked = reps.join(found, "node")
    linked = linked.select("node", "component").join(linked.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "component_id")
    named = classes.select("d1", "d2", "n_shingles", "node", "rep").join(linked, "node", "left").select("d1", "d2", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    return sigs.join(named, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The documents that represent their group, with all their columns."""
    groups = near_duplicates(docs, id_col, text_col, **parameters)
    return without_ids(docs, id_col, groups.where("not kept").select(F.col("doc_id").alias(id_col)))
