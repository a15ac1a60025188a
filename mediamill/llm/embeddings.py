"""Embedding near-dedup: spherical k-means cells, blocked cosine products within and across cells, one representative a group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Forest, checkpointed, connected_components

COSINE = 0.93
#: Vectors that a cell should hold at least; cells grow so that all labels together have about TOTAL centres at most.
CELL, TOTAL = 256, 1 << 16
#: Centres of a label at most, vectors from which they are fitted (at least so many, and EACH for a centre), rounds.
CENTRES, SAMPLE, EACH, ROUNDS = 4096, 8192, 16, 8
#: Cells in which a vector may have a partner, on average at most; where more would be needed, cells tell little apart and larger ones take their place.
FAN = 3.0
#: Vectors of a cell that meet as one block.
BLOCK = 1024


def fit_centres(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means on unit vectors: centres are unit means of the vectors they are nearest to."""
    centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return np.unique(centres, axis=0)


def _unit(pdf: pd.DataFrame) -> np.ndarray:
    v = np.stack([np.frombuffer(x, np.float64) for x in pdf.vector])
    most = np.abs(v).max(axis=1, keepdims=True)
    odd = ((most > 1e150) | (most < 1e-150)).ravel()  # their squares would overflow or vanish
    if odd.any():
        v[odd] /= most[odd]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _reached(x: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors their home cell and all cells in which a vector within the angle may be at home.

    A neighbour y of x at home with centre c' has y(c' - c) >= 0 for x's own centre c, so the angle
    of x to that half-space is at most the angle of the threshold.
    """
    near = x @ centres.T
    home = near.argmax(axis=1)
    gaps = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    far = near[np.arange(len(x)), home][:, None] - near
    return home, far <= gaps[home] * (math.sqrt(1 - cosine * cosine) + 1e-9)


def _centres(sample: DataFrame, cell: int, cosine: float) -> dict[tuple[int, int], np.ndarray]:
    """Centres by (label, length of vector); the sample is bounded for each of them."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(pdf.sort_values("name"))
        k = int(min(CENTRES, max(1, -(-int(pdf.n.iloc[0]) // cell)), len(x)))
        found = fit_centres(x, k)
        while k > 1 and _reached(x, found, cosine)[1].sum(axis=1).mean() > FAN:
            k = k // 2
            found = fit_centres(x, k)
        return pd.DataFrame({"label": pdf.label.iloc[0], "dim": pdf.dim.iloc[0], "centres": [found.tobytes()]})

    rows = sample.groupBy("label", "dim").applyInPandas(fit, "label long, dim long, centres binary").collect()
    return {(r.label, r.dim): np.frombuffer(r.centres, np.float64).reshape(-1, r.dim) for r in rows}


def _assign(shared, cosine: float):
    """Each vector's home cell, and as a guest all cells in which a vector within the angle may be at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            for (label, dim), part in pdf.groupby(["label", "dim"]):
                centres = shared.value.get((label, dim))
                if centres is None:  # few vectors are one cell
                    centres = np.eye(1, dim)
                home, reached = _reached(_unit(part), centres, cosine)
                r, c = np.nonzero(reached)
                out = part.iloc[r].assign(cell=c, home=c == home[r])
                yield pa.RecordBatch.from_pandas(out[["name", "label", "dim", "n_copies", "vector", "cell", "home"]], preserve_index=False)

    return run


def _compare(cosine: float):
    """One block of home vectors with one block of a cell's vectors: counts of links of the first, and a spanning forest of the links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, other = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(own) or not len(other):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        near = _unit(own) @ _unit(other).T >= cosine
        ids, more = own["name"].to_numpy(), other["name"].to_numpy()
        near &= ids[:, None] != more[None, :]
        counts = near @ other.n_copies.to_numpy()
        forest = Forest()
        links = [(ids[i], more[j], 0) for i, j in zip(*np.nonzero(near)) if forest.join(int(ids[i]), int(more[j]))]
        rows = links + [(i, i, n) for i, n in zip(ids, counts) if n]
        return pd.DataFrame(rows, columns=["a", "b", "n"]).astype("int64")

    return run


def _usable(v: Column, label: Column, vec_id: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vec_id.isNotNull() & label.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[Column, Column, Column]:
    # a zero is a zero, whatever its sign
    return F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))


def _named(label: str, v: str, seed: int) -> Column:
    return F.xxhash64(label, v, F.lit(seed))


def _classes(good: DataFrame) -> tuple[DataFrame, int]:
    """Equal vectors of a label as one class, with its copies and smallest id, under a name; and the seed of the names, by which rows find theirs again.

    Names are 64-bit hashes; should two classes share one, another seed is taken.
    """
    for seed in range(8):
        classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n_copies")).withColumn("name", _named("label", "v", seed))
        classes = checkpointed(classes.select("label", "v", "rep", "n_copies", "name").mapInArrow(_pack, "label long, dim long, rep long, n_copies long, name long, vector binary"))
        if classes.groupBy("name").count().where("count > 1").isEmpty():
            return classes, seed
    raise RuntimeError("no seed tells all classes apart")


def _found(good: DataFrame, cosine: float, cell: int, sample: int) -> tuple[DataFrame, int]:
    """(name, n_links, component_id) of each class, and the seed of the names."""
    spark = good.sparkSession
    classes, seed = _classes(good)
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    cell = max(cell, math.ceil((sizes.agg(F.sum("n")).first()[0] or 0) / TOTAL))
    wanted = F.greatest(F.lit(sample), EACH * F.least(F.ceil(F.col("n") / cell), F.lit(CENTRES)))
    share = F.pmod(F.xxhash64("name"), F.lit(1 << 40)) < wanted / F.col("n") * (1 << 40)
    sampled = classes.join(sizes.where(F.col("n") > cell), ["label", "dim"]).where(share | (F.col("n") <= wanted))
    shared = spark.sparkContext.broadcast(_centres(sampled.select("label", "dim", "n", "name", "vector"), cell, cosine))
    placed = checkpointed(classes.mapInArrow(_assign(shared, cosine), "name long, label long, dim long, n_copies long, vector binary, cell long, home boolean"))
    # of each cell the numbers of blocks, at home and in all
    blocks = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).alias("own"), F.ceil(F.count("*") / BLOCK).alias("all")).where("own > 0")
    in_cell = placed.join(blocks, ["label", "dim", "cell"])
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    place = lambda n: F.pmod(F.xxhash64("name"), F.col(n))
    keys = ["label", "dim", "cell", "i", "j"]
    met = in_cell.where("home").withColumn("i", place("own")).withColumn("j", F.explode(upto("all"))).withColumn("side", F.lit(0))
    met = met.unionByName(in_cell.withColumn("j", place("all")).withColumn("i", F.explode(upto("own"))).withColumn("side", F.lit(1)))
    found = checkpointed(met.groupBy(*keys).applyInPandas(_compare(cosine), "a long, b long, n long"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("others"))
    components = connected_components(found.where("n = 0"), "a", "b").withColumnRenamed("node", "name")
    each = classes.select("name", "rep", "n_copies").join(counts, "name", "left").join(components, "name", "left").withColumn("component", F.coalesce("component", "name"))
    least = each.groupBy("component").agg(F.min("rep").alias("component_id"))
    return each.join(least, "component").select("name", (F.coalesce("others", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), "component_id"), seed


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other vectors at this cosine or more under the same label), component_id (smallest id reachable), kept.

    Equal vectors of a label form one class, which goes on as one under a name of its own. Spherical k-means, fitted for each label on
    at most about ``sample`` classes taken by hash (more for many centres), gives cells; a label of few
    vectors is one cell, and so are vectors that no cells tell apart (FAN). At most about TOTAL centres are broadcast. A vector is at home in the cell of
    its nearest centre and a guest wherever a partner may be at home, so no link is lost. Home
    vectors meet the cell's vectors block by block; a block gives counts and a spanning forest,
    never all pairs.

    Vectors that are null, empty, zero or hold a null or non-finite component, and vectors without a
    label, have no links and stay alone; vectors of different lengths never link; components of any finite
    size count. Each row counts for itself: of a row that comes twice each copy links with the other, and rows of one
    id with different vectors or labels have results of their own. An empty table gives an empty result; other columns don't come along.
    """
    vec_id, label, v = _rows(vectors, id_col, vector_col, label_col)
    rows = vectors.select(vec_id.alias("vec_id"), label.alias("label"), v.alias("v"))
    usable = _usable(F.col("v"), F.col("label"), F.col("vec_id"))
    good = rows.where(usable)
    found, seed = _found(good, cosine, cell, sample)
    linked = good.select("vec_id", _named("label", "v", seed).alias("name")).join(found, "name").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label, rep, copies, name = (batch.column(batch.schema.get_field_index(c)) for c in ("label", "rep", "n_copies", "name"))
        vectors = [np.asarray(v, np.float64) for v in batch.column(batch.schema.get_field_index("v")).to_pylist()]
        packed = pa.array([v.tobytes() for v in vectors], pa.binary())
        yield pa.RecordBatch.from_arrays([label, pa.array([len(v) for v in vectors], pa.int64()), rep, copies, name, packed], names=["label", "dim", "rep", "n_copies", "name", "vector"])


def keep_one(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """The rows that represent their group, with all their columns: those of its smallest id, and rows that can't link.

    Repeated rows stay or go together; of rows of one id with different vectors each stays as its own group says. Rows without an id
    stay. An empty table gives an empty one. Columns of any name come along.
    """
    row = "_row"
    while any(c.lower().startswith(row) for c in vectors.columns):
        row = f"_{row}"
    vec_id, label, v = _rows(vectors, id_col, vector_col, label_col)
    marked = vectors.withColumn(row, F.struct(vec_id.alias("vec_id"), label.alias("label"), v.alias("v")))
    usable = _usable(F.col(row).v, F.col(row).label, F.col(row).vec_id)
    found, seed = _found(marked.where(usable).select(f"{row}.*"), cosine, cell, sample)
    key = marked.where(usable).select("*", F.col(f"{row}.label").alias(f"{row}_label"), F.col(f"{row}.v").alias(f"{row}_v"))
    named = key.withColumn(f"{row}_name", _named(f"{row}_label", f"{row}_v", seed))
    kept = found.select(F.col("name").alias(f"{row}_name"), F.col("component_id").alias(f"{row}_id"))
    stay = named.join(kept, f"{row}_name").where(F.col(f"{row}.vec_id") == F.col(f"{row}_id"))
    columns = [F.col(f"`{c}`") for c in vectors.columns]
    return stay.select(*columns).unionByName(marked.where(~usable).select(*columns))
