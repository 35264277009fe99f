"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors of a label are one class. Classes of a label are dealt into blocks by their place on the axis along which a sample varies most, and pairs of blocks are tiles, so
a label of any size is spread over tasks. Unit vectors that link lie at most sqrt(2 - 2 threshold) apart, on that axis too: a vector goes to the tiles of blocks within that reach only.
In a tile the vectors are rotated to their principal axes; the leading coordinates are multiplied first, the product of the
norms of what is left bounds the rest, and a pair is dropped as soon as its cosine cannot reach the threshold. Survivors are decided on the
original coordinates in double precision. A tile returns counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import let, written
from .graph import Sets, components

#: Leading coordinates after which bounds are tested, as shares of all.
STEPS = (1 / 8, 1 / 4, 1 / 2)
#: Vectors, and numbers in them, that the rotation is fitted on, at most. It orders the work and cannot change a result.
FIT, FIT_NUMBERS = 8192, 1 << 22
SLACK = 1e-9
#: Bins of the axis by which blocks are made.
BINS = 4096


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times powers of two so that the largest component of each is between 1/2 and 1: squares neither overflow nor vanish, and no digit changes."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, initial=0.0))[1][:, None])


def unit(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / np.linalg.norm(m, axis=1)[:, None]


def rotation(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors, most varying first."""
    values, axes = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(axes[:, ::-1])


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, into b) with cosine of at least ``threshold``; with ``same`` each unordered pair of a once."""
    a, b = scaled(a), scaled(b)
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ua, ub = a / norm_a[:, None], b / norm_b[:, None]
    ra, rb = (ua, ub) if axes is None else (ua @ axes, ub @ axes)
    dims = ra.shape[1]
    left_a, left_b = (np.sqrt(np.maximum(np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1], 0)) for r in (ra, rb))
    cuts = sorted({max(1, int(dims * s)) for s in STEPS} | {dims})
    first = cuts[0]
    total = ra[:, :first] @ rb[:, :first].T
    tail = lambda left, rows, k: left[rows, k] if k < dims else np.zeros(len(rows))
    bound = total + np.outer(tail(left_a, np.arange(len(ra)), first), tail(left_b, np.arange(len(rb)), first))
    alive = bound >= threshold - SLACK
    if same:
        alive &= np.tri(len(ra), len(rb), -1, dtype=bool).T
    i, j = np.nonzero(alive)
    total = total[i, j]
    for start, past in zip(cuts, cuts[1:]):
        kept_i, kept_j, kept = [], [], []
        for at in range(0, len(i), 1 << 17):  # bounded scratch space however many pairs are left
            pi, pj = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            t = total[at : at + (1 << 17)] + np.einsum("pd,pd->p", ra[pi, start:past], rb[pj, start:past])
            ok = t + tail(left_a, pi, past) * tail(left_b, pj, past) >= threshold - SLACK
            kept_i.append(pi[ok]), kept_j.append(pj[ok]), kept.append(t[ok])
        i, j, total = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kept_i, kept_j, kept))
    keep = []
    for at in range(0, len(i), 1 << 17):
        pi, pj = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
        keep.append(np.einsum("pd,pd->p", a[pi], b[pj]) / (norm_a[pi] * norm_b[pj]) >= threshold)
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok]


def near_vectors(vectors: DataFrame, threshold: float = 0.93, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only rows with equal labels, not null, and equal lengths are compared. A vector that is null, empty or all zero, or holds a null, NaN or infinite
    component links with nothing. Repeated rows are vectors of their own. ``component_id`` is the smallest id reachable by links, null only where all ids there are null.
    Components of any size and vectors of any length are compared whole. Ties need no rule. Other columns are not read. An empty table gives an empty result.
    """
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: F.coalesce(bad(x), F.lit(True))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    classes = rows.where("fit").groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "label", F.size("vector").alias("dims"), "vector", "first", "n"), "classes")
    longest = classes.agg(F.max("dims")).first()[0] or 1
    sample = classes.where(F.col("dims") <= FIT_NUMBERS // 64).select("vector").orderBy(F.xxhash64("vector")).limit(max(64, min(FIT, FIT_NUMBERS // longest))).collect()
    by_dims: dict[int, list] = {}
    for r in sample:
        by_dims.setdefault(len(r.vector), []).append(r.vector)
    units = {d: unit(np.array(rows_, float)) for d, rows_ in by_dims.items()}
    axes = {d: rotation(m) for d, m in units.items()}
    widest = {d: axes[d][:, int(np.argmax((m @ axes[d]).var(axis=0)))] for d, m in units.items()}

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            dims = batch.column("dims").to_numpy()
            at = np.full(len(dims), BINS // 2, np.int32)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                if d in widest:
                    m = np.array(batch.column("vector").take(pa.array(own)).to_pylist(), float)
                    at[own] = np.clip(np.floor((unit(m) @ widest[d] + 1) / 2 * BINS), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "bin"])

    schema = classes.select("cid", "label", "dims", "vector", "n").schema.add("bin", "integer")
    binned = written(classes.select("cid", "label", "dims", "vector", "n").mapInArrow(placed, schema), "binned")
    reach = int(np.ceil(np.sqrt(max(0.0, 2 - 2 * threshold)) / 2 * BINS)) + 1
    bins = binned.groupBy("label", "dims", "bin").agg(F.count(F.lit(1)).alias("m"))
    along = Window.partitionBy("label", "dims").orderBy("bin")  # at most BINS rows a group
    before = F.coalesce(F.sum("m").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("low", F.floor(before / F.lit(block)).cast("int")).withColumn("deal", F.ceil(F.col("m") / F.lit(block)).cast("int"))
    near = along.rangeBetween(-reach, reach)
    bins = bins.withColumn("least", F.min("low").over(near)).withColumn("most", F.max(F.col("low") + F.col("deal") - 1).over(near)).drop("m")
    tiled = binned.join(bins, ["label", "dims", "bin"]).withColumn("own", F.col("low") + F.pmod(F.xxhash64("cid"), F.col("deal")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence("least", "most")))
    tiled = tiled.select("label", "dims", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), "own", "cid", "n", "vector")

    def compare(key, batch):
        import pyarrow as pa

        _, dims, ti, tj = (k.as_py() for k in key)
        cid, n, own = (batch.column(c).to_numpy() for c in ("cid", "n", "own"))
        m = batch.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dims) if len(cid) else np.zeros((0, dims))
        order = np.argsort(cid, kind="stable")
        cid, n, own, m = cid[order], n[order], own[order], m[order]
        a = np.flatnonzero(own == ti)
        b = a if ti == tj else np.flatnonzero(own == tj)
        i, j = linked(m[a], m[b], axes.get(dims), threshold, ti == tj) if len(a) and len(b) else (a[:0], a[:0])
        i, j = a[i], b[j]
        links = np.bincount(i, n[j], len(cid)).astype(np.int64) + np.bincount(j, n[i], len(cid)).astype(np.int64)
        sets = Sets(len(cid))
        for x, y in zip(i.tolist(), j.tolist()):
            sets.join(x, y)
        has = np.flatnonzero(links)
        return pa.table({"cid": cid[has], "links": links[has], "to": cid[sets.roots()[has]] if len(has) else cid[:0]})

    links = written(tiled.groupBy("label", "dims", "ti", "tj").applyInArrow(compare, "cid long, links long, to long"), "tiles")
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    comps = written(components(links.select(F.col("cid").alias("a"), F.col("to").alias("b"))), "components")
    named = classes.join(comps, classes.cid == comps.node, "left").join(counts, "cid", "left").select("label", "vector", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("label", "vector", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = rows.where("fit").join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


#: The links by brute force, in DuckDB's SQL, for tests on small tables: (a, b) pairs.
PAIRS_SQL = """
SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {threshold}
"""
