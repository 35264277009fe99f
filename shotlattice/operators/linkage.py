"""Groupings that depend on the order of merges, without a matrix of a group: pairs that may merge are found in tiles of two blocks, and only those go to the step that merges.

A tile is a task's; what it holds does not grow with a group. The merging step holds a group's pairs over the floor, as numbers.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

c = F.col
#: Rows of a block, about.
BLOCK = 2048
#: Names that two blocks are compared by at once.
NAMES = 4096


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by ``keys`` in which null equals null; the keys come from the left."""
    other = right.withColumnsRenamed({k: f"{k}__" for k in keys})
    found = left.join(other, reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"{k}__")) for k in keys]), how)
    return found if how in ("left_semi", "left_anti") else found.drop(*[f"{k}__" for k in keys])


def tiles(left: DataFrame, right: DataFrame | None, keys: list[str], id_: str, size: int = BLOCK) -> DataFrame:
    """The rows of every tile (keys, i, j): block i of ``left`` beside block j of ``right``, told apart by ``side`` (0, 1). Without ``right``, blocks of ``left`` beside one another, i <= j; where i = j the rows are there once, as side 0."""

    def blocks(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("n_"))

    def dealt(df: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
        both = null_safe(null_safe(df, F.broadcast(own), keys), F.broadcast(other.withColumnRenamed("n_", "m_")), keys)  # a row a group
        return both.withColumn("own_", F.pmod(F.xxhash64(id_), c("n_")).cast("int")).withColumn("other_", F.explode(F.sequence(F.lit(0), c("m_") - 1))).drop("n_", "m_")

    n = blocks(left)
    if right is None:
        lo, hi = F.least("own_", "other_"), F.greatest("own_", "other_")
        return dealt(left, n, n).select(lo.alias("i"), hi.alias("j"), F.when((lo != hi) & (c("own_") == hi), 1).otherwise(0).alias("side"), *left.columns)
    m = blocks(right)
    return dealt(left, n, m).select(c("own_").alias("i"), c("other_").alias("j"), F.lit(0).alias("side"), *left.columns).unionByName(dealt(right, m, n).select(c("other_").alias("i"), c("own_").alias("j"), F.lit(1).alias("side"), *right.columns), allowMissingColumns=True)


def sides(g: pd.DataFrame, id_: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The two blocks of a tile, in order of ids; one block twice where it meets itself."""
    a, b = (g[g["side"] == k].sort_values(id_).reset_index(drop=True) for k in (0, 1))
    return a, a if not len(b) and (g["i"].iloc[0] == g["j"].iloc[0]) else b


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """A row a vector; NaN where there is none."""
    return np.array([np.full(width, np.nan) if v is None else np.asarray(v, float) for v in column]).reshape(len(column), width)


def width(*columns: pd.Series) -> int:
    return max((len(v) for s in columns for v in s if v is not None), default=1)


def meeting(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Which rows of one column of lists have a value in common with which of another; so many values at once that matrices stay small."""
    flat = [np.concatenate([np.asarray(v) for v in s if v is not None and len(v)] or [np.array([], np.int64)]) for s in (a, b)]
    at = [np.repeat(np.arange(len(s)), [0 if v is None else len(v) for v in s]) for s in (a, b)]
    out = np.zeros((len(a), len(b)), bool)
    names = np.intersect1d(*flat)
    places = [np.searchsorted(names, f) for f in flat]
    known = [np.flatnonzero((p < len(names)) & (names[np.minimum(p, len(names) - 1)] == f)) if len(names) else np.array([], int) for p, f in zip(places, flat)]
    for k in range(0, len(names), NAMES):
        m = []
        for s, p, on, rows in zip((a, b), places, known, at):
            near = on[(p[on] >= k) & (p[on] < k + NAMES)]
            x = np.zeros((len(s), min(NAMES, len(names) - k)), np.float32)
            x[rows[near], p[near] - k] = 1
            m.append(x)
        out |= (m[0] @ m[1].T) > 0
    return out


def cliques(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, the least name of each one's group): pairs (a, b), in the order in which they are tried, merge their groups if every pair across is among the pairs.

    Each group knows whom all its members are paired with, so no matrix is held.
    """
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)].astype(np.int32), at[len(a) :].astype(np.int32)
    ends, others = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((others, ends))
    others = others[order]
    starts = np.searchsorted(ends[order], np.arange(len(names) + 1))
    del ends, order
    of = list(range(len(names)))
    members: dict[int, list[int]] = {}
    common: dict[int, np.ndarray] = {}
    near = lambda x: common[x] if x in common else others[starts[x] : starts[x + 1]]
    for k in range(0, len(i), 1 << 16):
        for p, q in zip(i[k : k + (1 << 16)].tolist(), j[k : k + (1 << 16)].tolist()):
            x, y = of[p], of[q]
            if x == y:
                continue
            x, y = min(x, y), max(x, y)
            own, new = members.get(x, [x]), members.get(y, [y])
            if len(own) + len(new) > 2:
                all_ = near(x)
                place = np.searchsorted(all_, new)
                if place.max() >= len(all_) or (all_[place] != new).any():
                    continue
            common[x] = np.intersect1d(near(x), near(y), assume_unique=True)
            common.pop(y, None)
            members.pop(y, None)
            members[x] = own + new
            for z in new:
                of[z] = x
    return names, names[of] if len(names) else names
