"""The score of a collection in blocks: items carry dense vectors, pairs of blocks are scored as matrices, and pairs are never stored.

A collection's distances grow with its square whatever is done; here a task holds two blocks and their matrices, scores need no join of pairs with pairs, and neighbours keep
``k`` rows an item and block. What calibration and imputation need of all pairs is a quantile and a mean a field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.chance import uniform
from ..sources.stored import stored
from .numbering import reserved

c = F.col
#: Items of a block; labels that a dense vector may have; bins by which a quantile is found.
SIZE, VOCABULARY, BINS = 256, 4096, 4096
#: Blocks that are dealt together at most, and lots of blocks that there are before they are: an item is sent to every lot, not to every block.
TOGETHER, LOTS = 16, 16
MEASURES = ("raw", "calibrated", "imputed")


def dense(labels: DataFrame, item: str, label: str, value: str) -> DataFrame:
    """(item, v): each item's values as an array over all labels in order. For closed vocabularies: more than ``VOCABULARY`` labels are an error."""
    names = [r[0] for r in labels.select(label).where(c(label).isNotNull()).distinct().orderBy(label).limit(VOCABULARY + 1).collect()]
    if len(names) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} labels: use the joins of operators.distance")
    own = labels.groupBy(item).agg(F.map_from_entries(F.collect_list(F.when(c(label).isNotNull(), F.struct(label, c(value).cast("double"))))).alias("m"))
    all_ = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return own.select(item, F.transform(all_, lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0.0))).alias("v"))


def _distance(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of two blocks; NaN where a value is missing."""
    if kind in ("share", "scalar"):
        return np.abs(x[:, None] - y)
    lacks = np.isnan(x[:, 0])[:, None] | np.isnan(y[:, 0])
    if kind == "mix":  # sqrt(1 - sum sqrt(p q))
        d = np.sqrt(np.maximum(0, 1 - np.sqrt(x) @ np.sqrt(y).T))
    elif kind == "small mix":  # the same, label by label: equal rows give equal bits in every tile
        root = np.zeros((len(x), len(y)))
        for p, q in zip(np.sqrt(x).T, np.sqrt(y).T):
            root += p[:, None] * q
        d = np.sqrt(np.maximum(0, 1 - root))
    elif kind == "set":
        d = np.empty((len(x), len(y)))
        for i, row in enumerate(x):
            low, high = np.minimum(row, y).sum(axis=1), np.maximum(row, y).sum(axis=1)
            d[i] = np.divide(high - low, high, out=np.full(len(y), np.nan), where=high > 0)
    elif kind.startswith("histogram"):  # mean over the channels that both have; the widths of channels follow the name
        edges = np.cumsum([0, *map(int, kind.split(":")[1].split(","))])
        each = []
        for a, b in zip(edges, edges[1:]):
            p, q = x[:, a:b], y[:, a:b]
            m = np.sqrt(np.maximum(0, 1 - np.sqrt(p) @ np.sqrt(q).T))
            m[(np.nansum(p, axis=1) == 0)[:, None] | (np.nansum(q, axis=1) == 0)] = np.nan
            each.append(m)
        n = np.sum([~np.isnan(m) for m in each], axis=0)
        d = np.divide(np.nansum(each, axis=0), n, out=np.full((len(x), len(y)), np.nan), where=n > 0)
    elif kind == "samples":
        d = np.array([np.abs(row - y).mean(axis=1) for row in x]).reshape(len(x), len(y))
    else:
        raise ValueError(kind)
    d[lacks] = np.nan
    return d


def _matrices(g: pd.DataFrame, specs):
    """Items of both sides, which pairs count (each once), and the raw matrix of each field."""
    g = g.sort_values("item")
    i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
    a, b = g[g["own"] == i], g[g["own"] == j]
    names = a["item"].to_numpy(), b["item"].to_numpy()
    once = names[0][:, None] < names[1] if i == j else np.ones((len(a), len(b)), bool)
    raw = {}
    for f, _, _, kind in specs:
        if kind in ("share", "scalar"):
            x, y = (s[f].to_numpy(float) for s in (a, b))
        else:
            width = max((len(v) for v in g[f] if v is not None), default=1)
            x, y = (np.array([np.full(width, np.nan) if v is None else np.asarray(v, float) for v in s[f]]).reshape(len(s), width) for s in (a, b))
        raw[f] = _distance(kind, x, y), np.isnan(x if x.ndim == 1 else x[:, 0])[:, None] ^ np.isnan(y if y.ndim == 1 else y[:, 0])
    return names, once, raw


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` least of each row, the first of equal ones, without those that are infinite."""
    most = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
    row, col = np.nonzero((d <= most[:, None]) & (d < np.inf))
    order = np.lexsort((col, d[row, col], row))
    row, col = row[order], col[order]
    start = np.flatnonzero(np.diff(row, prepend=-1))
    ok = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row)))) < k
    return row[ok], col[ok]


def _blockwise(run, few=None):
    """``run`` on every pair of blocks of two lots (``block``: an item's in its lot), a pair of blocks at a time; with ``few``, of a lot's pairs together, results are cut by it as they come."""

    def over(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(groups))
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        first, second = ([x for _, x in g[g["own"] == lot].groupby("block")] for lot in (i, j))
        kept = None
        for n, a in enumerate(first):
            for m, b in enumerate(second):
                if i == j and m < n:
                    continue
                one = i == j and m == n
                found = run(a.assign(i=0, j=0, own=0) if one else pd.concat([a.assign(own=0), b.assign(own=1)]).assign(i=0, j=1))
                if few is None:
                    yield found
                else:
                    kept = few(found if kept is None else pd.concat([kept, found]))
        if kept is not None:
            yield kept

    return over


def _lots(items: DataFrame, block: Column, blocks: int) -> DataFrame:
    """(i, j, own, block, ...): ``items`` by pairs of lots of blocks, a row an item and lot."""
    together = min(max(blocks // LOTS, 1), TOGETHER)
    dealt = items.withColumn("own", (block / together).cast("int")).withColumn("block", block % together).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // together))))
    return dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "block", *items.columns)


def pairwise(labels: DataFrame, value: str, kind: str, item: str = "item", label: str = "label", size: int = SIZE) -> DataFrame:
    """(a, b, raw) of every pair a < b of items by their labels (one row an item and label): ``mix`` is the Hellinger distance of shares, ``set`` the weighted Jaccard distance, null for two items without weight.

    For closed vocabularies, see ``dense``: items are vectors, sent to every lot of blocks; a task scores a pair of blocks at a time as one matrix, and no label is joined, however many items have it.
    """
    items = stored(dense(labels, item, label, value).select(c(item).alias("item"), "v"), "vectors")
    blocks = max(1, -(-items.count() // size))
    lots = _lots(items, F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"), blocks)
    specs = [("v", "", "", kind)]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        (a, b), once, raw = _matrices(g, specs)
        i, j = np.nonzero(once)
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "raw": raw["v"][0][i, j]})

    named = dict(items.dtypes)["item"]
    return lots.groupBy("i", "j").applyInPandas(_blockwise(run), f"a {named}, b {named}, raw double").withColumn("raw", F.nanvl("raw", F.lit(None).cast("double")))


def differences(items: DataFrame, value: str, item: str = "item", size: int = 1024) -> DataFrame:
    """(a, b, raw) of every pair a < b of items (one row each): the distance of their values, null if either is. Items without a name are in no pair.

    Items are dealt into blocks along their values, a pair of blocks is a row, and a task takes its rows apart one by one, so neither side is held whole by anyone. In a result written as it comes an
    item stands in one run before the others of a block, which come in the same order each time, and equal distances stand together; files hold those in few bytes.
    """
    known = items.select(c(item).alias("item"), c(value).alias("x")).where("item is not null")
    placed = stored(reserved(known, ["x", "item"], {"item": F.lit(True)}), "places")
    n = placed.count()
    side = min(size, -(-n // 32)) or 1
    blocks = max(1, -(-n // side))
    own = (c("item_place") / side).cast("int").alias("own")
    block = placed.groupBy(own).agg(F.array_sort(F.collect_list(F.struct("x", c("item").alias("p")))).alias("first"), F.array_sort(F.collect_list(F.struct(c("item").alias("q"), c("x").alias("y")))).alias("second"))
    first = block.select(c("own").alias("i"), F.explode(F.sequence("own", F.lit(blocks - 1))).alias("j"), "first")
    second = block.select(F.explode(F.sequence(F.lit(0), "own")).alias("i"), c("own").alias("j"), "second")
    parts = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * (blocks + 1) // 16)
    tiles = first.repartition(parts, "i", "j").hint("merge").join(second.repartition(parts, "i", "j"), ["i", "j"])
    tiles = tiles.select("i", "j", F.inline("first"), "second").select("i", "j", "x", "p", F.inline("second")).where("i < j or p < q")
    return tiles.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.abs(c("x") - c("y")).alias("raw"))


def _calibrated(m: np.ndarray, top: float | None) -> np.ndarray:
    return np.minimum(m / top, 1) if top else m


def _tree(g: pd.DataFrame, specs, scale):
    """Names, which pairs count, and the matrices of every group, level and the whole; NaN where nothing was measured."""
    top, mean = scale
    names, once, raw = _matrices(g, specs)
    groups: dict[tuple, list] = {}
    for f, level, group, _ in specs:
        m, one = raw[f]
        m = _calibrated(m, top.get(f))
        if mean.get(f) is not None:
            m = np.where(np.isnan(m) & one, mean[f], m)
        groups.setdefault((level, group), []).append(m)

    def average(ms):
        n = np.sum([~np.isnan(m) for m in ms], axis=0)
        return np.divide(np.nansum(ms, axis=0), n, out=np.full(ms[0].shape, np.nan), where=n > 0)

    out = {k: average(ms) for k, ms in groups.items()}
    levels: dict[str, list] = {}
    for (level, _), m in out.items():
        levels.setdefault(level, []).append(m)
    out |= {(level, None): average(ms) for level, ms in levels.items()}
    out[(None, None)] = average([out[(level, None)] for level in levels])
    return names, once, out


def _fields(g: pd.DataFrame, specs, scale):
    """Names, which pairs count, and of each field the raw, calibrated and imputed matrix."""
    top, mean = scale
    names, once, raw = _matrices(g, specs)
    out = {}
    for f, (m, one) in raw.items():
        calibrated = _calibrated(m, top.get(f))
        out[f] = m, calibrated, calibrated if mean.get(f) is None else np.where(np.isnan(calibrated) & one, mean[f], calibrated)
    return names, once, out


class Collection:
    """``items``: item and one column a field, a number or a dense array, null where it has none. ``specs``: (field, level, group, kind). ``calibrated``: the kinds that are; all if absent."""

    def __init__(self, items: DataFrame, specs: list[tuple[str, str, str, str]], size: int = SIZE, calibrated: tuple[str, ...] | None = None):
        self.specs = specs
        self.free = {f for f, _, _, k in specs if calibrated is not None and k not in calibrated}
        self.kind = dict(items.dtypes)["item"]
        fields = [c(f).cast("array<double>" if k not in ("share", "scalar") else "double").alias(f) for f, _, _, k in specs]
        self.items = stored(items.select("item", *fields), "collection")  # every pass over the tiles starts from the vectors, not from what they were made of
        blocks = max(1, -(-self.items.count() // size))
        self.blocks = blocks
        block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
        dealt = self.items.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        self.tiles = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "item", *[f for f, *_ in specs])
        self.lots = _lots(self.items, block, blocks)
        self._scale: tuple[dict, dict] | None = None

    def _over(self, run, schema: str, few=None, lots: DataFrame | None = None) -> DataFrame:
        """``run`` on every pair of blocks."""
        return (self.lots if lots is None else lots).groupBy("i", "j").applyInPandas(_blockwise(run, few), schema)

    def _spans(self) -> dict[str, float]:
        """No distance of a field is larger than this."""
        most = []
        for f, _, _, kind in self.specs:
            if kind in ("share", "scalar"):
                most.append((F.max(f) - F.min(f)).alias(f))
            elif kind == "samples":
                most.append((F.max(F.array_max(f)) - F.min(F.array_min(f))).alias(f))
            else:
                most.append(F.lit(1.0).alias(f))
        found = self.items.agg(*most).first()
        return {f: float(found[f] or 0.0) for f, *_ in self.specs}

    def quantiles(self, q: float = 0.9) -> dict[str, float]:
        """Each field's quantile of all measured distances, linear between neighbours; distances are counted and summed by bins, then only those of the bins that hold it are looked at."""
        return self._measured(q)[0]

    def _measured(self, q: float) -> tuple[dict[str, float], dict[str, float]]:
        """The quantiles, and the means of the distances over them, 1 at most, from the same two passes."""
        specs, spans = self.specs, self._spans()

        def binned(m, f):
            return np.minimum((m / (spans[f] or 1.0) * BINS).astype(np.int64), BINS - 1)

        def counted(g: pd.DataFrame) -> pd.DataFrame:
            _, once, raw = _matrices(g, specs)
            out = []
            for f, (m, _) in raw.items():
                v = m[once & ~np.isnan(m)]
                bins = binned(v, f)
                n, total = np.bincount(bins, minlength=1), np.bincount(bins, v, minlength=1)
                at = np.flatnonzero(n)
                out.append(pd.DataFrame({"field": f, "bin": at, "n": n[at], "total": total[at]}))
            return pd.concat(out)

        counts = self._over(counted, "field string, bin long, n long, total double", lambda x: x.groupby(["field", "bin"], as_index=False).sum()).groupBy("field", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()  # at most BINS rows a field
        wanted = {}
        for f, own in counts.groupby("field"):
            own = own.sort_values("bin")
            upto, total = own["n"].cumsum().to_numpy(), int(own["n"].sum())
            at = q * (total - 1)
            ranks = int(np.floor(at)), int(np.ceil(at))
            places = [int(np.searchsorted(upto, r, "right")) for r in ranks]
            bins = own["bin"].to_numpy()[places]
            wanted[f] = (ranks, at, set(bins.tolist()), int(upto[places[0]] - own["n"].to_numpy()[places[0]]))
        if not wanted:
            return {}, {}
        which = {f: w[2] for f, w in wanted.items()}

        def near(g: pd.DataFrame) -> pd.DataFrame:
            _, once, raw = _matrices(g, specs)
            out = [pd.DataFrame({"field": pd.Series([], dtype=str), "raw": pd.Series([], dtype=float), "n": pd.Series([], dtype=int)})]
            for f in which:
                v = raw[f][0][once & ~np.isnan(raw[f][0])]
                bins = binned(v, f)
                v, n = np.unique(v[np.any([bins == x for x in which[f]], axis=0)], return_counts=True)  # two bins at most
                out.append(pd.DataFrame({"field": f, "raw": v, "n": n}))
            return pd.concat(out)

        exact = stored(self._over(near, "field string, raw double, n long").groupBy("field", "raw").agg(F.sum("n").alias("n")), "collection-values")
        values = exact
        upto = F.sum("n").over(Window.partitionBy("field").orderBy("raw"))
        ranks = F.create_map(*[F.lit(x) for f, w in wanted.items() for x in (f, w[3])])
        values = values.withColumn("past", upto + ranks[c("field")]).withColumn("from", c("past") - c("n"))
        hit = F.lit(False)
        for f, (rs, *_) in wanted.items():
            for r in rs:
                hit = hit | ((c("field") == f) & (c("from") <= r) & (c("past") > r))
        found = values.where(hit).collect()  # two rows a field
        out = {}
        for f, (rs, at, *_) in wanted.items():
            low, high = (next(x.raw for x in found if x.field == f and x["from"] <= r < x.past) for r in rs)
            out[f] = low + (high - low) * (at - rs[0])
        over = {f: 1.0 if f in self.free else (out[f] or 1.0) for f in out}
        capped = {f: np.inf if f in self.free or not out[f] else 1.0 for f in out}
        divided = c("raw") / F.create_map(*[F.lit(x) for f, t in over.items() for x in (f, float(t))])[c("field")]
        edge = {r.field: r.total for r in exact.groupBy("field").agg(F.sum(F.least(divided, F.create_map(*[F.lit(x) for f, t in capped.items() for x in (f, float(t))])[c("field")]) * c("n")).alias("total")).collect()}  # one row a field
        means = {}
        for f, own in counts.groupby("field"):
            bins, n, total = own["bin"].to_numpy(), own["n"].to_numpy(), own["total"].to_numpy()
            inside = np.isin(bins, list(which[f]))
            high = (bins > max(which[f])) & ~inside
            above = float(n[high].sum()) if np.isfinite(capped[f]) else float(total[high].sum() / over[f])
            means[f] = (float(total[~high & ~inside].sum() / over[f]) + above + edge.get(f, 0.0)) / float(n.sum())
        return out, means

    def scale(self) -> tuple[dict[str, float], dict[str, float]]:
        """Each field's 0.9 quantile of the measured distances, and the mean of the calibrated ones."""
        if self._scale is None:
            top, means = self._measured(0.9)
            self._scale = {f: q for f, q in top.items() if f not in self.free}, means
        return self._scale

    def pairs(self, only: list | None = None) -> DataFrame:
        """(field, level, grp, a, b, raw, calibrated, imputed) of every pair a < b and field, null where nothing was measured; with ``only`` of the pairs among these few items, by the scale of all."""
        scale, specs = self.scale(), self.specs
        lots = self.lots
        if only is not None:
            zero = F.lit(0)
            lots = self.items.where(c("item").isin(only)).select(zero.alias("i"), zero.alias("j"), zero.alias("own"), zero.alias("block"), "item", *[f for f, *_ in specs])

        def run(g: pd.DataFrame) -> pd.DataFrame:
            (a, b), once, found = _fields(g, specs, scale)
            i, j = np.nonzero(once)
            low, high = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
            return pd.concat([pd.DataFrame({"field": f, "level": level, "grp": group, "a": low, "b": high, **dict(zip(MEASURES, (m[i, j] for m in found[f])))}) for f, level, group, _ in specs])

        rows = self._over(run, f"field string, level string, grp string, a {self.kind}, b {self.kind}, raw double, calibrated double, imputed double", lots=lots)
        return rows.withColumns({m: F.nanvl(m, F.lit(None).cast("double")) for m in MEASURES})

    def _with(self, members: DataFrame) -> DataFrame:
        return self.lots.join(members.select("item", c("cluster").cast("long").alias("cluster_")), "item")

    def held_by(self, members: DataFrame, top: int = 3) -> DataFrame:
        """As ``distance.held_by`` of the imputed distances; a task sends sums by field and clusters. ``members``: item, cluster."""
        scale, specs = self.scale(), self.specs

        def run(g: pd.DataFrame) -> pd.DataFrame:
            (a, b), once, found = _fields(g, specs, scale)
            of = g.drop_duplicates("item").set_index("item")["cluster_"]
            ca, cb = of.loc[a].to_numpy(), of.loc[b].to_numpy()
            out = []
            for f, (_, _, m) in found.items():
                for x in np.unique(ca):
                    for y in np.unique(cb):
                        v = m[np.ix_(ca == x, cb == y)]
                        v = v[once[np.ix_(ca == x, cb == y)] & ~np.isnan(v)]
                        out += [(f, int(z), x == y, float(v.sum()), len(v)) for z in {x, y} if len(v)]
            return pd.DataFrame(out, columns=["field", "cluster", "own", "total", "n"])

        sums = self._over(run, "field string, cluster long, own boolean, total double, n long", lots=self._with(members))
        mean = lambda own: F.try_divide(F.sum(F.when(own, c("total"))), F.sum(F.when(own, c("n"))))
        gap = sums.groupBy("cluster", "field").agg((mean(~c("own")) - mean(c("own"))).alias("gap")).where("gap is not null")
        order = Window.partitionBy("cluster").orderBy(c("gap").desc(), "field")  # the fields of a cluster
        return gap.withColumn("cluster", c("cluster").cast(dict(members.dtypes)["cluster"])).withColumn("rank", F.row_number().over(order)).where(c("rank") <= top)

    def to_clusters(self, members: DataFrame, field: str) -> DataFrame:
        """(item, own, cluster, d): each item's mean imputed distance in one field to the others of every cluster; a task sends a row an item and cluster."""
        scale, specs = self.scale(), self.specs

        def run(g: pd.DataFrame) -> pd.DataFrame:
            (a, b), once, found = _fields(g, specs, scale)
            of = g.drop_duplicates("item").set_index("item")["cluster_"]
            m = found[field][2]
            ok = once & ~np.isnan(m)
            m = np.where(ok, m, 0.0)
            out = []
            for own, others, d, k in ((a, b, m, ok), (b, a, m.T, ok.T)):
                to = of.loc[others].to_numpy()
                for x in np.unique(to):
                    out.append(pd.DataFrame({"item": own, "own": of.loc[own].to_numpy(), "cluster": x, "total": d[:, to == x].sum(axis=1), "n": k[:, to == x].sum(axis=1)}))
            out = pd.concat(out) if out else pd.DataFrame({"item": a[:0], "own": [], "cluster": [], "total": [], "n": []})
            return out[out["n"] > 0]

        sums = self._over(run, f"item {self.kind}, own long, cluster long, total double, n long", lots=self._with(members))
        return sums.groupBy("item", "own", "cluster").agg((F.sum("total") / F.sum("n")).alias("d"))

    def whole(self) -> DataFrame:
        """(a, b, score): the topmost scores of ``tree`` alone."""
        scale, specs = self.scale(), self.specs

        def run(g: pd.DataFrame) -> pd.DataFrame:
            (a, b), once, out = _tree(g, specs, scale)
            i, j = np.nonzero(once)
            return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "score": out[(None, None)][i, j]})

        return self._over(run, f"a {self.kind}, b {self.kind}, score double").withColumn("score", F.nanvl("score", F.lit(None).cast("double")))

    def tree(self) -> DataFrame:
        """(a, b, level, grp, score) of every pair a < b: groups, levels (grp null) and the whole (level null too), missing ones null."""
        scale, specs = self.scale(), self.specs

        def run(g: pd.DataFrame) -> pd.DataFrame:
            (a, b), once, out = _tree(g, specs, scale)
            i, j = np.nonzero(once)
            low, high = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
            parts = [pd.DataFrame({"a": low, "b": high, "level": level, "grp": group, "score": m[i, j]}) for (level, group), m in out.items()]
            return pd.concat([p for p in parts if len(p)] or parts[:1])

        return self._over(run, f"a {self.kind}, b {self.kind}, level string, grp string, score double").withColumn("score", F.nanvl("score", F.lit(None).cast("double")))

    def nearest(self, k: int = 5) -> DataFrame:
        """(item, other, score, rank): the ``k`` nearest by the whole score, then by name; of a pair of lots no more than ``k`` an item go on."""
        scale, specs = self.scale(), self.specs

        def run(g: pd.DataFrame) -> pd.DataFrame:
            (a, b), _, out = _tree(g, specs, scale)
            m = out[(None, None)]
            same = int(g["i"].iloc[0]) == int(g["j"].iloc[0])
            found = []
            for own, others, d in ((a, b, m),) if same else ((a, b, m), (b, a, m.T)):
                d = d.copy()
                if same:
                    np.fill_diagonal(d, np.nan)
                row, col = _least(np.where(np.isnan(d), np.inf, np.round(d, 12)), k)  # blocks are in order of names
                found.append(pd.DataFrame({"item": own[row], "other": others[col], "score": d[row, col]}))
            return pd.concat(found)

        def few(found: pd.DataFrame) -> pd.DataFrame:
            at = found.assign(at=found["score"].round(12)).sort_values(["item", "at", "other"])
            return at.groupby("item").head(k).drop(columns="at")

        near = self._over(run, f"item {self.kind}, other {self.kind}, score double", few)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.round("score", 12), "other"))
        return near.withColumn("rank", rank).where(c("rank") <= k)

    def stability(self, draws: int = 20, top: int = 5, seed: int = 0) -> DataFrame:
        """As ``assess.stability`` of the imputed distances, to twelve places.

        An item's ``top`` nearest bound its distances in every draw, so a second pass sends only pairs within one of the bounds, with their fields; these few are weighed and ranked.
        """
        scale, specs = self.scale(), self.specs
        fields = [f for f, *_ in specs]
        columns = [f"f{n}" for n in range(len(fields))]
        drawn = self.items.sparkSession.range(1, draws + 1).select(c("id").cast("int").alias("draw"))
        drawn = drawn.select("draw", *[F.exp(2 * uniform(seed, "draw", F.lit(f)) - 1).alias(x) for f, x in zip(fields, columns)]).orderBy("draw").collect()  # a row a draw
        weights = np.array([[1.0] * len(fields), *[[r[x] for x in columns] for r in drawn]])

        def weighed(g: pd.DataFrame, weights: np.ndarray):
            """Names, the fields' matrices, and a matrix of distances for each of the weights; NaN for what is no pair."""
            (a, b), _, found = _fields(g, specs, scale)
            m = np.stack([found[f][2] for f in fields])
            lacks = np.isnan(m)
            with np.errstate(invalid="ignore"):
                d = np.tensordot(weights, np.where(lacks, 0.0, m), 1) / np.tensordot(weights, (~lacks).astype(float), 1)
            same = int(g["i"].iloc[0]) == int(g["j"].iloc[0])
            if same:
                d[:, np.arange(len(a)), np.arange(len(a))] = np.nan
            return ((a, b, m, d),) if same else ((a, b, m, d), (b, a, m.transpose(0, 2, 1), d.transpose(0, 2, 1)))

        def rows(own, others, m, i, j) -> pd.DataFrame:
            return pd.DataFrame({"item": own[i], "other": others[j], **{x: v[i, j] for x, v in zip(columns, m)}})

        def nearest(g: pd.DataFrame) -> pd.DataFrame:
            found = []
            for own, others, m, (d,) in weighed(g, weights[:1]):
                i, j = _least(np.where(np.isnan(d), np.inf, np.round(d, 12)), top)
                found.append(rows(own, others, m, i, j).assign(at=np.round(d[i, j], 12)))
            return pd.concat(found)

        def few(found: pd.DataFrame) -> pd.DataFrame:
            return found.sort_values(["item", "at", "other"]).groupby("item").head(top)

        values = f"item {self.kind}, other {self.kind}, " + ", ".join(f"{x} double" for x in columns)
        near = self._over(nearest, f"{values}, at double", few)
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("at", "other"))).where(c("rank") <= top)

        def by(ws) -> Column:
            """A pair's distance by these weights of its fields."""
            known = [(F.nanvl(x, F.lit(None).cast("double")), w) for x, w in zip(columns, ws)]
            return sum(F.coalesce(x * w, F.lit(0.0)) for x, w in known) / sum(F.when(x.isNotNull(), w).otherwise(F.lit(0.0)) for x, w in known)

        most = F.array(*[F.max(by([F.lit(float(w)) for w in ws])) for ws in weights])
        limits = stored(near.groupBy("item").agg(F.when(F.count(F.lit(1)) == top, most).alias("most")), "stability-limits")

        def within(g: pd.DataFrame) -> pd.DataFrame:
            of = g.drop_duplicates("item").set_index("item")["most"]
            out = []
            for own, others, m, d in weighed(g, weights):
                most = np.array([np.full(len(weights), np.inf) if x is None else np.asarray(x, float) for x in of.loc[own]]).T
                # the same pair's distance may differ by the root of a last bit from tile to tile
                i, j = np.nonzero((d <= (most + 1e-6 * (1 + most))[:, :, None]).any(axis=0))
                out.append(rows(own, others, m, i, j))
            return pd.concat(out)

        pairs = stored(self._over(within, values, lots=self.lots.join(limits, "item", "left")), "stability-pairs")
        ranked = lambda df, *key: df.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "item").orderBy("at", "other"))).where(c("rank") <= top)
        own = ranked(pairs.withColumn("at", F.round(by([F.lit(1.0)] * len(fields)), 12))).select("item", "other")
        each = pairs.withColumn("w", F.explode(F.array(*[F.struct(F.lit(n).alias("draw"), *[F.lit(float(w)).alias(x) for x, w in zip(columns, ws)]) for n, ws in enumerate(weights) if n])))
        each = ranked(each.select("item", "other", c("w.draw").alias("draw"), F.round(by([c(f"w.{x}") for x in columns]), 12).alias("at")), "draw")
        size = own.groupBy("item").agg(F.count(F.lit(1)).alias("k"))
        kept = each.join(own, ["item", "other"]).groupBy("item").agg(F.count(F.lit(1)).alias("c"))
        return size.join(kept, "item", "left").select("item", (F.coalesce("c", F.lit(0)) / (c("k") * draws)).alias("overlap"))
