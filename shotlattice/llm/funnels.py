"""Ordered funnel counting: attempts of clients along chains of events, with exact percentiles of the times between steps.

Rows are dealt by range of (client, time) into lots of about ``LOT_ROWS``; a client with many rows simply has many lots. In a lot every distinct (client, time) is a whole number in that order, each
kind of event is a sorted int64 array of those numbers, and a step of all attempts at once is one ``searchsorted(side="right")`` into the next kind's array, an exclusion one into the excluded kind's.

A chain that runs past the end of its lot needs no rows of other lots:

* Its next step is the first row of that kind in the later lots of the client. Each lot is told those rows, one a kind, beforehand (``_carries``); only rows within the time limit matter, so they
  are looked up by client and cell of time, not by client alone.
* All attempts that leave a lot by one step land on one row, the first of its kind in the lot they come to. What follows from there is computed once with that lot (its ``go`` rows), so leaving
  attempts meet their continuation by a join of tables with a few rows a lot.

Percentiles are selected by ``numpy.partition`` where a client lies in one lot. A client of several lots has a histogram of its times in each, of 64 bins at most; their sum names the bin that holds the
rank, and only the times of that bin leave the lots, where they are counted by value, then by finer bins (8,192 at most), then by value inside one of those: no group grows with the number of attempts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import parts_of, written

#: Four steps and the excluded kind of each funnel.
FUNNELS = {"A": ("view", "click", "view", "purchase", "error"), "B": ("signup", "view", "click", "purchase", "error"), "C": ("click", "click", "purchase", "view", "signup")}
#: Microseconds from one step to the next, at most.
LIMIT = 60 * 60 * 1_000_000
PERCENT = 90
LOT_ROWS = 200_000
#: Bins of a histogram of times, at most.
COARSE = 64


def micros(ts: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a timestamp; of one without a zone by its own calendar, whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        minutes = F.unix_date(ts.cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
        return minutes * 60_000_000 + (F.extract(F.lit("second"), ts) * 1_000_000).cast("long")
    return F.unix_micros(ts.cast("timestamp"))


def _lots(rows: DataFrame, lot_rows: int) -> DataFrame:
    """Distinct rows (client, kind, at) with their lot: ranges of (client, at), about ``lot_rows`` each."""
    rows = written(rows.distinct(), "funnel-rows")
    parts = max(parts_of(rows.sparkSession), -(-rows.count() // lot_rows))
    return written(rows.repartitionByRange(parts, "client", "at").withColumn("lot", F.spark_partition_id()), "funnel-lots")


def _carries(lots: DataFrame, n_kinds: int, limit: int) -> DataFrame:
    """One row per lot: lot, open_left and open_right (its first or last client has rows in other lots too), and by kind the first row (at, lot) of the last client in later lots, where it is near enough to matter."""
    first = [F.min(F.when(F.col("kind") == k, F.struct("client", "at"))).alias(f"k{k}") for k in range(n_kinds)]
    edges = written(lots.groupBy("lot").agg(F.min("client").alias("head"), F.max(F.struct("client", "at")).alias("tail"), *first), "funnel-edges")
    ends = edges.select(F.col("head").alias("client"), F.col("lot").alias("as_head"), F.lit(None).cast("int").alias("as_tail")).unionByName(edges.select(F.col("tail.client").alias("client"), F.lit(None).cast("int").alias("as_head"), F.col("lot").alias("as_tail")))
    ends = ends.groupBy("client").agg(F.max("as_head").alias("last"), F.min("as_tail").alias("first"))
    opened = edges.select("lot", "head", F.col("tail.client").alias("client")).join(ends.select("client", "last"), "client").select("lot", "head", (F.col("last") > F.col("lot")).alias("open_right"))
    opened = opened.join(ends.select(F.col("client").alias("head"), "first"), "head").select("lot", "open_right", (F.col("first") < F.col("lot")).alias("open_left"))

    cell = lambda at: F.floor(at / limit)
    heads = edges.select("lot", "head", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k{k}.client").alias("client"), F.col(f"k{k}.at").alias("at")) for k in range(n_kinds)])).alias("r"))
    heads = heads.where("r.client = head").select("lot", "r.*").withColumn("cell", F.explode(F.array(cell(F.col("at")), cell(F.col("at")) - 1)))
    tails = edges.select("lot", F.lit(-1).alias("kind"), F.col("tail.client").alias("client"), F.col("tail.at").alias("at"), cell(F.col("tail.at")).alias("cell"))
    # downwards by lot, a lot's tail before its heads: what comes before a tail are the heads of later lots
    later = Window.partitionBy("client", "cell").orderBy(F.col("lot").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    near = [F.min(F.when(F.col("kind") == k, F.struct("at", "lot"))).over(later).alias(f"k{k}") for k in range(n_kinds)]
    carried = tails.unionByName(heads).select("lot", "kind", *near).where("kind = -1").drop("kind")
    return opened.join(carried, "lot")


def _shift(limit: int) -> int:
    """Bits by which a time is shifted to its coarse bin."""
    return max(0, int(limit).bit_length() - COARSE.bit_length() + 1)


class _Lot:
    """The rows of one lot as numbers: ``at`` and ``client`` by number, ``kinds`` the sorted numbers of each kind, those from ``n`` on standing for rows of later lots."""

    def __init__(self, rows: pd.DataFrame, carry: pd.DataFrame, n_kinds: int):
        rows = rows.sort_values(["client", "at"], kind="stable")
        client, at, kind = rows["client"].to_numpy(), rows["at"].to_numpy(np.int64), rows["kind"].to_numpy()
        new = np.ones(len(rows), bool)
        new[1:] = client[1:] != client[:-1]
        step = new.copy()
        step[1:] |= at[1:] != at[:-1]
        number = np.cumsum(step) - 1
        self.names = client[new]
        self.n = int(number[-1]) + 1
        self.client, self.at = (np.cumsum(new) - 1)[step], at[step]
        self.kinds = [np.unique(number[kind == k]) for k in range(n_kinds)]
        told = {k: (int(r["at"]), int(r["lot"])) for k in range(n_kinds) if (r := carry[f"k{k}"].iloc[0]) is not None and r["at"] is not None}
        after = sorted(set(told.values()))
        self.to_lot = [lot for _, lot in after]
        for k, r in told.items():
            self.kinds[k] = np.append(self.kinds[k], self.n + after.index(r))
        self.at = np.append(self.at, np.array([a for a, _ in after], np.int64))
        self.client = np.append(self.client, np.full(len(after), self.client[-1]))
        self.kinds = [k.astype(np.int64) for k in self.kinds]

    def next(self, places: np.ndarray, kind: int, excluded: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Where attempts that stand at ``places`` go by their next step, and which of them get there."""

        def following(k: int) -> np.ndarray:
            past = len(self.at)
            return np.append(self.kinds[k], past)[np.searchsorted(self.kinds[k], places, side="right")]

        to = following(kind)
        found = to < len(self.at)
        to = np.where(found, to, 0)
        reached = found & (self.client[to] == self.client[places]) & (self.at[to] - self.at[places] <= limit)
        return to, reached & ~(following(excluded) <= to)


def _run(lot: _Lot, key: int, carry: dict, funnels: dict, limit: int, percent: int):
    """The rows that one lot gives."""
    split = np.zeros(len(lot.names), bool)
    split[0] |= bool(carry["open_left"])
    split[-1] |= bool(carry["open_right"])
    for name, (*kinds, excluded) in funnels.items():
        at = lot.kinds[kinds[0]]
        at = at[at < lot.n]
        counts, times = [np.bincount(lot.client[at], minlength=len(lot.names))], []
        for s in (1, 2, 3):
            to, ok = lot.next(at, kinds[s], excluded, limit)
            whose, took = lot.client[at][ok], (lot.at[to] - lot.at[at])[ok]
            counts.append(np.bincount(whose, minlength=len(lot.names)))
            order = np.argsort(whose, kind="stable")
            times.append(took[order])
            to = to[ok]
            if s < 3:
                gone, n = np.unique(to[to >= lot.n], return_counts=True)
                for g, w in zip(gone.tolist(), n.tolist()):
                    yield {"part": "leave", "funnel": name, "step": s + 1, "lot": lot.to_lot[g - lot.n], "weight": w}
            at = to[to < lot.n]
        begins = [np.concatenate(([0], np.cumsum(c))) for c in counts]
        for c in np.flatnonzero(counts[0]).tolist():
            row = {"part": "sum", "funnel": name, "client": lot.names[c], "split": bool(split[c])}
            for s in range(4):
                n = int(counts[s][c])
                row[f"n{s + 1}"] = n
                if s and n:
                    v = times[s - 1][begins[s][c] : begins[s][c + 1]]
                    if split[c]:
                        row[f"v{s + 1}"], row[f"h{s + 1}"] = v, np.bincount(v >> _shift(limit))
                    else:
                        k = -(-percent * n // 100) - 1
                        row[f"t{s + 1}"] = int(np.partition(v, k)[k])
            yield row
        if carry["open_left"]:  # what becomes of attempts that come in by their second or third step
            for s in (1, 2):
                at = lot.kinds[kinds[s]][:1]
                if len(at) and at[0] < lot.n and lot.client[at[0]] == 0:
                    row = {"part": "go", "funnel": name, "client": lot.names[0], "lot": key, "step": s + 1}
                    to, ok = lot.next(at, kinds[s + 1], excluded, limit)
                    if ok[0]:
                        row["took"] = int(lot.at[to[0]] - lot.at[at[0]])
                        if s == 1 and to[0] >= lot.n:
                            row["to_lot"] = lot.to_lot[to[0] - lot.n]
                        elif s == 1:
                            last, ok = lot.next(to, kinds[3], excluded, limit)
                            if ok[0]:
                                row["then"] = int(lot.at[last[0]] - lot.at[to[0]])
                    yield row


def _chained(lots: DataFrame, carries: DataFrame, funnels: dict, kinds: list[str], limit: int, percent: int) -> DataFrame:
    client = lots.schema["client"].dataType.simpleString()
    schema = f"part string, funnel string, client {client}, split boolean, n1 long, n2 long, n3 long, n4 long, t2 long, t3 long, t4 long, v2 array<long>, v3 array<long>, v4 array<long>, h2 array<long>, h3 array<long>, h4 array<long>, lot int, step int, weight long, took long, to_lot int, then long"
    columns = [f.split()[0] for f in schema.split(", ")]
    coded = {f: [kinds.index(k) for k in ks] for f, ks in funnels.items()}

    def of_lot(rows: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows):
            found = list(_run(_Lot(rows, carry, len(kinds)), int(rows["lot"].iloc[0]), carry.iloc[0].to_dict(), coded, limit, percent))
        out = pd.DataFrame([[r.get(c) for c in columns] for r in found], columns=columns, dtype=object)
        whole = [c for c in columns if c[0] in "nt" and c != "to_lot"] + ["lot", "step", "weight", "to_lot"]
        return out.astype({c: "Int64" for c in whole})

    return lots.groupBy("lot").cogroup(carries.groupBy("lot")).applyInPandas(of_lot, schema)


_KEYS = ["funnel", "client", "step"]


def _ranked(counts: DataFrame, by: str, within: list[str], rank: Column | None, percent: int = 0) -> DataFrame:
    """Of rows (keys, ``by``, n) the one that holds the rank, and the rank inside it. Without ``rank`` it is the percentile of all rows of the keys."""
    upto = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.sum("n").over(upto))
    if rank is None:
        counts, rank = counts.withColumn("all", F.sum("n").over(Window.partitionBy(*within))), F.expr(f"({percent} * `all` + 99) div 100")
    return counts.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select(*within, by, (rank - F.col("upto") + F.col("n")).alias("rank"))


def _selected(split: DataFrame, met: DataFrame, limit: int, percent: int) -> DataFrame:
    """The percentiles of clients of several lots, exact: from their lots' histograms and times (``split``) and the rows (keys, value, n) of attempts that crossed over (``met``).

    The histograms tell the coarse bin, of ``COARSE`` at most; only the times in it are taken out of the lots' arrays, counted by value, narrowed to a finer bin and then to the value.
    """
    shift = _shift(limit)
    counted = met.select(*_KEYS, F.shiftright("value", shift).alias("bin"), "n")
    for s in (2, 3, 4):
        counted = counted.unionByName(split.select("funnel", "client", F.lit(s).alias("step"), F.posexplode(f"h{s}").alias("bin", "n")).where("n > 0").withColumn("bin", F.col("bin").cast("long")))
    coarse = written(_ranked(counted.groupBy(*_KEYS, "bin").agg(F.sum("n").alias("n")), "bin", _KEYS, None, percent), "funnel-bins")
    values = met.join(coarse, _KEYS).where(F.shiftright("value", shift) == F.col("bin")).select(*_KEYS, "rank", "value", "n")
    for s in (2, 3, 4):
        inside = F.filter(f"v{s}", lambda x: F.shiftright(x, shift) == F.col("bin"))
        values = values.unionByName(split.join(coarse.where(f"step = {s}"), ["funnel", "client"]).select(*_KEYS, "rank", F.explode(inside).alias("value"), F.lit(1).cast("long").alias("n")))
    fine = shift // 2
    values = written(values.groupBy(*_KEYS, "rank", "value").agg(F.sum("n").alias("n")).withColumn("bin", F.shiftright("value", fine)), "funnel-times")
    bins = _ranked(values.groupBy(*_KEYS, "rank", "bin").agg(F.sum("n").alias("n")).withColumnRenamed("rank", "of"), "bin", [*_KEYS, "of"], F.col("of")).drop("of")
    found = _ranked(values.drop("rank").join(bins, [*_KEYS, "bin"]).withColumnRenamed("rank", "of"), "value", [*_KEYS, "of"], F.col("of"))
    return found.select("funnel", "client", *[F.when(F.col("step") == s, F.col("value")).alias(f"t{s}") for s in (2, 3, 4)])


def count_funnels(events: DataFrame, funnels: dict = FUNNELS, limit: int = LIMIT, percent: int = PERCENT, lot_rows: int = LOT_ROWS, client_col: str = "client_id", kind_col: str = "kind", ts_col: str = "ts") -> DataFrame:
    """Per funnel and client with attempts: funnel, client_id, n1 to n4, deepest, t2 to t4, same_depth.

    ``funnels`` gives four kinds of steps and an excluded kind each. Every distinct row of the first kind starts an attempt. Its next step is the client's earliest row of the next kind at a later time; it is
    reached unless that is more than ``limit`` microseconds later or an excluded row lies after the step before and not after it. tN is the ceil(``percent`` n / 100)-th smallest of a step's times,
    one an attempt; same_depth counts the clients of equal funnel and deepest step.

    Rows with a null client, kind or time, and rows of other kinds, are left out; repeated rows count once; rows of one time follow each other in no order, so none of them is the next step of another.
    An empty table, or one without first steps, gives no rows. Other columns are not read. No text is read, so none can be too long.
    """
    kinds = sorted({k for ks in funnels.values() for k in ks})
    kind = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind_col)) - 1
    rows = events.select(F.col(client_col).alias("client"), kind.cast("int").alias("kind"), micros(F.col(ts_col), events.schema[ts_col].dataType).alias("at"))
    lots = _lots(rows.where("client is not null and kind >= 0 and at is not null"), lot_rows)
    chains = written(_chained(lots, _carries(lots, len(kinds), limit), funnels, kinds, limit, percent), "funnel-chains")

    go = lambda s: chains.where(f"part = 'go' and step = {s}").select("lot", "funnel", "client", "took", F.col("to_lot").alias("onward"), "then")
    left = lambda s: chains.where(f"part = 'leave' and step = {s}").select("lot", "funnel", "weight")
    met = lambda leaving, s: leaving.groupBy("lot", "funnel").agg(F.sum("weight").alias("weight")).join(go(s), ["lot", "funnel"]).where("took is not null")
    second = written(met(left(2), 2), "funnel-second")
    third = written(met(left(3).unionByName(second.where("onward is not null").select(F.col("onward").alias("lot"), "funnel", "weight")), 3), "funnel-third")

    timed = lambda df, step, value: df.where(f"{value} is not null").select("funnel", "client", F.lit(step).alias("step"), F.col(value).alias("value"), F.col("weight").alias("n"))
    crossed = timed(second, 3, "took").unionByName(timed(second, 4, "then")).unionByName(timed(third, 4, "took"))
    split = chains.where("part = 'sum' and split").select("funnel", "client", *[f"{c}{s}" for c in "hv" for s in (2, 3, 4)])

    none = F.lit(None).cast("long")
    row = lambda df, **have: df.select("funnel", "client", *[have.get(c, none).alias(c) for c in ("n1", "n2", "n3", "n4", "t2", "t3", "t4")])
    sums = row(chains.where("part = 'sum'"), **{c: F.col(c) for c in ("n1", "n2", "n3", "n4", "t2", "t3", "t4")})
    got = sums.unionByName(row(second, n3=F.col("weight"), n4=F.when(F.col("then").isNotNull(), F.col("weight")))).unionByName(row(third, n4=F.col("weight")))
    got = got.unionByName(row(_selected(split, crossed, limit, percent), t2=F.col("t2"), t3=F.col("t3"), t4=F.col("t4")))
    total = got.groupBy("funnel", "client").agg(*[F.coalesce(F.sum(f"n{s}"), F.lit(0).cast("long")).alias(f"n{s}") for s in (1, 2, 3, 4)], *[F.max(f"t{s}").alias(f"t{s}") for s in (2, 3, 4)])
    deepest = F.when(F.col("n4") > 0, 4).when(F.col("n3") > 0, 3).when(F.col("n2") > 0, 2).otherwise(1)
    total = written(total.withColumn("deepest", deepest), "funnel-totals")
    depths = total.groupBy("funnel", "deepest").agg(F.count(F.lit(1)).alias("same_depth"))  # four rows a funnel, so it may be broadcast
    return total.join(F.broadcast(depths), ["funnel", "deepest"]).select("funnel", F.col("client").alias("client_id"), "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth")


#: The same counts in DuckDB's SQL.
SQL = """
WITH d AS (SELECT DISTINCT client_id, kind, ts FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT * FROM (VALUES ('A', 'view', 'click', 'view', 'purchase', 'error'), ('B', 'signup', 'view', 'click', 'purchase', 'error'), ('C', 'click', 'click', 'purchase', 'view', 'signup')) AS f(funnel, k1, k2, k3, k4, bad)),
a1 AS (SELECT f.*, d.client_id, d.ts AS ts1 FROM d JOIN f ON d.kind = f.k1),
b2 AS (SELECT a.*, n.ts AS nx, e.ts AS ex FROM a1 a ASOF LEFT JOIN d n ON a.client_id = n.client_id AND a.k2 = n.kind AND a.ts1 < n.ts ASOF LEFT JOIN d e ON a.client_id = e.client_id AND a.bad = e.kind AND a.ts1 < e.ts),
a2 AS (SELECT * EXCLUDE (nx, ex), CASE WHEN nx - ts1 <= INTERVAL 60 MINUTE AND (ex IS NULL OR ex > nx) THEN nx END AS ts2 FROM b2),
b3 AS (SELECT a.*, n.ts AS nx, e.ts AS ex FROM a2 a ASOF LEFT JOIN d n ON a.client_id = n.client_id AND a.k3 = n.kind AND a.ts2 < n.ts ASOF LEFT JOIN d e ON a.client_id = e.client_id AND a.bad = e.kind AND a.ts2 < e.ts),
a3 AS (SELECT * EXCLUDE (nx, ex), CASE WHEN nx - ts2 <= INTERVAL 60 MINUTE AND (ex IS NULL OR ex > nx) THEN nx END AS ts3 FROM b3),
b4 AS (SELECT a.*, n.ts AS nx, e.ts AS ex FROM a3 a ASOF LEFT JOIN d n ON a.client_id = n.client_id AND a.k4 = n.kind AND a.ts3 < n.ts ASOF LEFT JOIN d e ON a.client_id = e.client_id AND a.bad = e.kind AND a.ts3 < e.ts),
a4 AS (SELECT * EXCLUDE (nx, ex), CASE WHEN nx - ts3 <= INTERVAL 60 MINUTE AND (ex IS NULL OR ex > nx) THEN nx END AS ts4 FROM b4),
g AS (SELECT funnel, client_id, count(*) AS n1, count(ts2) AS n2, count(ts3) AS n3, count(ts4) AS n4,
  list_sort(list(epoch_us(ts2) - epoch_us(ts1)) FILTER (WHERE ts2 IS NOT NULL)) AS l2, list_sort(list(epoch_us(ts3) - epoch_us(ts2)) FILTER (WHERE ts3 IS NOT NULL)) AS l3,
  list_sort(list(epoch_us(ts4) - epoch_us(ts3)) FILTER (WHERE ts4 IS NOT NULL)) AS l4 FROM a4 GROUP BY funnel, client_id),
h AS (SELECT funnel, client_id, n1, n2, n3, n4, (CASE WHEN n4 > 0 THEN 4 WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 ELSE 1 END)::INTEGER AS deepest,
  l2[(90 * n2 + 99) // 100] AS t2, l3[(90 * n3 + 99) // 100] AS t3, l4[(90 * n4 + 99) // 100] AS t4 FROM g)
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM h
"""
