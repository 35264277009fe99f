"""Small joins and counts over boxes, labels and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G

c = F.col


def own_head(bodies: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """(id, head): of the heads (id, x, y) of its group in a body's upper half the one nearest the midpoint of its top, the smallest id on ties."""
    p, h = bodies.alias("p"), heads.alias("h")
    body = c("p.body")
    on = [c(f"p.{k}") == c(f"h.{k}") for k in keys] + [G.inside(c("h.x"), c("h.y"), G.upper_half(body))]
    far = F.round(F.hypot(c("h.x") - G.centre(body)[0], c("h.y") - body["y1"]), 6)
    return p.join(h, on).groupBy(c("p.id").alias("id")).agg(F.min_by(c("h.id"), F.struct(far.alias("far"), c("h.id").alias("i"))).alias("head"))


def single_label(rows: DataFrame, keys: list[str], labels: str, start: str, end: str, fps: float, valid: list[str], last: str) -> DataFrame:
    """Spans with one valid label, as whole frames; ``last`` stands for itself and more."""
    one = rows.where((F.size(labels) == 1) & c(labels)[0].isin(valid))
    name = F.when(c(labels)[0] == last, F.lit(f"{last}+")).otherwise(c(labels)[0])
    return one.select(*keys, F.rint(c(start) * fps).cast("long").alias("start"), F.rint(c(end) * fps).cast("long").alias("end"), name.alias("label"))


def frames_of(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, frame): every frame of closed ranges."""
    return rows.select(*keys, F.explode(F.sequence(start, end)).alias("frame"))


def region_shares(rows: DataFrame, keys: list[str], region: str, top: int) -> DataFrame:
    """Shares of the regions of each group, the ``top`` largest (by name on ties)."""
    n = rows.groupBy(*keys, region).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*keys)
    ranked = n.withColumn("share", c("n") / F.sum("n").over(own)).withColumn("rank", F.row_number().over(own.orderBy(c("n").desc(), region)))
    return ranked.where(c("rank") <= top).select(*keys, region, "share", "rank")


def counters(rows: DataFrame, item: str, source: str, counts: dict[str, Column], sources: list[str]) -> DataFrame:
    """One row an item, one column a source and count: sums that add up over items and resamples."""
    return rows.groupBy(item).pivot(source, sources).agg(*[F.sum(v).alias(k) for k, v in counts.items()])


def swept_listing(pairs: DataFrame, shares: list[float], least: list[int]) -> DataFrame:
    """(share, least, hits, said, truth) over a grid: a pair is said to look at one another if both directions reach the share on enough samples. The grid is a fixed list."""
    grid = F.array(*[F.struct(F.lit(s).alias("share"), F.lit(n).alias("least")) for s in shares for n in least])
    g = pairs.withColumn("g", F.explode(grid)).select("*", "g.*").drop("g")
    side = lambda x: (c(f"{x}_n") >= c("least")) & (c(f"{x}_hits") >= F.round(c("share") * c(f"{x}_n"), 9))
    said = side("a") & side("b")
    return g.groupBy("share", "least").agg(F.count_if(said & c("truth")).alias("hits"), F.count_if(said).alias("said"), F.count_if("truth").alias("truth"))
