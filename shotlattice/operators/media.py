"""Measures of shots, people and cameras that combine several basic operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT
from ..functions import geometry as G
from ..functions.chance import uniform
from . import linkage as L


def codec(v: Column) -> Column:
    """Four-character code of a whole number, lowest byte first."""
    return F.concat(*[F.char(F.shiftright(v, 8 * i).bitwiseAND(255)) for i in range(4)])


def usable(area: Column, frontality: Column | None = None) -> Column:
    """Crops large enough and, for faces, frontal enough; unknown frontality is not."""
    ok = area >= DEFAULT.min_crop_area
    return ok if frontality is None else ok & F.coalesce(frontality >= DEFAULT.min_frontality, F.lit(False))


def split_counts(df: DataFrame, keys: list[str], live: Column, readable: Column) -> DataFrame:
    """Rows kept, withheld for their footage, and withheld for their quality; each row counts once."""
    c = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return df.groupBy(*keys).agg(c(live & readable).alias("kept"), c(~live).alias("withheld_footage"), c(live & ~readable).alias("withheld_quality"))


def pose_movement(samples: DataFrame, keys: list[str], segment: str, order: list[str], joints: str, floor: float = DEFAULT.pose_visibility) -> DataFrame:
    """Mean displacement of joints (array of x, y, visibility) usable in both of two consecutive samples; never across segments."""
    before = F.lag(joints).over(Window.partitionBy(*keys, segment).orderBy(*order))
    ok = lambda p: (p["v"] >= floor) & p["x"].between(0, 1) & p["y"].between(0, 1)
    step = F.zip_with(F.col(joints), F.col("before_"), lambda a, b: F.when(ok(a) & ok(b), F.sqrt(F.pow(a["x"] - b["x"], F.lit(2.0)) + F.pow(a["y"] - b["y"], F.lit(2.0)))))
    each = samples.withColumn("before_", before).where("before_ is not null").select(*keys, F.explode(step).alias("d")).where("d is not null")
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("movement"))


def lower_median(values: Column) -> Column:
    """The lower middle of the values of an array that are not negative; null without any."""
    s = F.array_sort(F.filter(values, lambda x: x >= 0))
    return F.when(F.size(s) > 0, F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")))


def weighted_share(df: DataFrame, keys: list[str], holds: Column, weight: str, among: Column | None = None) -> DataFrame:
    """Share of weight where ``holds``, among the rows where ``among``; null without weight."""
    rows = df if among is None else df.where(among)
    s = rows.groupBy(*keys).agg(F.sum(F.when(holds, F.col(weight)).otherwise(0.0)).alias("top_"), F.sum(weight).alias("all_"))
    return s.select(*keys, F.when(F.col("all_") > 0, F.col("top_") / F.col("all_")).alias("share"))


def split_profile(df: DataFrame, keys: list[str], labels: str, weight: str) -> DataFrame:
    """Weights by label, a row's weight split evenly over its labels, normalised."""
    each = df.where(F.size(labels) > 0).select(*keys, F.explode(labels).alias("label"), (F.col(weight) / F.size(labels)).alias("w"))
    got = each.groupBy(*keys, "label").agg(F.sum("w").alias("w"))
    return got.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*keys))).drop("w")


def best_partner(df: DataFrame, keys: list[str], person: str, other: str, score: str) -> DataFrame:
    """Scores where a person's best partner keeps its score and the others get 0 (the first by name on ties)."""
    order = Window.partitionBy(*keys, person).orderBy(F.col(score).desc(), other)
    return df.withColumn("best", F.when(F.row_number().over(order) == 1, F.col(score)).otherwise(F.lit(0.0)))


def longest(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The longest closed range of each group (the first on ties) and its share of all frames."""
    size = F.col(end) - F.col(start) + 1
    return df.groupBy(*keys).agg(F.max_by(F.struct(start, end), F.struct(size.alias("n"), (-F.col(start)).alias("s"))).alias("r"), F.max(size).alias("n"), F.sum(size).alias("t")).select(*keys, F.col(f"r.{start}").alias(start), F.col(f"r.{end}").alias(end), (F.col("n") / F.col("t")).alias("covered"))


def degrees(pairs: DataFrame, top: int) -> DataFrame:
    """Nodes of a graph of pairs by the number of their links, the first ``top`` by (-degree, node)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.col("degree").desc(), "node").limit(top)


def min_max(df: DataFrame, keys: list[str], value: str) -> Column:
    """Value between its group's least (0) and greatest (1); 0 where they are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.0))


#: Points and boxes of a tile, about; boxes that are tried at once.
HELD, TRIED = 16_384, 64


def smallest_holder(points: DataFrame, boxes: DataFrame, keys: list[str], x: str, y: str, size: int = HELD) -> DataFrame:
    """Points with the smallest box (id, box) of their group that holds them, the first by id on ties; areas count to 6 places.

    A tile tries its boxes from the smallest on, and only on the points that none has held yet; it sends a row a point at most.
    """
    corners = ["x1", "y1", "x2", "y2"]
    p = points.select(*keys, "id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    b = boxes.select(*keys, "id", F.round(G.area(F.col("box")), 6).cast("double").alias("area"), *[F.col(f"box.{k}").cast("double").alias(k) for k in corners]).dropna()
    own, other = dict(p.dtypes)["id"], dict(b.dtypes)["id"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p, b = g[g["side"] == 0], g[g["side"] == 1].sort_values(["area", "id"])
        px, py = p["x"].to_numpy(), p["y"].to_numpy()
        x1, y1, x2, y2 = (b[k].to_numpy() for k in corners)
        left, held = np.arange(len(p)), np.full(len(p), -1)
        for k in range(0, len(b), TRIED):
            if not len(left):
                break
            at = slice(k, k + TRIED)
            u, v = px[left][:, None], py[left][:, None]
            inside = (u >= x1[at]) & (u <= x2[at]) & (v >= y1[at]) & (v <= y2[at])
            hit = inside.any(axis=1)
            held[left[hit]] = k + inside[hit].argmax(axis=1)
            left = left[~hit]
        ok = held >= 0
        return pd.DataFrame({"id": p["id"].to_numpy()[ok], "a": b["area"].to_numpy()[held[ok]], "holder": b["id"].to_numpy()[held[ok]]})

    found = L.tiles(p, b, keys, "id", size).groupBy(*keys, "i", "j").applyInPandas(run, f"id {own}, a double, holder {other}")
    return found.groupBy("id").agg(F.min(F.struct("a", F.col("holder").alias("i"))).alias("m")).select("id", F.col("m.i").alias("holder"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with how often; empty if both hold the same rows."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def numeric_flags(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """constant: a deviation below 1 % of the span over 20 values or more; out of range: more than 1 % outside."""
    a = df.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_pop(value).alias("sd"), F.avg((~F.col(value).between(low, high)).cast("double")).alias("out"))
    flags = F.array_compact(F.array(F.when((F.col("n") >= 20) & (F.col("sd") < 0.01 * (high - low)), F.lit("constant")), F.when(F.col("out") > 0.01, F.lit("out of range"))))
    return a.select(*keys, "n", F.array_join(flags, ",").alias("flags"))


def collapsed(df: DataFrame, keys: list[str], label: str, head: float = 0.95) -> DataFrame:
    """The share of the commonest label and whether it stands for nearly all of 20 rows or more."""
    c = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.max("c").alias("m"), F.sum("c").alias("n"))
    return c.select(*keys, "n", (F.col("m") / F.col("n")).alias("top"), ((F.col("n") >= 20) & (F.col("m") / F.col("n") >= head)).alias("collapsed"))


def nearest_option(value: Column, options: list[int]) -> Column:
    """The option nearest on an ordinal scale; the lower of two equally near."""
    return F.array_min(F.array(*[F.struct(F.abs(value - o).alias("d"), F.lit(o).alias("o")) for o in options]))["o"]


def swept(df: DataFrame, truth: str, score: str, cuts: list[float], keys: list[str]) -> DataFrame:
    """Precision, recall and F1 at every cut."""
    from .scoring import binary_rates

    grid = df.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts]))).withColumn("said_", F.col(score) >= F.col("cut"))
    return binary_rates(grid, truth, "said_", [*keys, "cut"]).select(*keys, "cut", "precision", "recall", "f1")


def typical(df: DataFrame, cluster: str, item: str, value: str) -> DataFrame:
    """A cluster's typical value: mean of item means, and median of item medians."""
    each = df.groupBy(cluster, item).agg(F.avg(value).alias("m"), F.percentile(value, F.lit(0.5)).alias("p"))
    return each.groupBy(cluster).agg(F.count(F.lit(1)).alias("items"), F.avg("m").alias("mean"), F.percentile("p", F.lit(0.5)).alias("median"))


def matched_cut(df: DataFrame, keys: list[str], a: str, b: str, cut: float) -> DataFrame:
    """The share of ``a`` at or above a cut, and the cut of ``b`` that the same share passes."""
    rate = df.groupBy(*keys).agg(F.avg((F.col(a) >= cut).cast("double")).alias("rate"))
    ranked = df.select(*keys, b).withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy(b)) - 1).withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    # linear quantile at 1 - rate from the two order statistics around it
    place = (1 - F.col("rate")) * (F.col("n_") - 1)
    near = ranked.join(rate, keys).where((F.col("r_") == F.floor(place)) | (F.col("r_") == F.ceil(place)))
    t = place - F.floor(place)
    return near.groupBy(*keys, "rate").agg((F.min(b) + (F.max(b) - F.min(b)) * F.max(t)).alias("cut"))


def dealt(df: DataFrame, keys: list[str], label: str, seed: int) -> DataFrame:
    """Labels dealt anew among the rows of each group by a seeded hash: what chance would give."""
    order = [uniform(seed, "id"), F.col("id")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    hand = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    a, b = df.withColumn("place_", place), df.withColumn("place_", hand)
    b = b.select(*keys, "place_", F.col(label).alias("dealt"))
    return a.join(b, [*keys, "place_"]).drop("place_")
