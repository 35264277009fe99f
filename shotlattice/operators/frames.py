"""Frames of items: which are kept, wanted and there; keyframes as rows; ragged lists as columns; fits of frame pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .prefixes import running

c = F.col


def stride_of(source_fps: Column, fps: float) -> Column:
    """Every how many-th frame is kept to come near a rate: whole, at least 1, halves to even."""
    return F.greatest(F.rint(source_fps / fps), F.lit(1)).cast("int")


def sampled(frames: DataFrame, item: str, frame: str, source_fps: str, fps: float) -> DataFrame:
    """The kept frames, numbered anew from 0, with the number they had as ``decoded``. A stride, not a clock: the rate is met about."""
    kept = frames.where(F.pmod(frame, stride_of(c(source_fps), fps)) == 0)
    return kept.withColumn("decoded", c(frame)).withColumn(frame, F.row_number().over(Window.partitionBy(item).orderBy("decoded")) - 1)


def wanted_frames(frames: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Frames that are asked for, once for each name they are asked for under; nothing else of the frames is read on."""
    return frames.join(wanted, keys)


def absent_frames(frames: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """What is asked for and not there; a source is complete if this is empty."""
    return wanted.select(*keys).distinct().join(frames.select(*keys), keys, "left_anti")


def complete(frames: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted_frames``; an error if any of them is missing."""
    missing = absent_frames(frames, wanted, keys).limit(5).collect()
    if missing:
        raise LookupError(f"frames are missing, the first of them {[tuple(r) for r in missing]}")
    return wanted_frames(frames, wanted, keys)


def source_kind(strides: Column, counted: Column, expected: Column) -> Column:
    """Where an item's frames may come from: extracted files if they are every frame and as many as expected, else the video."""
    return F.when((strides == 1) & (counted == expected), "frames").otherwise("video")


def keyframe_rows(segments: DataFrame, item: str, segment: str, keyframes: str) -> DataFrame:
    """(item, segment, keyframe, place, row): keyframes in file order; ``row`` counts them within the item from 0, as their vectors are stored."""
    rows = segments.select(item, segment, F.posexplode(keyframes).alias("place", "keyframe"))
    return rows.withColumn("row", F.row_number().over(Window.partitionBy(item).orderBy(segment, "place")) - 1)


def offsets(rows: DataFrame, item: str, segment: str, size: str) -> DataFrame:
    """Where each segment's rows begin in its item's table, and how many there are."""
    before = F.sum(size).over(Window.partitionBy(item).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", F.coalesce(before, F.lit(0)))


def scaled_boxes(pairs: DataFrame, sizes: DataFrame, item: str, boxes: str) -> DataFrame:
    """Boxes of the unit square in an item's pixels, the placeholder at their head left out."""
    j = pairs.join(sizes, item)
    pixel = lambda b: F.array(F.rint(b[0] * c("width")), F.rint(b[1] * c("height")), F.rint(b[2] * c("width")), F.rint(b[3] * c("height")))
    return j.withColumn(boxes, F.transform(F.slice(boxes, 2, F.greatest(F.size(boxes) - 1, F.lit(0))), pixel)).drop("width", "height")


def optional(items: DataFrame, found: DataFrame, item: str) -> DataFrame:
    """Items with what was made for them, null where nothing was."""
    return items.select(item).distinct().join(found, item, "left")


def pairs_without(pairs: DataFrame, duplicates: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """Pairs (item, a, b) of the given items that are not known to be one and the same."""
    return pairs.join(items.select(item).distinct(), item, "left_semi").join(duplicates.select(item, "a", "b"), [item, "a", "b"], "left_anti")


def marks_without(members: DataFrame, items: DataFrame, item: str, name: str, doubled: int, of_a: int, of_b: int) -> DataFrame:
    """(item, pairs, marks): how many pairs a < b of the members (one row each) of the given items ``pairs_without`` keeps if those are doubles whose sum ``doubled`` divides, and the sum of ``of_a * a + of_b * b``.

    Members before and after one are counted by remainder along the order of all of them, so no pair is made and no item is one task. Items without such a pair have no row.
    """
    cells = members.where(c(name).isNotNull()).join(items.select(item).distinct(), item, "left_semi")
    kinds = [f"n{k}_" for k in range(doubled)]
    cells = cells.select(item, name, F.struct(item, name).alias("at_"), F.pmod(name, F.lit(doubled)).cast("int").alias("own_"))
    sums = running(cells.withColumns({n: (c("own_") == k).cast("long") for k, n in enumerate(kinds)}), "at_", kinds)
    whole = sums.groupBy(item).agg(*[x for n in kinds for x in (F.min(f"{n}_before").alias(f"{n}first"), F.sum(n).alias(f"{n}all"))])
    j = sums.join(whole, item)
    other = (doubled - c("own_")) % doubled  # a double's remainder
    before = [c(f"{n}_before") - c(f"{n}first") for n in kinds]
    after = [c(f"{n}all") - b - c(n) for n, b in zip(kinds, before)]
    kept = lambda counts: sum(F.when(other != k, x).otherwise(F.lit(0)) for k, x in enumerate(counts))
    each = j.select(item, name, kept(before).alias("low"), kept(after).alias("high"))
    return each.groupBy(item).agg(F.sum("low").alias("pairs"), F.sum(c(name) * (of_a * c("high") + of_b * c("low"))).alias("marks")).where("pairs > 0")


def fitted_steps(frames: DataFrame, item: str, frame: str, masked: Column, whole: Column) -> DataFrame:
    """(item, frame, fit): for every pair of consecutive frames the fit off people, else that of the whole frame; null where both failed."""
    nxt = F.lead(frame).over(Window.partitionBy(item).orderBy(frame))
    return frames.withColumn("next_", nxt).where(c("next_") == c(frame) + 1).select(item, frame, F.coalesce(masked, whole).alias("fit"))


def mutual_hits(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, both): unordered pairs with looks in both directions, and whether both land. ``pairs``: keys, from, to, lands; of several looks of one direction the first by ``at``."""
    first = pairs.groupBy(*keys, "from", "to").agg(F.min_by("lands", "at").alias("lands"))
    x, y = first.alias("x"), first.alias("y")
    on = [c(f"x.{k}") == c(f"y.{k}") for k in keys] + [c("x.from") == c("y.to"), c("x.to") == c("y.from"), c("x.from") < c("x.to")]
    return x.join(y, on).select(*[c(f"x.{k}") for k in keys], c("x.from").alias("a"), c("x.to").alias("b"), (c("x.lands") & c("y.lands")).alias("both"))


def rate_report(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, middle and most of a rate by group."""
    q = F.percentile(value, F.lit(0.5))
    return rows.groupBy(*keys).agg(F.min(value).alias("least"), q.alias("middle"), F.max(value).alias("most"), F.count(value).alias("n"))


def column_means(rows: DataFrame, groups: DataFrame, column: str, value: str) -> DataFrame:
    """Mean value of the columns of each group; ``groups``: column, grp."""
    return rows.join(F.broadcast(groups), column).groupBy("grp").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))  # groups: a fixed list of columns
