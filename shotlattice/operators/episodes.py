"""Records of segments and their keyframes, picks along an item, shares of label maps, and reports over series of episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .intervals import drawn, ends
from .kits import bound

c = F.col


def segment_records(shots: DataFrame, keyframes: DataFrame, item: str, fps: Column, labels: DataFrame | None = None) -> DataFrame:
    """One record an item: shot_count, keyframe_count, dropped_ranges (null if none), fps, shots.

    ``shots``: item, start, end (inclusive), in any order, and ``fps`` an expression over them; ranges that end before they start are dropped, and counted. ``keyframes``: item, frame, sharpness; each belongs to the shot
    that holds it. ``labels``: item, index, intra, inter, by the shot's place; shots beyond have none. A shot has index, start_frame, end_frame, start_time, end_time (that of the frame after it, to three places) and its
    keyframes (frame, time, sharpness to one place).
    """
    order = Window.partitionBy(item).orderBy("start", "end")
    ranges = shots.withColumns({"fps_": fps.cast("double"), "kept_": c("end") >= c("start")})
    counted = ranges.groupBy(item).agg(F.count_if(~c("kept_")).alias("dropped_"), F.max("fps_").alias("fps_"))
    kept = ranges.where("kept_").withColumn("index", F.row_number().over(order) - 1)
    time = lambda frame: F.round(frame / c("fps_"), 3)
    # each keyframe meets the last shot that starts at or before it: both in one order of the item
    rows = kept.select(item, c("start").alias("at_"), F.lit(0).alias("kind_"), F.struct("index", "end", "fps_").alias("s_"), F.lit(None).cast("double").alias("sharp_"))
    frames = keyframes.select(item, c("frame").alias("at_"), F.lit(1).alias("kind_"), F.lit(None).cast(rows.schema["s_"].dataType).alias("s_"), c("sharpness").cast("double").alias("sharp_"))
    held = F.last("s_", ignorenulls=True).over(Window.partitionBy(item).orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = rows.unionByName(frames).withColumn("s_", held).where("kind_ = 1 and at_ <= s_.end")
    listed = inside.groupBy(item, c("s_.index").alias("index")).agg(F.array_sort(F.collect_list(F.struct(c("at_").alias("frame"), F.round(c("at_") / c("s_.fps_"), 3).alias("time"), F.round("sharp_", 1).alias("sharpness")))).alias("keyframes"))
    none = F.array().cast(listed.schema["keyframes"].dataType)
    named = kept.join(listed, [item, "index"], "left")
    named = named.join(labels, [item, "index"], "left") if labels is not None else named.withColumns({"intra": F.lit(None).cast("string"), "inter": F.lit(None).cast("string")})
    shot = F.struct("index", c("start").alias("start_frame"), c("end").alias("end_frame"), time(c("start")).alias("start_time"), time(c("end") + 1).alias("end_time"), F.coalesce("keyframes", none).alias("keyframes"), c("intra").alias("intra_label"), c("inter").alias("inter_label"))
    whole = named.groupBy(item).agg(F.array_sort(F.collect_list(shot)).alias("shots"))
    out = counted.join(whole, item, "left")
    shots_ = F.coalesce("shots", F.array().cast(whole.schema["shots"].dataType))
    frames_ = F.aggregate(F.transform(shots_, lambda s: F.size(s["keyframes"])), F.lit(0), lambda a, b: a + b)
    return out.select(item, F.size(shots_).alias("shot_count"), frames_.alias("keyframe_count"), F.nullif("dropped_", F.lit(0)).alias("dropped_ranges"), F.round("fps_", 3).alias("fps"), shots_.alias("shots"))


def person_tracks(tracks: DataFrame, item: str, person: str, segment: str, track: str) -> DataFrame:
    """(item, person, tracks): a person's tracks as (segment, track), in that order, each once."""
    return tracks.where(c(person).isNotNull()).groupBy(item, person).agg(F.array_sort(F.collect_set(F.struct(segment, track))).alias("tracks"))


def even_picks(df: DataFrame, item: str, order: list[str], count: int) -> DataFrame:
    """Of each item's rows in order ``count`` that are evenly spaced from the first to the last (all, if there are no more); a place between two goes to the nearest, halves to the even one."""
    along = df.withColumns({"at_": F.row_number().over(Window.partitionBy(item).orderBy(*order)) - 1, "n_": F.count(F.lit(1)).over(Window.partitionBy(item))})
    last = F.least(c("n_"), F.lit(count)) - 1
    places = F.when(last > 0, F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.bround(i * (c("n_") - 1) / last).cast("int"))).otherwise(F.array(F.lit(0)))
    return along.where(F.array_contains(places, c("at_"))).drop("at_", "n_")


def item_shape(picked: DataFrame, item: str, bars: str, width: str, height: str, order: list[str]) -> DataFrame:
    """(item, tall, bars) from an item's picked frames: the first one's height over its short side, and the median share of black bars."""
    first = F.min_by(F.struct(width, height), F.struct(*order))
    out = picked.groupBy(item).agg(first.alias("f_"), F.percentile(bars, F.lit(0.5)).alias("bars"))
    return out.select(item, (c(f"f_.{height}") / F.least(c(f"f_.{height}"), c(f"f_.{width}"))).alias("tall"), "bars")


def frame_size(known: Column, first: Column) -> Column:
    """An item's frame size: what its metadata says, else that of its first frame."""
    return F.coalesce(known, first)


def map_shares(maps: DataFrame, item: str, pixels: str, names: DataFrame) -> DataFrame:
    """(item, name, share): every class on a label map (an array of class ids) with its share of the pixels. ``names``: id, name; a class without a name is an error of the table, and gets none.

    Pixels are counted before they are sent, so a map crosses as a row a class.
    """
    size = maps.select(item, F.explode(pixels).alias("id")).groupBy(item, "id").agg(F.count(F.lit(1)).alias("n_"))
    whole = Window.partitionBy(item)
    return size.withColumn("share", c("n_") / F.sum("n_").over(whole)).join(names, "id", "left").select(item, "name", "share")


def reading_chunks(width: Column, height: Column, line: int = 32, step: int = 100, least: int = 8) -> Column:
    """Where a text line is cut to be read: (start, end) pixels at a height of ``line``, in parts of about ``step``; parts under ``least`` are left out."""
    wide = F.greatest(F.lit(least), F.bround(width * line / height).cast("int"))

    def cuts(size: Column) -> Column:
        n, wide = size["n"], size["wide"]
        cut = lambda i: F.bround(i * wide / n).cast("int")
        return F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(cut(i).alias("start"), cut(i + 1).alias("end"))), lambda x: x["end"] - x["start"] >= least)

    # width and parts are bound first: named inside the inner function they would be computed again for each part
    size = lambda wide: F.struct(F.greatest(F.lit(1), F.bround(wide / step).cast("int")).alias("n"), wide.alias("wide"))
    return bound(bound(wide, size), cuts)


def joined_readings(readings: Column) -> Column:
    """The parts read, without outer blanks and empty ones, joined by a blank."""
    return F.array_join(F.filter(F.transform(readings, lambda x: F.trim(x)), lambda x: x != ""), " ")


def labels_but(labels: Column, other: str = "other") -> Column:
    """Labels but the one that says nothing."""
    return F.filter(labels, lambda x: x != other)


def joined_groups(arrays: DataFrame, values: str) -> DataFrame:
    """The values of all groups' arrays as one column; nothing is gathered."""
    return arrays.select(F.explode(values).alias(values))


def series_report(scores: DataFrame, series: str, episode: str, metric: str, value: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """(metric, average, low, high, series): the mean over series of the means of their episodes, and its 95 % interval over episodes drawn within their series. A series that a draw leaves empty is left out of it."""
    means = scores.groupBy(metric, series).agg(F.avg(value).alias("m_"))
    whole = means.groupBy(metric).agg(F.avg("m_").alias("average"), F.count(F.lit(1)).alias("series"))
    many = drawn(scores.select(series, episode, metric, value), episode, draws, seed)
    each = many.groupBy(metric, series, "draw").agg((F.sum(c(value) * c("w")) / F.sum("w")).alias("m_")).groupBy(metric, "draw").agg(F.avg("m_").alias("m_"))
    return whole.join(ends(each, "m_", [metric]), metric, "left").select(metric, "average", "low", "high", "series")
