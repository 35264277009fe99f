"""From rows to records of persons, segments and items: what the terminal record is put together from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import stats as A

c = F.col


def dense_tracks(rows: DataFrame, item: str, keys: list[str], frame: str, least: int) -> DataFrame:
    """Tracks (``keys`` within an item) with ``least`` rows or more: first and last frame, rows, and a number from 1 by (first frame, key)."""
    tracks = rows.groupBy(item, *keys).agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count(F.lit(1)).alias("rows")).where(c("rows") >= least)
    return tracks.withColumn("track", F.row_number().over(Window.partitionBy(item).orderBy("first", *keys)))


def profile(rows: DataFrame, keys: list[str], keyframe: str, label: str) -> DataFrame:
    """Per segment (``keys``) and label: the most of it on one keyframe, and the share of keyframes that have it."""
    frames = rows.groupBy(*keys).agg(F.countDistinct(keyframe).alias("keyframes"))
    counts = rows.where(c(label).isNotNull()).groupBy(*keys, keyframe, label).agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy(*keys, label).agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("seen"))
    return found.join(frames, keys).select(*keys, label, "most", (c("seen") / c("keyframes")).alias("agreement"))


def rollup(profiles: DataFrame, item: str, label: str) -> DataFrame:
    """Sum over an item's segments of the most at once, the largest first (by name on ties)."""
    return profiles.groupBy(item, label).agg(F.sum("most").alias("total")).withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(c("total").desc(), label)))


def person_segments(rows: DataFrame, keys: list[str], emotion: dict[str, Column], axis: str, fps: float) -> DataFrame:
    """A person's affect by segment: seconds, samples, mean share and likeliest of the emotions, and the statistics of an axis, so a change across a cut isn't pooled away."""
    shares = [F.avg(v).alias(f"share_{k}") for k, v in emotion.items()]
    found = rows.groupBy(*keys).agg((F.count(F.lit(1)) / fps).alias("seconds"), F.count(F.lit(1)).alias("series"), *shares)
    best = F.greatest(*[c(f"share_{k}") for k in emotion])
    modal = F.coalesce(*[F.when(c(f"share_{k}") == best, F.lit(k)) for k in sorted(emotion)])
    own = A.stats(rows, keys, axis).select(*keys, *[c(x).alias(f"{axis}_{x}") for x in ("mean", "median", "variance")])
    return found.withColumn("modal", modal).join(own, keys)


def person_totals(rows: DataFrame, keys: list[str], segment: str, frame: str, kinds: dict[str, Column], inside: Column, floor: float = 0.5) -> DataFrame:
    """Screen time, support counts by kind of sample and the share of samples that are inside; the time between a person's segments is not screen time."""
    return rows.groupBy(*keys).agg(
        F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.countDistinct(frame).alias("frames"), F.countDistinct(segment).alias("segments"), F.count(F.lit(1)).alias("series"),
        *[F.count_if(v).alias(k) for k, v in kinds.items()], F.avg((inside >= floor).cast("int")).alias("inside_share"),
    )


def top_means(rows: DataFrame, keys: list[str], label: str, value: str, top: int) -> DataFrame:
    """The ``top`` labels by mean value (by name on ties) over the rows that have them, with the count behind it."""
    found = rows.groupBy(*keys, label).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("mean", 9).desc(), label))).where(c("rank") <= top)


def whole_item(weighted: DataFrame, total: DataFrame, item: str, label: str, weight: str, top: int) -> DataFrame:
    """An item's labels by their weight over its seconds, the ``top`` of them; names without outer blanks."""
    sums = weighted.groupBy(item, F.trim(label).alias(label)).agg(F.sum(weight).alias("w"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(F.round("w", 9).desc(), label))).where(c("rank") <= top)
    return ranked.join(total, item).select(item, label, (c("w") / c("seconds")).alias("share"), "rank")


def weighted_distribution(shares: DataFrame, keys: list[str], row: str, label: str, share: str, weight: str) -> DataFrame:
    """Weighted mean of the rows' distributions (a label that a row lacks counts 0 there), and which label leads (the first by name on ties)."""
    whole = shares.groupBy(*keys, row).agg(F.first(weight).alias("w_")).groupBy(*keys).agg(F.sum("w_").alias("total_"))
    mean = shares.groupBy(*keys, label).agg(F.sum(c(share) * c(weight)).alias("s_")).join(whole, keys).select(*keys, label, F.try_divide("s_", "total_").alias("mean"))
    lead = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("mean", 9).desc(), label)) == 1
    return mean.withColumn("leads", lead)


def objects_found(rows: DataFrame, scheduled: DataFrame, keys: list[str], frame: str, label: str) -> DataFrame:
    """Frames of a segment's schedule on which an object was found, over those that were looked at."""
    looked = scheduled.groupBy(*keys).agg(F.countDistinct(frame).alias("detected"))
    found = rows.join(scheduled.select(*keys, frame).distinct(), [*keys, frame], "left_semi").groupBy(*keys, label).agg(F.countDistinct(frame).alias("frames"))
    return found.join(looked, keys).select(*keys, label, "frames", "detected", (c("frames") / c("detected")).alias("share"))


def most_at_once(rows: DataFrame, segments: DataFrame, keys: list[str], frame: str, observed: Column) -> DataFrame:
    """The most observed rows on one frame of every segment; 0 where there are none."""
    most = rows.where(observed).groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("most"))
    return segments.select(*keys).distinct().join(most, keys, "left").select(*keys, F.coalesce("most", F.lit(0)).alias("most"))


# ---------------------------------------------------------------- relations


def side(by_segment: Column, minimum: int) -> Column:
    """One direction of looks from a list of (segment, hits, n): share, n and the best segment of ``minimum`` samples or more; null without samples.

    The best is the one with the largest share, of equal ones the one with most samples, then the first.
    """
    n = F.aggregate(by_segment, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    hits = F.aggregate(by_segment, F.lit(0).cast("long"), lambda s, x: s + x["hits"])
    enough = F.transform(F.filter(by_segment, lambda x: x["n"] >= minimum), lambda x: F.struct((x["hits"] / x["n"]).alias("share"), x["n"].alias("n"), (-x["segment"]).alias("back")))
    best = F.array_max(enough)
    peak = F.when(best.isNotNull(), F.struct((-best["back"]).alias("segment"), best["share"].alias("share"), best["n"].alias("n")))
    return F.when(n > 0, F.struct((hits / n).alias("share"), n.alias("n"), peak.alias("peak")))


def evidenced(available: Column, sides: list[Column], floor: float) -> Column:
    """Whether a pair is listed: affect moves together, or a direction's best segment reaches the floor."""
    peaks = [F.coalesce(s["peak"]["share"] >= floor, F.lit(False)) for s in sides]
    return F.coalesce(available, F.lit(False)) | peaks[0] | peaks[1]


def relation(a: Column, b: Column, co_present: Column, ab: Column, ba: Column, synchrony: Column) -> Column:
    """The record of a pair; looks are null when neither direction was measured."""
    looks = F.when(ab.isNotNull() | ba.isNotNull(), F.struct(ab.alias("a_to_b"), ba.alias("b_to_a")))
    return F.struct(F.array(a, b).alias("pair"), co_present.alias("co_present"), looks.alias("looks_at"), synchrony.alias("synchrony"))


# ---------------------------------------------------------------- texts and captions


def texts_with_people(readings: DataFrame, bound: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The first ``keep`` readings of an item (text, rank, variants), with everyone who is bound to a variant, each once, ascending."""
    some = readings.where(c("rank") <= keep)
    people = some.select(*keys, "text", F.explode("variants").alias("variant")).join(bound.select(*keys, c("text").alias("variant"), "person"), [*keys, "variant"])
    people = people.groupBy(*keys, "text").agg(F.array_sort(F.collect_set("person")).alias("persons"))
    return some.join(people, [*keys, "text"], "left").select(*keys, "text", "rank", F.coalesce("persons", F.array().cast("array<int>")).alias("persons"))


def matching_captions(items: DataFrame, captions: DataFrame, item: str) -> DataFrame:
    """Captions whose segment bounds are those of now; else null and why. ``bounds``: array of (start, end) on both sides."""
    both = items.alias("i").join(captions.alias("c"), c(f"i.{item}") == c(f"c.{item}"), "left")
    same = c("i.bounds") == c("c.bounds")
    why = F.when(c("c.caption").isNull(), "none").when(~same, "segments changed")
    return both.select(c(f"i.{item}"), F.when(same, c("c.caption")).alias("caption"), why.alias("gap"))


def hints(parts: DataFrame, item: str, line: str, label: str, weight: str, top: int) -> DataFrame:
    """Lines of an item's leading labels: "line: a, b, c", the heaviest first, lines by name."""
    ranked = parts.groupBy(item, line, label).agg(F.sum(weight).alias("w"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(item, line).orderBy(F.round("w", 9).desc(), label))).where(c("rank") <= top)
    lines = ranked.groupBy(item, line).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", label))), lambda x: x[label])).alias("labels"))
    return lines.groupBy(item).agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(": ", c(line), c("labels"))))).alias("hints"))


# ---------------------------------------------------------------- vectors of a record


def typical_row(rows: DataFrame, item: str, id_: str, vector: str) -> DataFrame:
    """The row of an item with the largest product with its mean vector, the smallest id on ties."""
    from ..functions import vectors as V
    from .entity import mean_unit

    mean = mean_unit(rows, [item], vector).withColumnRenamed("vector", "mean_")
    j = rows.join(mean, item).withColumn("d_", F.round(V.dot(V.unit(c(vector)), c("mean_")), 9))
    return j.groupBy(item).agg(F.min_by(id_, F.struct((-c("d_")).alias("d"), c(id_))).alias(id_))


def nearest_prototype(vectors: DataFrame, keys: list[str], vector: str, prototypes: DataFrame) -> DataFrame:
    """The prototype (number, prototype) most like the mean vector of each group, the first on ties; prototypes are a closed list."""
    from ..functions import vectors as V
    from .entity import mean_unit

    mean = mean_unit(vectors, keys, vector)
    scored = mean.crossJoin(prototypes).withColumn("d_", F.round(V.dot(c("vector"), V.unit(c("prototype"))), 9))
    return scored.groupBy(*keys).agg(F.min_by("number", F.struct((-c("d_")).alias("d"), c("number"))).alias("number"))


def same_label_share(nearest: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of items whose nearest neighbour has their label; one row. ``nearest``: item, other, rank; ``labels``: item, label."""
    own, near = labels.alias("a"), labels.alias("b")
    j = nearest.where("rank = 1").alias("n").join(own, c("n.item") == c("a.item")).join(near, c("n.other") == c("b.item"))
    return j.agg(F.avg((c("a.label") == c("b.label")).cast("int")).alias("share"), F.count(F.lit(1)).alias("items"))


def chance_share(labels: DataFrame, label: str) -> DataFrame:
    """How often two items drawn at random would have one label: sum n (n - 1) / N (N - 1); one row."""
    n = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.try_divide(F.sum(c("n") * (c("n") - 1)), F.sum("n") * (F.sum("n") - 1)).alias("chance"))
