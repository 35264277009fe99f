"""What a record shows: parts of bodies in frame, the samples behind values, subsets of keyframes, labelled values, and the lines that hint at an item's content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT

c = F.col

#: Landmarks of each body part, from the head down. Fixed values.
BODY_PARTS = (tuple(range(11)), (11, 12), (13, 14), (23, 24), (25, 26), (27, 28, 29, 30, 31, 32))
#: Heights of heads in pixels and their names. Fixed values.
HEADS = (("under 60 px", 60), ("60-120 px", 120), ("120-240 px", 240), ("240 px and up", None))
#: Labels that a hint line keeps.
HINTS = 5


def parts_seen(points: Column, box: Column, width: Column, height: Column, parts: tuple[tuple[int, ...], ...] = BODY_PARTS) -> Column:
    """Per body part the best visibility of its landmarks that lie in the frame, 0 without any.

    ``points``: array of (x, y, v), places as shares of the box, which is cut at the frame's edges first. A landmark that is missing or null counts as not seen.
    """
    x1, y1 = F.greatest(F.lit(0), box["x1"]), F.greatest(F.lit(0), box["y1"])
    w, h = F.least(width, box["x2"]) - x1, F.least(height, box["y2"]) - y1

    def inside(p: Column) -> Column:
        x, y = x1 + p["x"] * w, y1 + p["y"] * h
        return (x >= 0) & (x < width) & (y >= 0) & (y < height)

    seen = F.transform(points, lambda p: F.when(inside(p), p["v"]).otherwise(F.lit(0.0)))
    best = [F.greatest(F.lit(0.0), *[F.coalesce(F.get(seen, F.lit(i)), F.lit(0.0)) for i in part]) for part in parts]
    return F.array(*[F.round(b, 3) for b in best])


def sample_counts(measured: list[Column], attributes: Column, yaw: Column, gaze: Column) -> Column:
    """The samples behind each value that a person's record shows: those of the measures there are, the most of any attribute, of the head's yaw and of the gaze."""
    most = F.array_max(F.transform(attributes, lambda a: a["n"]))
    return F.array_compact(F.array(*[m.cast("long") for m in (*measured, most, yaw, gaze)]))


def gaze(found: Column) -> Column:
    """A person's gaze as a record shows it: in_frame_share, in_frame (null without samples) and n; null if it was not measured."""
    inside = F.when(found["in_frame"]["n"] > 0, F.struct(*[found["in_frame"][k].alias(k) for k in ("mean", "sd", "median", "n")]))
    return F.when(found.isNotNull(), F.struct(found["in_frame_share"].alias("in_frame_share"), inside.alias("in_frame"), found["n"].alias("n")))


def keyframe_fields(keyframes: Column, names: list[str]) -> Column:
    """One level's share of a segment's keyframes: start, end and the named fields."""
    return F.transform(keyframes, lambda k: F.struct(*[k[n].alias(n) for n in ("start", "end", *names)]))


def keyframe_size(own: Column, segment: Column) -> Column:
    """The shot size over a keyframe's part of a segment; with nobody seen there, the segment's; null without either."""
    return F.coalesce(own, segment)


def head_size(top: Column, bottom: Column) -> Column:
    """The name of a head's height in pixels."""
    height, named = bottom - top, None
    for name, below in HEADS:
        if below is None:
            return named.when(height.isNotNull(), name)
        named = (F if named is None else named).when(height < below, name)
    return named


def split_detections(df: DataFrame, person: Column, score: str, floor: float = DEFAULT.detection_floor) -> tuple[DataFrame, DataFrame]:
    """Persons, whatever their score, for a tracker that needs the dim ones, and objects from ``floor`` on with the score to three places."""
    kept = F.coalesce(person, F.lit(False))
    return df.where(kept), df.where(~kept & (c(score) >= floor)).withColumn(score, F.round(score, 3))


def rounded(value: Column, places: int = 4) -> Column:
    """A distance as a report shows it: rounded, null for NaN."""
    return F.when(~F.isnan(value), F.round(value, places))


def labelled_values(matched: DataFrame, item: str, segment: str, tables: dict[str, tuple[DataFrame, dict[str, Column]]], members: dict[str, DataFrame] | None = None) -> DataFrame:
    """Label rows matched to segments, with the values found for those segments beside them.

    ``tables``: by name a table (item, segment, ...), a row a segment at most, and the columns to take from it; a segment that it lacks gives nulls. ``members``: by name a table of segments; the column
    says 1 or 0. All are left joins on (item, segment), so labels stay whole.
    """
    out = matched
    keys = [item, segment]
    for name, (df, values) in tables.items():
        out = out.join(df.select(*keys, *[v.alias(k) for k, v in values.items()]), keys, "left")
    for name, df in (members or {}).items():
        out = out.join(df.select(*keys).distinct().withColumn(f"{name}_", F.lit(1.0)), keys, "left").withColumn(name, F.coalesce(f"{name}_", F.lit(0.0))).drop(f"{name}_")
    return out


# ---------------------------------------------------------------- hint lines


def people_phrase(most: Column, with_people: Column, duration: Column, mutual: Column, some: Column, addressing: Column) -> Column:
    """How many people are seen at once and for how much of the item, whether they look at each other or at others, and into the camera.

    ``most``: the most people of any segment. ``mutual``: whether a pair looks at each other, ``some`` whether anybody looks at another. ``addressing``: persons who look into the camera. 'none' where nobody was seen.
    """
    visible = F.when(most > 1, F.concat(F.lit("up to "), most.cast("string"), F.lit(" visible at once"))).otherwise("one at a time")
    presence = F.when(with_people >= duration / 2, "most of the video").otherwise("part of the video")
    looks = F.when(mutual, "; some look at each other").when(some, "; some look at others").otherwise("")
    camera = F.when(addressing == 1, "; one looks into the camera").when(addressing > 1, "; some look into the camera").otherwise("")
    return F.when(F.coalesce(most, F.lit(0)) > 0, F.concat(visible, F.lit(", on screen for "), presence, F.coalesce(looks, F.lit("")), F.coalesce(camera, F.lit("")))).otherwise("none")


def best_segment_share(by_segment: Column, minimum: int = DEFAULT.relation_minimum) -> Column:
    """The best share of hits of a look's segments (segment, hits, n) with ``minimum`` samples or more; 0 without such."""
    shares = F.transform(F.filter(by_segment, lambda s: s["n"] >= minimum), lambda s: s["hits"] / s["n"])
    return F.coalesce(F.array_max(shares), F.lit(0.0))


def ranked(weights: DataFrame, item: str, label: str, weight: str, top: int = HINTS) -> DataFrame:
    """(item, labels): an item's heaviest labels, comma-separated, by name on ties."""
    order = Window.partitionBy(item).orderBy(F.round(weight, 9).desc(), label)
    best = weights.groupBy(item, label).agg(F.sum(weight).alias(weight)).withColumn("rank_", F.row_number().over(order)).where(c("rank_") <= top)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank_", label))), lambda x: x[label])
    return best.groupBy(item).agg(F.array_join(listed, ", ").alias("labels"))


def looks(relations: DataFrame, item: str, share: float = DEFAULT.relation_share, minimum: int = DEFAULT.relation_minimum) -> DataFrame:
    """(item, mutual, some) from relations (item, a_to_b, b_to_a: lists of looks by segment): whether a pair reaches ``share`` both ways, and any pair one way."""
    ab, ba = best_segment_share(c("a_to_b"), minimum), best_segment_share(c("b_to_a"), minimum)
    return relations.groupBy(item).agg(F.max(F.least(ab, ba) >= share).alias("mutual"), F.max(F.greatest(ab, ba) >= share).alias("some"))


def addressing(persons: DataFrame, item: str, share: str, n: str, floor: float = 0.5, least: int = 2) -> DataFrame:
    """(item, addressing): persons who look into the camera in ``floor`` of ``least`` samples or more."""
    return persons.groupBy(item).agg(F.count_if((c(n) >= least) & (c(share) >= floor)).alias("addressing"))


def hint_lines(segments: DataFrame, item: str, lists: dict[str, DataFrame], looking: DataFrame, cameras: DataFrame, moves: DataFrame, mediums: DataFrame, top: int = HINTS) -> DataFrame:
    """(item, hints): seven lines on a whole item. ``segments``: item, seconds, most (people at once), peopled.

    ``lists``: tags, regions, objects and animals as (item, label, w), by weight; ``mediums`` and ``moves`` likewise, in seconds. ``looking`` is that of ``looks``, ``cameras`` that of ``addressing``. A line without labels
    says none, or unknown for medium and movement. Every table is aggregated by item before it is joined.
    """
    whole = segments.groupBy(item).agg(F.sum("seconds").alias("duration_"), F.max("most").alias("most_"), F.sum(F.when(c("peopled"), c("seconds")).otherwise(0.0)).alias("with_"))
    named = {**lists, "medium": mediums, "moves": moves.where("label is not null and label <> 'unknown'")}
    for name, df in named.items():
        whole = whole.join(ranked(df, item, "label", "w", 1 if name == "medium" else top).withColumnRenamed("labels", f"{name}_"), item, "left")
    whole = whole.join(looking, item, "left").join(cameras, item, "left")
    people = people_phrase(c("most_"), c("with_"), c("duration_"), F.coalesce("mutual", F.lit(False)), F.coalesce("some", F.lit(False)), F.coalesce("addressing", F.lit(0)))
    line = lambda title, text, none: F.concat(F.lit(f"{title}: "), F.coalesce(text, F.lit(none)))
    return whole.select(
        item,
        F.concat_ws(
            "\n", line("Medium", c("medium_"), "unknown"), line("Scene tags", c("tags_"), "none"), line("Main regions", c("regions_"), "none"), line("Objects detected", c("objects_"), "none"), line("Animals", c("animals_"), "none"), line("People", people, "none"), line("Camera movement", c("moves_"), "unknown")
        ).alias("hints"),
    )


