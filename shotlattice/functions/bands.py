"""Numbers to names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import DEFAULT


def crowd(count: Column) -> Column:
    return F.when(count <= 0, "none").when(count == 1, "single").when(count <= 2, "couple").when(count <= 5, "group").otherwise("crowd")


def assess(at_once: Column, followed: Column) -> Column:
    """Whether the tracks followed fit the most seen at once."""
    return F.when((at_once == 0) & (followed == 0), "empty").when(followed < at_once, "under_tracked").when(followed > 2 * at_once, "turnover_or_fragmented").otherwise("consistent")


def temperature(warmth: Column) -> Column:
    return F.when(warmth > 5, "warm").when(warmth < -5, "cool").when(warmth.isNotNull(), "neutral")


def indoor_outdoor(p: Column) -> Column:
    return F.when(p >= DEFAULT.outdoor, "outdoor").when(p.isNotNull(), "indoor")


def thirds(value: Column, names: tuple[str, str, str]) -> Column:
    return F.when(value < 1 / 3, names[0]).when(value > 2 / 3, names[2]).when(value.isNotNull(), names[1])


def shot_size(face: Column, body: Column) -> Column:
    """Shot size from the shares of the frame's height that the largest face and body take."""
    return (
        F.when(face >= 0.75, "extreme close-up").when(face >= 0.33, "close-up").when(face >= 0.125, "medium").when(body >= 1, "medium long").when(body >= 0.25, "long").otherwise("extreme long")
    )


def ordinal(count: Column, last: int) -> Column:
    """Counts from ``last`` on share a bin."""
    return F.when(count >= last, F.lit(f"{last}+")).otherwise(count.cast("string"))


def group_size(n: Column) -> Column:
    return F.when(n <= 1, "0-1").when(n <= 2, "2").when(n <= 6, "3-6").when(n <= 12, "7-12").when(n <= 30, "13-30").otherwise("31+")


def verdict(low: Column, high: Column, least: Column, most: Column) -> Column:
    """pass if the interval lies inside the bounds, fail if it lies outside, else weak."""
    return F.when((low >= least) & (high <= most), "pass").when((high < least) | (low > most), "fail").otherwise("weak")


def confidence(samples: Column) -> Column:
    """Grade of the median of an array of sample counts."""
    s = F.array_sort(samples)
    n = F.size(s)
    median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when(n == 0, "low").when(median >= 10, "good").when(median >= 3, "moderate").otherwise("low")


def framing(face: Column, body: Column, ratio: Column, prototype: Column, portrait: float = 0.05) -> Column:
    """(scale, source, scene): size by the median face and body where somebody was followed, else the prototype's, and no scene."""
    seen = face.isNotNull() | body.isNotNull()
    size = shot_size(F.coalesce(face, F.lit(0.0)), F.coalesce(body, F.lit(0.0)))
    return F.struct(
        F.when(seen, size).otherwise(prototype).alias("scale"),
        F.when(seen, "measured").when(prototype.isNotNull(), "prototype").alias("source"),
        F.when(seen, F.when(ratio >= portrait, "portrait").otherwise("scene")).alias("scene"),
    )


def tight_half(value: Column, low: float, high: float) -> Column:
    """Whether a measure lies in the larger half of its band."""
    return value >= (low + high) / 2


def chosen(options: Column, here: Column, tight: Column) -> Column:
    """The name of the option (name, places) nearest a place on an ordinal scale; of equally near ones the one with the smaller least place if ``tight``, else the larger (then by name)."""
    gap = lambda o: F.array_min(F.transform(o["places"], lambda p: F.abs(p - here)))
    nearest = F.array_min(F.transform(options, gap))
    near = F.filter(options, lambda o: gap(o) == nearest)
    place = lambda sign: F.array_min(F.transform(near, lambda o: F.struct((sign * F.array_min(o["places"])).alias("at"), o["name"].alias("name"))))["name"]
    return F.when(tight, place(1)).otherwise(place(-1))


def measured_step(masked: Column, whole: Column, people: Column) -> Column:
    """Which fit of a frame pair holds: 1 off people, 0 nobody there, 2 the whole frame after the masked fit failed, -1 none."""
    return F.when(masked.isNotNull(), 1).when(whole.isNull(), -1).when(~people, 0).otherwise(2)
