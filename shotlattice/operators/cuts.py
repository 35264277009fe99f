"""Cuts between shots that are known with gaps: what was found inside a gap can't be judged, so it is taken out before matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .joins import greedy_matches


def true_cuts(truth: DataFrame, key: str, at: str) -> DataFrame:
    """(key, at) of the cuts between the spans (key, start, end) of an item: every start but the first, and the frame after each end that a gap follows."""
    order = Window.partitionBy(key).orderBy("start", "end")
    spans = truth.withColumns({"next_": F.lead("start").over(order), "place_": F.row_number().over(order)})
    starts = F.when(F.col("place_") > 1, F.col("start"))
    ends = F.when(F.col("next_") - F.col("end") > 1, F.col("end") + 1)
    return spans.select(key, F.explode(F.array_compact(F.array(starts, ends))).alias(at))


def outside_gaps(truth: DataFrame, found: DataFrame, key: str, at: str, tolerance: int) -> DataFrame:
    """The found cuts (key, at) that lie inside the hull of an item's spans, after its first frame, and not inside a gap by more than ``tolerance`` from both its ends.

    Each found cut meets the last span that starts at or before it: spans and cuts are put in one order per item and the span is carried forward, so no pair of a span and a cut is made.
    """
    order = Window.partitionBy(key).orderBy("start", "end")
    spans = truth.select(F.col(key), F.col("start").alias(at), F.struct("end", F.lead("start").over(order).alias("next"), F.min("start").over(Window.partitionBy(key)).alias("first"), F.max("end").over(Window.partitionBy(key)).alias("last")).alias("span_"))
    rows = spans.withColumn("kind_", F.lit(0)).unionByName(found.select(key, at).withColumns({"span_": F.lit(None).cast(spans.schema["span_"].dataType), "kind_": F.lit(1)}))
    held = F.last("span_", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = rows.withColumn("s_", held).where("kind_ = 1 and s_ is not null")
    s = lambda name: F.col(f"s_.{name}")
    inside = (F.col(at) > s("first")) & (F.col(at) <= s("last"))
    gap = (s("next") - s("end") > 1) & (F.col(at) > s("end") + 1 + tolerance) & (F.col(at) < s("next") - tolerance)
    return cuts.where(inside & ~F.coalesce(gap, F.lit(False))).select(key, at)


def gap_aware_matches(truth: DataFrame, found: DataFrame, key: str, at: str, tolerance: int) -> DataFrame:
    """Per item the true cuts, the found ones outside the gaps and how many meet one to one within ``tolerance``; items without any have zeros."""
    got = greedy_matches(true_cuts(truth, key, at), outside_gaps(truth, found, key, at, tolerance), key, at, tolerance)
    zero = F.lit(0).cast("long")
    return truth.select(key).distinct().join(got, key, "left").select(key, *[F.coalesce(c, zero).alias(c) for c in ("truth", "found", "hits")])
