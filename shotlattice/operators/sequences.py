"""Ordered rows: schedules, gaps, cells, arcs and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def normalise_ranges(df: DataFrame, keys: list[str], start: str, end: str, count: str) -> DataFrame:
    """Closed ranges in order, each cut before the next one's start and to [0, count - 1]; empty ones drop out, and a group left without any gets the whole."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    cut = df.withColumn("next_", F.lead(start).over(order))
    lo = F.greatest(F.col(start), F.lit(0))
    hi = F.least(F.col(end), F.coalesce(F.col("next_") - 1, F.col(end)), F.col(count) - 1)
    kept = cut.select(*keys, lo.alias(start), hi.alias(end)).where(F.col(start) <= F.col(end))
    whole = df.groupBy(*keys).agg(F.max(count).alias("c_")).join(kept.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(whole.select(*keys, F.lit(0).cast(kept.schema[start].dataType).alias(start), (F.col("c_") - 1).cast(kept.schema[end].dataType).alias(end)))


def schedule(df: DataFrame, keys: list[str], start: str, end: str, stride: int) -> DataFrame:
    """Every ``stride``-th frame of a closed range, and its last."""
    frames = F.array_distinct(F.array_append(F.sequence(F.col(start), F.col(end), F.lit(stride).cast("long")), F.col(end)))
    return df.select(*keys, F.explode(frames).alias("frame"))


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Rows with the number (from 0) of the run of overlapping ranges they are in: a new run starts beyond the furthest end so far by more than ``gap``."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flag = F.when(before.isNotNull() & (F.col(start) > before + gap), 1).otherwise(0)
    return df.withColumn("new_", flag).withColumn("island", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("new_")


def interpolate(df: DataFrame, keys: list[str], frame: str, values: list[str], max_gap: int) -> DataFrame:
    """Observed rows and, between neighbours at most ``max_gap`` frames apart, linear ones; ``interpolated`` tells them apart. Wider gaps stay."""
    order = Window.partitionBy(*keys).orderBy(frame)
    nexts = df.withColumn("f2_", F.lead(frame).over(order))
    for v in values:
        nexts = nexts.withColumn(f"{v}_next_", F.lead(v).over(order))
    short = (F.col("f2_") - F.col(frame)).between(2, max_gap)
    last = F.when(short, F.col("f2_") - 1).otherwise(F.col(frame))
    spread = nexts.withColumn("at_", F.explode(F.sequence(F.col(frame), last)))
    t = (F.col("at_") - F.col(frame)) / (F.col("f2_") - F.col(frame))
    lerp = lambda v: F.when(F.col("at_") == F.col(frame), F.col(v)).otherwise(F.col(v) + (F.col(f"{v}_next_") - F.col(v)) * t)
    return spread.select(*keys, F.col("at_").alias(frame), *[lerp(v).alias(v) for v in values], (F.col("at_") != F.col(frame)).alias("interpolated"))


def stride(df: DataFrame, keys: list[str], order: list[str], step: int) -> DataFrame:
    """Every ``step``-th row of each group, the first one too."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("place_", place).where(F.pmod("place_", F.lit(step)) == 0).drop("place_")


def span_best(df: DataFrame, keys: list[str], order: list[str], score: str, count: int) -> DataFrame:
    """The best row of each of ``count`` equal spans of an ordered group (of as many as it has rows); the first on ties."""
    group, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn("n_", F.count(F.lit(1)).over(group)).withColumn("i_", F.row_number().over(w) - 1)
    k = F.least(F.lit(count), F.col("n_"))
    # span j holds the places from floor(j n / k) to before floor((j + 1) n / k)
    placed = placed.withColumn("span", F.floor((k * (F.col("i_") + 1) - 1) / F.col("n_")).cast("int"))
    best = Window.partitionBy(*keys, "span").orderBy(F.col(score).desc(), "i_")
    return placed.withColumn("r_", F.row_number().over(best)).where("r_ = 1").drop("n_", "i_", "r_")


def relative_score(df: DataFrame, keys: list[str], parts: list[str], default: dict[str, float] | None = None) -> Column:
    """Product of parts, each over its group's largest (1 where that is 0)."""
    out = F.lit(1.0)
    for p in parts:
        top = F.max(p).over(Window.partitionBy(*keys))
        out = out * F.when(top > 0, F.col(p) / top).otherwise(F.lit(1.0))
    return out


def cells(keyframes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Half-open cells [low, high) around keyframes, cut midway between neighbours; open (null) at either end."""
    order = Window.partitionBy(*keys).orderBy(at)
    low, high = (F.lag(at).over(order) + F.col(at)) / 2, (F.lead(at).over(order) + F.col(at)) / 2
    return keyframes.withColumn("low", low).withColumn("high", high)


def in_cells(samples: DataFrame, cell: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Samples with the cell of their group that holds them; the range condition runs inside the equal keys."""
    s, c = samples.alias("s"), cell.alias("c")
    on = [F.col(f"s.{k}") == F.col(f"c.{k}") for k in keys]
    on += [(F.col("c.low").isNull() | (F.col(f"s.{at}") >= F.col("c.low"))) & (F.col("c.high").isNull() | (F.col(f"s.{at}") < F.col("c.high")))]
    return s.join(c, on).select("s.*", *[F.col(f"c.{x}").alias(f"cell_{x}") for x in cell.columns if x not in keys])


def flat_step(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Half the median of all steps that are not 0, over all groups; 0 without any. One row."""
    steps = df.withColumn("step_", F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))).where("step_ > 0")
    return steps.agg(F.coalesce(F.percentile("step_", F.lit(0.5)) / 2, F.lit(0.0)).alias("flat"))


def transitions(df: DataFrame, keys: list[str], order: list[str], state: str, weight: str) -> DataFrame:
    """Shares of consecutive pairs "a > b", weighted by the durations of both; groups of one row have none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    pairs = df.withColumn("next_", F.lead(state).over(w)).withColumn("w_", F.col(weight) + F.lead(weight).over(w)).where("next_ is not null")
    moved = pairs.groupBy(*keys, F.concat(F.col(state), F.lit(" > "), F.col("next_")).alias("change")).agg(F.sum("w_").alias("w"))
    total = moved.groupBy(*keys).agg(F.sum("w").alias("t")).where("t > 0")
    return moved.join(total, keys).select(*keys, "change", (F.col("w") / F.col("t")).alias("share"))


def trend(value: str, flat: Column, keys: list[str], order: list[str]) -> Column:
    """rising, falling or flat against the row before; null for the first."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return F.when(step > flat, "rising").when(step < -flat, "falling").when(step.isNotNull(), "flat")


def instants(segments: DataFrame, keys: list[str], start: str, end: str, count: int) -> DataFrame:
    """``count`` evenly spaced instants of each group and the first segment that ends after each, else the last."""
    span = segments.groupBy(*keys).agg(F.max(end).alias("stop_"))
    at = span.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"), "stop_").withColumn("instant", F.col("stop_") * (F.col("i") + 0.5) / count)
    joined = at.join(segments, keys)
    first = Window.partitionBy(*keys, "i").orderBy((F.col(end) <= F.col("instant")).cast("int"), F.when(F.col(end) > F.col("instant"), F.col(end)).otherwise(-F.col(end)), start)
    return joined.withColumn("r_", F.row_number().over(first)).where("r_ = 1").drop("r_", "stop_")


def yields(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows that give up a place that several claim: all but the first by ``order``."""
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("r_ > 1").drop("r_")


def held(df: DataFrame, keys: list[str], order: str, value: str, width: int) -> Column:
    """The latest value at or before a row, at most ``width`` back; null beyond."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(-width, 0))
