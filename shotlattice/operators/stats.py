"""Statistics, distributions and weighted aggregates by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, min, max, variance and mad of the values that are not null; below two of them variance and mad are null.

    The median of deviations takes a second aggregation over the same groups: the median joins back by key, so no group is gathered in one row.
    """
    x = F.col(value)
    base = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), F.var_samp(x).alias("variance")
    )
    off = df.join(base.select(*keys, "median"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))
    return base.join(off, keys).withColumn("mad", F.when(F.col("n") >= 2, F.col("mad")))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1.4826 times the median absolute deviation."""
    return stats(df, keys, value).select(*keys, (1.4826 * F.col("mad")).alias("spread"))


def distribution(df: DataFrame, keys: list[str], row: str, label: str, p: str) -> DataFrame:
    """Mean share of every label over rows (absent is 0), the modal label (first by name on ties; shares tie that agree to twelve places, as sums over rows differ in the last bits) and the share of rows whose own best label it is.

    ``df`` is long: one line per key, row and label.
    """
    best = df.groupBy(*keys, row).agg(F.min_by(F.col(label), F.struct((-F.col(p)).alias("x"), F.col(label).alias("l"))).alias(label))
    none = F.lit(0).cast("long")
    both = df.select(*keys, label, F.col(p).alias("p_"), none.alias("votes_")).unionByName(best.select(*keys, label, (none * 1.0).alias("p_"), (none + 1).alias("votes_")))
    sums = both.groupBy(*keys, label).agg(F.sum("p_").alias("total_"), F.sum("votes_").alias("votes_"))
    whole = Window.partitionBy(*keys)  # the labels of a group, not its rows
    shares = sums.withColumn("rows_", F.sum("votes_").over(whole)).withColumn("share", F.col("total_") / F.col("rows_"))
    named = shares.withColumn("modal", F.min_by(F.col(label), F.struct((-F.round("share", 12)).alias("x"), F.col(label).alias("l"))).over(whole))
    agreement = F.sum(F.when(F.col(label) == F.col("modal"), F.col("votes_")).otherwise(0)).over(whole) / F.col("rows_")
    return named.select(*keys, label, "share", "modal", agreement.alias("agreement"))


def labelled(df: DataFrame, keys: list[str], label: str, score: str, top: int) -> DataFrame:
    """Labels ranked by count, then mean score, then name; the first ``top`` of each group."""
    counted = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("score").desc(), F.col(label))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def temporal_union(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """First and last frame, distinct frames and the most rows on one frame."""
    each = df.groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy(*keys).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count(F.lit(1)).alias("frame_count"), F.max("c").alias("max_per_frame"))


def weighted(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean and population deviation; null without weight, deviation null for a single value.

    The deviation is taken about the mean in a second pass, not from a difference of squares.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).select(*keys, F.col(value).alias("x_"), F.col(weight).alias("w_"))
    mean = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("w_").alias("total_"), F.sum(F.col("x_") * F.col("w_")).alias("s_"))
    mean = mean.select(*keys, "n", "total_", F.when(F.col("total_") > 0, F.col("s_") / F.col("total_")).alias("mean"))
    off = rows.join(mean, keys).groupBy(*keys).agg(F.sum(F.col("w_") * F.pow(F.col("x_") - F.col("mean"), F.lit(2.0))).alias("q_"))
    return mean.join(off, keys).select(*keys, "n", "mean", F.when((F.col("n") > 1) & (F.col("total_") > 0), F.sqrt(F.col("q_") / F.col("total_"))).alias("sd"))


def mix(df: DataFrame, keys: list[str], label: str, weight: str, out: str = "share") -> DataFrame:
    """Weights by label over their sum; groups without positive weight and null labels drop out."""
    rows = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.sum(weight).alias("w"))
    total = rows.groupBy(*keys).agg(F.sum("w").alias("total")).where("total > 0")
    return rows.join(total, keys).select(*keys, label, (F.col("w") / F.col("total")).alias(out))


def ratio(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """sum(x w), sum(w) and their quotient, null unless the weight is positive."""
    s = df.groupBy(*keys).agg(F.sum(F.col(value) * F.col(weight)).alias("top"), F.sum(weight).alias("bottom"))
    return s.withColumn("ratio", F.when(F.col("bottom") > 0, F.col("top") / F.col("bottom")))


def palette_merge(df: DataFrame, keys: list[str], image: str, cell: str, share: str, channels: list[str], top: int) -> DataFrame:
    """Colour cells over images: mean share an image, share-weighted mean channels, the largest ``top`` by (share, channels)."""
    images = df.groupBy(*keys).agg(F.countDistinct(image).alias("images"))
    cells = df.groupBy(*keys, cell).agg(F.sum(share).alias("w"), *[F.sum(F.col(c) * F.col(share)).alias(c) for c in channels]).where("w > 0")
    cells = cells.join(images, keys).select(*keys, cell, (F.col("w") / F.col("images")).alias("share"), *[(F.col(c) / F.col("w")).alias(c) for c in channels])
    order = Window.partitionBy(*keys).orderBy(F.col("share").desc(), *channels, cell)
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def histogram_merge(df: DataFrame, keys: list[str], bin_: str, share: str, weight: str) -> DataFrame:
    """Weighted mean of histograms, bin by bin."""
    total = df.groupBy(*keys).agg(F.sum(weight).alias("w"))
    return df.groupBy(*keys, bin_).agg(F.sum(F.col(share) * F.col(weight)).alias("s")).join(total.where("w > 0"), keys).select(*keys, bin_, (F.col("s") / F.col("w")).alias("share"))


def things(df: DataFrame, keys: list[str], x: str, y: str, size: str) -> DataFrame:
    """Means of place and size, and the spread of places, null for a single one."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(size).alias("size"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"))
    return agg.select(*keys, "n", "x", "y", "size", F.sqrt(F.col("vx") + F.col("vy")).alias("spread"))


def numeric_report(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, population deviation and the percentiles 5, 25, 50, 75, 95."""
    q = F.percentile(value, F.array(*[F.lit(v) for v in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), q.alias("q"))
    return out.select(*keys, "n", "mean", "sd", *[F.col("q")[i].alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))])


def categorical_report(df: DataFrame, labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Counts and shares of every label of the vocabulary, zero ones too."""
    groups = df.select(*keys).distinct()
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    all_ = groups.crossJoin(labels.select(label).distinct())  # every group has every label by definition; Spark broadcasts the vocabulary if it is small
    full = all_.join(counts, [*keys, label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return full.join(total, keys).select(*keys, label, "n", (F.col("n") / F.col("total")).alias("share"))


def conditional_share(df: DataFrame, keys: list[str], holds: Column, known: Column) -> DataFrame:
    """Of the rows where ``known``, the share where ``holds``; with their number."""
    return df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(holds.cast("double")).alias("share"))


def top_by(df: DataFrame, keys: list[str], order: list[Column], top: int, rank: str = "rank") -> DataFrame:
    """The first ``top`` rows of each group."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= top)


def exclusive_top(df: DataFrame, keys: list[str], label: str, order: list[str], pairs: list[tuple[str, str]], keep: int) -> DataFrame:
    """Greedy choice of ``keep`` labels in order, leaving out any that a kept one excludes; kept and dropped labels as arrays.

    A group's labels are a closed vocabulary, so the array they are folded over is small.
    """
    ranked = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, label))).alias("all"))
    either = [*pairs, *((b, a) for a, b in pairs)]
    against = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in either])
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("kept"), empty.alias("dropped"))

    def step(acc, item):
        name = item[label]
        clash = F.exists(against, lambda p: (p["a"] == name) & F.array_contains(acc["kept"], p["b"]))
        full = F.size(acc["kept"]) >= keep
        return F.when(full, acc).when(clash, F.struct(acc["kept"].alias("kept"), F.array_append(acc["dropped"], name).alias("dropped"))).otherwise(F.struct(F.array_append(acc["kept"], name).alias("kept"), acc["dropped"].alias("dropped")))

    return ranked.select(*keys, F.aggregate("all", start, step).alias("r")).select(*keys, "r.kept", "r.dropped")


def suppressed(boxes: Column, threshold: float) -> Column:
    """Greedy non-maximum suppression of an array of structs (score, box fields), best first."""
    from ..functions import geometry as G

    order = F.reverse(F.array_sort(boxes))
    none = F.slice(order, 1, 0)
    return F.aggregate(order, none, lambda kept, b: F.when(F.exists(kept, lambda k: G.iou(k, b) >= threshold), kept).otherwise(F.array_append(kept, b)))
