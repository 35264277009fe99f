"""Reports against labels: confusion, ranking, clustering and agreement, with resampled intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.chance import uniform
from ..sources.stored import stored
from .prefixes import running


def confusion(df: DataFrame, truth: str, found: str) -> DataFrame:
    """(truth, found, n) of rows where both are known."""
    return df.where(F.col(truth).isNotNull() & F.col(found).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(found).alias("found")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(cells: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy and the share of the largest class, from confusion cells; one row."""
    by = cells.groupBy("truth").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("found"), F.col("n")).otherwise(0)).alias("hit"))
    return by.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced"), (F.max("n") / F.sum("n")).alias("majority"), F.sum("n").alias("n"))


def binary_rates(df: DataFrame, truth: str, said: str, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and false-positive rate; 0 without any."""
    t, s = F.col(truth).cast("boolean"), F.col(said).cast("boolean")
    c = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    agg = df.groupBy(*keys).agg(c(t & s).alias("tp"), c(~t & s).alias("fp"), c(t & ~s).alias("fn"), c(~t & ~s).alias("tn"))
    rate = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return agg.select(
        *keys, "tp", "fp", "fn", "tn", rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), rate(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr")
    )


def auc(df: DataFrame, keys: list[str], positive: str, score: str) -> DataFrame:
    """Area under the ROC curve with ties at half.

    Positives and negatives are counted by distinct score first; the running sums go over those counts.
    """
    by = df.groupBy(*keys, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("q"))
    before = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = by.withColumn("w", F.col("p") * (F.coalesce(F.sum("q").over(before), F.lit(0)) + F.col("q") / 2))
    return wins.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q")).select(*keys, "p", "q", F.try_divide("w", F.col("p") * F.col("q")).alias("auc"))


def average_precision(df: DataFrame, keys: list[str], positive: str, score: str) -> DataFrame:
    """Sum of precision times recall gained, over distinct scores from the highest."""
    by = df.groupBy(*keys, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumn("precision", F.sum("p").over(w) / F.sum("n").over(w))
    return run.groupBy(*keys).agg(F.try_divide(F.sum(F.col("precision") * F.col("p")), F.sum("p")).alias("ap"))


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ranks within groups, equal values at their mean rank. Without keys all rows are one group, and running sums over ranges of the values rank them."""
    by = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c_"))
    if not keys:
        ranks = running(by.where(F.col(value).isNotNull()), value, ["c_"]).select(value, (F.col("c__before") + (F.col("c_") + 1) / 2).alias(out))
        return df.join(ranks, value)
    before = F.coalesce(F.sum("c_").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(by.select(*keys, value, (before + (F.col("c_") + 1) / 2).alias(out)), [*keys, value])


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of rows where both are known; null below three of them, 0 for a constant side."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(rows, keys, x, "rx_"), keys, y, "ry_")
    agg = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("rx_", "ry_").alias("c"), F.stddev_pop("rx_").alias("sx"), F.stddev_pop("ry_").alias("sy"))
    return agg.select(*keys, "n", F.when(F.col("n") >= 3, F.coalesce(F.try_divide("c", F.col("sx") * F.col("sy")), F.lit(0.0))).alias("rho"))


def kappa(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Cohen's agreement of two yes/no columns; null where chance agrees fully."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    agg = df.groupBy(*keys).agg(F.avg((x == y).cast("double")).alias("same"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return agg.select(*keys, "same", F.try_divide(F.col("same") - chance, 1 - chance).alias("kappa"))


def cluster_scores(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Weighted purity and normalised mutual information of two labellings; one row."""
    cells = confusion(df, truth, found)
    n = F.sum("n").over(Window.partitionBy())
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias("m")) for c in ("truth", "found"))
    total = cells.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))
    purity = cells.groupBy("found").agg(F.max("n").alias("top")).agg(F.sum("top").alias("top"))
    h = lambda d: d.crossJoin(F.broadcast(total)).agg((-F.sum(F.col("m") / F.col("total") * F.log(F.col("m") / F.col("total")))).alias("h"))
    joint = cells.join(rows.withColumnRenamed("m", "mt"), "truth").join(cols.withColumnRenamed("m", "mf"), "found").crossJoin(F.broadcast(total))
    info = joint.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("mt") * F.col("mf")))).alias("i"))
    one = info.crossJoin(h(rows).withColumnRenamed("h", "ht")).crossJoin(h(cols).withColumnRenamed("h", "hf")).crossJoin(purity).crossJoin(total)  # each is one row
    return one.select((F.col("top") / F.col("total")).alias("wcp"), F.try_divide(2 * F.col("i"), F.col("ht") + F.col("hf")).alias("nmi"), F.col("total").alias("n"))


def fuzzy_overlap(first: DataFrame, second: DataFrame, similar: DataFrame, keys: list[str], label: str, floor: float) -> DataFrame:
    """Labels only in the first set, in both (a label of the other is at least ``floor`` similar) and only in the second, per group."""
    sim = similar.where(F.col("sim") >= floor).select("l", "r")
    sides = []
    for own, other, x, y, name in ((first, second, "l", "r", "f"), (second, first, "r", "l", "s")):
        hit = own.select(*keys, F.col(label).alias(x)).join(sim, x).join(other.select(*keys, F.col(label).alias(y)), [*keys, y], "left_semi").select(*keys, F.col(x).alias(label)).distinct().withColumn("hit", F.lit(1))
        agg = own.select(*keys, label).distinct().join(hit, [*keys, label], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.sum(F.coalesce("hit", F.lit(0))).alias(f"{name}_hit"))
        sides.append(agg)
    j = sides[0].join(sides[1], keys, "full")
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.select(*keys, (z("f_n") - z("f_hit")).alias("only_first"), z("f_hit").alias("common"), (z("s_n") - z("s_hit")).alias("only_second"))


def resamples(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, n, n)


#: Chances of at most 0, 1, .. 7 draws.
POISSON = [float(x) for x in np.cumsum([np.exp(-1)] + [np.exp(-1) / float(np.prod(range(1, k + 1))) for k in range(1, 8)])]


def poisson_weight(item: str, seed: int = 0) -> Column:
    """How often an item is drawn in resample ``draw``: Poisson with mean 1, from a seeded hash; weights above 8 are counted as 8 (once in 800,000)."""
    u = uniform(seed, "draw", item)
    return F.aggregate(F.array(*map(F.lit, POISSON)), F.lit(0), lambda n, s: n + (u >= s).cast("int"))


def bootstrap_mean(df: DataFrame, item: str, value: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """Mean of item means with its 95 % interval over items drawn with Poisson weights from a seeded hash; one row.

    Each draw is a weight on every item, so draws are aggregated where the items are and nothing is gathered.
    """
    items = df.groupBy(item).agg(F.avg(value).alias("x"))
    drawn = items.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    means = drawn.withColumn("w", poisson_weight(item, seed)).groupBy("draw").agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("m"))
    ci = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return items.agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("items")).crossJoin(ci).select("mean", "items", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _known(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs (a, b) with both distances known, and the ranks ``rx`` and ``ry`` of these among them."""
    rows = pairs.select("a", "b", F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    return stored(average_ranks(average_ranks(rows, [], "x", "rx"), [], "y", "ry").select("a", "b", "rx", "ry"), "mantel-ranks")


def mantel(pairs: DataFrame, x: str, y: str, permutations: int = 99, seed: int = 0) -> DataFrame:
    """Rank correlation of two distances over pairs (a < b) and its permutation p-value; one row.

    A permutation gives the items each other's names. A pair meets the second distance of the pair that its items stand for by a join, so nothing holds a matrix; ranks do not change by it. Where a
    permuted pair has no distance, it is left out of that permutation. A constant side has correlation 0.
    """
    rows = _known(pairs, x, y)
    items = rows.select(F.col("a").alias("item")).union(rows.select("b")).distinct()
    each = items.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    at = lambda *order: F.row_number().over(Window.partitionBy("perm").orderBy(*order))  # noqa: E731  the items of a permutation, not its pairs
    own = each.select("perm", "item", at("item").alias("pos"))
    hand = each.select("perm", F.col("item").alias("other"), at(F.when(F.col("perm") > 0, uniform(seed, "perm", "item")).otherwise(0.0), "item").alias("pos"))
    names = stored(own.join(hand, ["perm", "pos"]).select("perm", "item", "other"), "mantel-names")
    first, second = (names.select("perm", F.col("item").alias(e), F.col("other").alias(f"{e}_other")) for e in "ab")
    turned = rows.select("a", "b", "rx").join(first, "a").join(second, ["perm", "b"])
    turned = turned.select("perm", "rx", F.least("a_other", "b_other").alias("a"), F.greatest("a_other", "b_other").alias("b")).join(rows.select("a", "b", "ry"), ["a", "b"])
    rho = F.coalesce(F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")), F.lit(0.0))
    each = stored(turned.groupBy("perm").agg(F.round(rho, 12).alias("rho")), "mantel")  # a row a permutation
    own = each.where("perm = 0").select(F.col("rho").alias("own"))
    return each.where("perm > 0").crossJoin(F.broadcast(own)).groupBy("own").agg(((1 + F.sum((F.col("rho") >= F.col("own")).cast("int"))) / (permutations + 1)).alias("p")).select(F.col("own").alias("rho"), "p")


def mantel_interval(pairs: DataFrame, x: str, y: str, draws: int = 100, seed: int = 0) -> DataFrame:
    """Rank correlation of two distances and its 95 % interval over items drawn; one row (rho, low, high).

    An item counts as often as a Poisson weight says, a pair as often as its items together, so an item that is drawn twice is never paired with itself. Ranks are those of the whole collection.
    """
    rows = _known(pairs, x, y)

    def rho(w: Column) -> Column:
        n, sx, sy = F.sum(w), F.sum(w * F.col("rx")), F.sum(w * F.col("ry"))
        cov = F.sum(w * F.col("rx") * F.col("ry")) - sx * sy / n
        return F.try_divide(cov, F.sqrt((F.sum(w * F.col("rx") * F.col("rx")) - sx * sx / n) * (F.sum(w * F.col("ry") * F.col("ry")) - sy * sy / n)))

    many = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", (poisson_weight("a", seed) * poisson_weight("b", seed)).cast("double")).where("w > 0")
    ends = many.groupBy("draw").agg(rho(F.col("w")).alias("rho")).agg(F.percentile("rho", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return rows.agg(rho(F.lit(1.0)).alias("rho")).crossJoin(F.broadcast(ends)).select("rho", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def density(df: DataFrame, value: str, low: float, high: float, bins: int = 480, points: int = 241, width: float = 0.02) -> DataFrame:
    """Gaussian density on a grid of [low, high] from a histogram; ``width`` is the kernel's deviation as a share of the span."""
    span = high - low
    bin_ = F.least(F.floor((F.col(value) - low) / span * bins), F.lit(bins - 1)).cast("int")
    hist = df.where(F.col(value).between(low, high)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    at, mid, s = low + F.col("i") * span / (points - 1), low + (F.col("bin") + 0.5) * span / bins, width * span
    k = F.exp(-F.pow((at - mid) / s, F.lit(2.0)) / 2) / (s * float(np.sqrt(2 * np.pi)))
    return grid.join(F.broadcast(hist)).groupBy("i").agg((F.sum(k * F.col("n")) / F.sum("n")).alias("density")).select("i", (low + F.col("i") * span / (points - 1)).alias("x"), "density")  # at most ``bins`` rows
