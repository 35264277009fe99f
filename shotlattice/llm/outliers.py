"""Quality rules: base rules on each text, then robust multivariate outliers by language and source.

All of it is DataFrame expressions. A text's statistics come from its own arrays, so there is no shuffle of words. The minimum-covariance-determinant
estimate of each group of equal language and source is sought from several starts, all of them fixed by the data: the median with the least spreads, the median with
the median absolute deviations, and the plain mean and covariance. From each, concentration steps are made (the three quarters of the group's documents nearest by Mahalanobis distance
give the next mean and covariance) until no determinant falls any more; of a group's estimates the one with the least determinant is taken, of equal ones the first
start's. All groups and starts take a step together. Statistics are whole numbers (steps of 1/1024), so sums are exact and no
result depends on the order of rows; medians and distance ranks come from counts of distinct whole numbers, of which there are few thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, dropped, let, words, written

STEP = 1024
#: Statistic vector: name and least spread, a regulariser of singular covariances. Those of word_length and capitals are no more than the spread of clean text; the
#: others stand in for the none that most clean text shows: with 0.08 one repeated line of a text is no outlier, a tenth of its lines are. Its square times CUTOFF is well below what each feature can
#: reach, so each can reject by itself.
FEATURES = (("word_length", 0.03), ("symbols", 0.05), ("dup_lines", 0.08), ("repeats", 0.08), ("capitals", 0.01))
DIMS = len(FEATURES)
KEEP = 0.75
#: Concentration steps at most, and the fall of a determinant's logarithm that counts as one.
STEPS, FALL = 12, 1e-3
#: Pseudo-documents by which a small group leans on the whole corpus.
PRIOR = 30
#: Chi-square quantile 0.9999 with 5 degrees of freedom, and the consistency factor of the covariance of the nearest three quarters, with what
#: the heavier tails of text statistics ask for (1.41 for normal ones).
CUTOFF, CONSISTENT = 25.74, 1.52


def repeat_words(ws: Column, width: int = 8) -> Column:
    """Words in windows of ``width`` words that are found twice or more in the array."""
    n = F.size(ws)
    hashes = F.transform(F.sequence(F.lit(1), n - F.lit(width - 1)), lambda i: F.xxhash64(F.slice(ws, i, F.lit(width))))

    def covered(hs: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            at = F.sort_array(F.transform(twice, lambda x: x["i"].cast("long")))
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
            return F.aggregate(at, zero, lambda a, p: F.struct((a["n"] + p + width - F.greatest(p, a["end"])).alias("n"), (p + width).alias("end")), lambda a: a["n"])

        keyed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(keyed, places))

    return F.when(n <= width, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def statistics(text: Column) -> Column:
    """Struct of the base statistics of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup")))
    of_words = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), F.length(F.array_join(ws, "")).cast("long").alias("chars"), repeat_words(ws).alias("repeat")))
    s = F.struct(of_words.alias("w"), of_lines.alias("l"), count(r"[#*$%&|<>]").alias("symbols"), count(r"\p{Lu}").alias("upper"))
    return let(
        s,
        lambda s: F.struct(
            s["w"]["n"].alias("n_words"),
            s["w"]["chars"].alias("word_chars"),
            s["symbols"].alias("n_symbols"),
            s["l"]["dup"].alias("n_dup_lines"),
            s["w"]["repeat"].alias("n_repeat_words"),
            s["l"]["n"].alias("n_lines"),
            s["upper"].alias("n_upper"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> list[Column]:
    """The transformed statistics in whole steps; shares are drawn to what is usual in short texts."""
    c = F.col
    values = (
        F.log((c("word_chars") + 110) / (c("n_words") + 20)),
        F.sqrt(c("n_symbols") / (c("n_words") + 20)),
        F.sqrt(c("n_dup_lines") / (c("n_lines") + 10)),
        F.sqrt(c("n_repeat_words") / (c("n_words") + 20)),
        F.sqrt(c("n_upper") / (c("word_chars") + 100)),
    )
    return [F.least(F.round(v * STEP), F.lit(16.0 * STEP)).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


X = [f"x{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
GROUP = ("lang", "source")


def _same(a: DataFrame, b: DataFrame) -> list[Column]:
    return [a[g].eqNullSafe(b[g]) for g in GROUP]


def distance(df: DataFrame) -> Column:
    """Squared Mahalanobis distance of the row's x to the group's center m with the lower factor l of its covariance."""
    z: list[Column] = []
    for i in range(DIMS):
        rest = F.col(f"x{i}") / F.lit(float(STEP)) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
        z.append(F.col(f"z{i}") * F.col(f"z{i}"))
    return df.withColumn("d2", sum(z[1:], z[0])).drop(*[f"z{i}" for i in range(DIMS)])


def factored(df: DataFrame) -> DataFrame:
    """Columns s<i><j> (covariance) become l<i><j>, its Cholesky factor; the least spreads keep it positive."""
    for i in range(DIMS):
        for j in range(i + 1):
            rest = F.col(f"s{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FEATURES[i][1] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return df.drop(*[f"s{i}{j}" for i, j in PAIRS])


M = [f"m{i}" for i in range(DIMS)]
L = [f"l{i}{j}" for i, j in PAIRS]


def with_determinant(df: DataFrame) -> DataFrame:
    """The logarithm of the covariance's determinant added as log_det."""
    logs = [2 * F.log(f"l{i}{i}") for i in range(DIMS)]
    return df.withColumn("log_det", sum(logs[1:], logs[0]))


def moments(rows: DataFrame, by: tuple[str, ...], factor: float) -> DataFrame:
    """Center and factor of the covariance (times ``factor``) of the rows' x by ``by``, each leaning on the whole of its start."""
    product = lambda i, j: F.sum(F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(38,0)").alias(f"p{i}{j}")
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"t{i}") for i, c in enumerate(X)], *[product(i, j) for i, j in PAIRS])
    whole = sums.groupBy("start").agg(F.sum("n").alias("all_n"), *[F.sum(f"t{i}").alias(f"all_t{i}") for i in range(DIMS)])
    both = sums.join(F.broadcast(whole), "start")  # one row a start beside each group's
    n = F.col("n").cast("double")
    mean = lambda i: F.col(f"t{i}") / n / STEP
    moved = lambda i: (n * mean(i) + PRIOR * F.col(f"all_t{i}") / F.col("all_n") / STEP) / (n + PRIOR)
    cov = lambda i, j: factor * n / (n + PRIOR) * (F.col(f"p{i}{j}").cast("double") / n / (STEP * STEP) - mean(i) * mean(j))
    least = lambda i: F.lit(FEATURES[i][1] ** 2)
    out = both.select(*by, *[moved(i).alias(f"m{i}") for i in range(DIMS)], *[(cov(i, j) + least(i) if i == j else cov(i, j)).alias(f"s{i}{j}") for i, j in PAIRS])
    return with_determinant(factored(out)).select(*by, *M, *L, "log_det")


def starts(x: DataFrame) -> DataFrame:
    """The first estimates of each group, by the number ``start``: 1 median and least spreads, 2 median and median absolute deviations, 3 mean and covariance."""
    whole = x.agg(*[F.percentile(c, F.lit(0.5)).alias(f"g{i}") for i, c in enumerate(X)])
    groups = x.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(c, F.lit(0.5)).alias(f"c{i}") for i, c in enumerate(X)])
    groups = written(groups, "medians")
    beside = x.join(groups, _same(x, groups)).select(*[x[g] for g in GROUP], *[F.abs(F.col(f"x{i}") - F.col(f"c{i}")).alias(f"y{i}") for i in range(DIMS)])
    spreads = beside.groupBy(*GROUP).agg(*[(F.percentile(f"y{i}", F.lit(0.5)) * 1.4826 / STEP).alias(f"d{i}") for i in range(DIMS)])
    blend = lambda i: (F.col("n") * F.col(f"c{i}") + PRIOR * F.col(f"g{i}")) / (F.col("n") + PRIOR) / F.lit(float(STEP))
    groups = groups.join(spreads, _same(groups, spreads)).select(*[groups[g] for g in GROUP], "n", *[f"c{i}" for i in range(DIMS)], *[f"d{i}" for i in range(DIMS)])
    groups = groups.crossJoin(F.broadcast(whole)).select(*GROUP, *[blend(i).alias(f"m{i}") for i in range(DIMS)], *[f"d{i}" for i in range(DIMS)])  # one row beside each group's
    least = lambda i: F.lit(FEATURES[i][1])
    diagonal = lambda spread: [spread(i).alias(f"l{i}{j}") if i == j else F.lit(0.0).alias(f"l{i}{j}") for i, j in PAIRS]
    one = groups.select(*GROUP, F.lit(1).alias("start"), *M, *diagonal(lambda i: least(i) * 1.5))
    two = groups.select(*GROUP, F.lit(2).alias("start"), *M, *diagonal(lambda i: F.sqrt(F.col(f"d{i}") ** 2 + least(i) ** 2)))
    three = moments(x.withColumn("start", F.lit(3)), (*GROUP, "start"), 1.0)
    return with_determinant(one.unionByName(two)).unionByName(three)


def concentrated(x: DataFrame, estimate: DataFrame, few: bool) -> DataFrame:
    """One concentration step of every start: mean and covariance of each group's nearest three quarters; ``few``: the estimates may be sent to all."""
    spaced = distance(x.join(F.broadcast(estimate) if few else estimate, _same(x, estimate)).select(*[x[g] for g in GROUP], "start", *X, *M, *L))
    ranked = spaced.withColumn("q", F.least(F.floor(F.log1p("d2") * 64), F.lit(4096)).cast("long")).select(*GROUP, "start", *X, "q")
    limit = written(ranked.groupBy(*GROUP, "start").agg(F.percentile("q", F.lit(KEEP)).alias("limit")), "limits")
    near = ranked.join(limit, [*_same(ranked, limit), ranked["start"] == limit["start"]]).where("q <= limit").select(*[ranked[g] for g in GROUP], ranked["start"], *X)
    out = written(moments(near, (*GROUP, "start"), CONSISTENT), "estimates")
    dropped(limit)
    return out


def _few(estimate: DataFrame) -> bool:
    """Whether a table of estimates is small enough to be sent to all: at most 20,000 rows of 200 bytes."""
    return estimate.limit(20_001).count() <= 20_000


def estimates(x: DataFrame, steps: int = STEPS) -> DataFrame:
    """Center, factor, log_det and start by (lang, source) of a table with lang, source and x0..: of all starts the least determinant reached.

    Texts that fail the base rules are to be left out by the caller. The first step of any start may raise its determinant, as it starts from other spreads; later ones go on while some determinant falls
    by more than ``FALL``, at most ``steps`` times in all.
    """
    now = written(starts(x), "estimates")
    few = _few(now)
    for step in range(steps):
        new = concentrated(x, now, few)
        old = now.select(*GROUP, "start", F.col("log_det").alias("before"))
        fell = step == 0 or not new.join(old, [*_same(new, old), new["start"] == old["start"]]).where(F.col("log_det") < F.col("before") - FALL).isEmpty()
        dropped(now)
        now = new
        if not fell:
            break
    best = F.min_by(F.struct("start", *M, *L, "log_det"), F.struct(F.round("log_det", 6), "start")).alias("best")
    return written(now.groupBy(*GROUP).agg(best).select(*GROUP, "best.*"), "estimates")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the base statistics, base_failed and the statistic vector added as columns."""
    s = docs.withColumn("stats_", statistics(F.col("text")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
    return s.select("*", *[F.col("stats_")[n].alias(n) for n in names]).drop("stats_").withColumn("base_failed", base_failed()).select("*", *features())


def verdict(rows: DataFrame, estimate: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``rows`` (from ``measured``) with the columns d2, log_det and kept; a group without an estimate keeps what the base rules keep."""
    other = [*M, *L, "log_det"]
    joined = rows.join(estimate, _same(rows, estimate), "left").select(*[rows[c] for c in rows.columns], *[estimate[c] for c in other])
    return distance(joined).drop(*M, *L).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True)))


def robust_outliers(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2, log_det (of its group's covariance).

    A null text is empty and fails the base rules; texts of any length are measured whole. Null language or source are groups of their own. Repeated rows are judged alike, and so are
    documents with equal statistics. An empty table gives an empty result. Other columns are not read.
    """
    rows = written(measured(docs.select("doc_id", "lang", "source", "text")).drop("text"), "statistics")
    out = verdict(rows, estimates(rows.where("not base_failed").select(*GROUP, *X)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2", "log_det")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that neither the base rules nor the estimates reject."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "lang", "source", "text")
    rows = written(measured(rows).select("row", *GROUP, "base_failed", *X), "statistics")  # beside their rows, so that texts are measured once
    return verdict(rows, estimates(rows.where("not base_failed").select(*GROUP, *X))).where("kept").select("row.*")
