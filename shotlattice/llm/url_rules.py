"""Association-rule filtering of URLs: curated host and path rules first, then rules mined from labelled URLs.

FP-growth finds token combinations of URLs that go with the label "block". Rules that too few URLs support or whose confidence may be chance are pruned, and so are rules that hold a more general rule.
What is left is matched through an inverted index: each rule stands under its rarest token only, a URL meets the rules of its tokens by an equi join, and a rule fits if none of
its tokens is missing.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import dropped, parts_of, written

#: (verdict, host and path); the longest that fits wins. Fixed values.
CURATED = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path up to ``?``, ``#`` or the end; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def curated(host: Column, path: Column, rules=CURATED) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels by name, host, path segments, words in them, query names."""
    host, path = host_and_path(url)
    scheme = F.when(F.instr(url, "://") > 0, F.lower(F.substring_index(url, "://", 1))).otherwise("")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    named = lambda name, parts: F.transform(F.array_remove(parts, ""), lambda x: F.concat(F.lit(name), x))
    return F.array_distinct(
        F.concat(
            named("scheme=", F.array(F.coalesce(scheme, F.lit("")))),
            named("label=host.", F.split(host, r"\.")),
            named("word=", F.split(host, r"[.\-]+")),
            named("path=", F.split(F.lower(path), "/")),
            named("word=path.", F.split(F.lower(path), r"[^\p{L}\p{N}]+")),
            named("query=", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
        )
    )


def frequent(rows: DataFrame, least: Column) -> DataFrame:
    """(token, n, k, score): tokens of at least ``least`` URLs, of those found in the very same URLs the first by name.

    A rule with one of such twins has the support and confidence of the rule with another, but each would double the combinations to be mined. Twins are told by their counts and
    two 64-bit sums over the numbers of their URLs. ``n`` and ``k``: the URLs that hold the token, and the blocked ones of them; ``score`` is the chi-square of token and label.
    """
    whole = rows.agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("block").cast("long")).alias("bad"))
    tokens = rows.select("id", F.col("block").cast("long").alias("b"), F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("k"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    often = counts.crossJoin(F.broadcast(whole)).where(F.col("n") >= least)  # one row beside each
    n, k, total, bad = (F.col(c).cast("double") for c in ("n", "k", "all", "bad"))
    apart = k * (total - bad - n + k) - (n - k) * (bad - k)
    score = F.coalesce(F.try_divide(total * apart * apart, n * (total - n) * bad * (total - bad)), F.lit(0.0))
    return often.withColumn("score", score).groupBy("n", "k", "x", "y").agg(F.min("token").alias("token"), F.min("score").alias("score")).select("token", "n", "k", "score")


def lower_bound(confidence: Column, n: Column, z: float = 1.96) -> Column:
    """Wilson's lower bound of a share seen in ``n`` cases."""
    return (confidence + z * z / (2 * n) - z * F.sqrt((confidence * (1 - confidence) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def mine(labelled: DataFrame, min_support: float = 0.0005, least: int = 20, min_confidence: float = 0.6, width: int | None = None) -> DataFrame:
    """(rule, confidence, support), a written table: token combinations of labelled URLs (columns url, block) that mean "block".

    A rule is kept if the share ``min_support`` of all URLs, and ``least`` of them whatever their number, are blocked and hold it, and if the lower bound of its confidence (95 %) is ``min_confidence`` or more.
    Left out before mining is only what no longer rule needs: tokens that are rules alone, those of too few blocked URLs, and those of all URLs. Every other token of a URL is mined; combinations are made one after another
    and not kept, so many such tokens in one URL cost time and not memory. A ``width`` bounds them, if one is given, to the tokens that say most about the label (chi-square, then by name). Matching uses all tokens.
    Null URLs and null labels teach nothing; a URL given repeatedly counts each time. An empty table gives no rules. FP-growth ranks the frequent tokens on the driver: at most tokens a URL / min_support of them.
    """
    rows = labelled.where("url is not null and block is not null").select(F.monotonically_increasing_id().alias("id"), "block", url_tokens(F.col("url")).alias("tokens"))
    rows = written(rows, "labelled")
    total = rows.count()
    floor = max(least, min_support * total)
    known = written(frequent(rows, F.lit(floor)), "tokens")
    sure = (F.col("k") >= floor) & (lower_bound(F.col("k") / F.col("n"), F.col("n")) >= min_confidence)
    alone = known.where(sure).select(F.array("token").alias("rule"), (F.col("k") / F.col("n")).alias("confidence"), (F.col("k") / F.lit(float(max(total, 1)))).alias("support"))
    own = rows.select("id", F.explode("tokens").alias("token")).join(known.where(~sure & (F.col("k") >= floor) & (F.col("n") < total)).select("token", "score"), "token")
    own = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "token"))).alias("best"))
    if width is not None:
        own = own.withColumn("best", F.slice("best", 1, width))
    items = rows.select("id", "block").join(own, "id", "left")
    items = items.select(F.concat(F.coalesce(F.transform("best", lambda x: x["token"]), F.array().cast("array<string>")), F.when(F.col("block"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, floor / max(total, 1)), minConfidence=min_confidence, numPartitions=parts_of(labelled.sparkSession)).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK) & (F.size("antecedent") > 1)).select(F.array_sort("antecedent").alias("rule"), "confidence", "support")
    held_by = F.round(F.col("support") * total / F.col("confidence"))  # URLs that hold the antecedent
    rules = rules.where((F.round(F.col("support") * total) >= floor) & (lower_bound(F.col("confidence"), held_by) >= min_confidence))
    out = written(alone.unionByName(rules), "rules")
    dropped(rows, known)
    return out


def blocked_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct values of ``urls`` (column url) that hold all tokens of a rule."""
    distinct = urls.where("url is not null").select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    exploded = distinct.select("url", "tokens", F.explode("tokens").alias("token"))
    ruled = rules.select("rule").distinct().select("rule", F.explode("rule").alias("token"))
    needed = exploded.join(ruled.select("token").distinct(), "token", "left_semi")
    often = needed.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    index = ruled.join(often, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))["token"].alias("token"))
    return exploded.join(index, "token").where(F.size(F.array_except("rule", "tokens")) == 0).select("url").distinct()


def judge(pages: DataFrame, labelled: DataFrame, rules=CURATED, **mining) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined (whether a mined rule fits).

    The curated rule decides; without one a page is blocked if a mined rule fits, else allowed. A null URL, or one without ``://``, has an empty host and path; a null URL is
    allowed. URLs of any length are read whole. Repeated rows are judged each for itself. Of curated rules of one length the one given last wins. An empty table gives an empty result. Columns other than
    page_id and url are not read. ``mining``: the parameters of ``mine``.
    """
    rows = pages.select("page_id", "url")
    mined = mine(labelled, **mining)
    blocked = blocked_urls(rows, mined).withColumn("mined", F.lit(True))
    host, path = host_and_path(F.col("url"))
    judged = rows.join(blocked, "url", "left").select("page_id", host.alias("host"), path.alias("path"), F.coalesce("mined", F.lit(False)).alias("mined"))
    rule, verdict = curated(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")
