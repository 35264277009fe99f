"""The registered queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import bands as B, geometry as G, strings as S, vectors as V
from ..operators import blocks, distance as D, entity as E, joins as J, medoids, meetings, ranked, records, routing as R, scoring as C, sequences as Q, stats as A
from ..functions.chance import uniform_sql
from .adapters import EVENTS_SQL, events, rounded, rounded_sql, table

FLAGSHIP = "nearest_items"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, doubles: str = ""):
    """Register a query under its function's name; ``doubles`` are the SQL's columns to round like the query's."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = rounded_sql(sql, doubles) if doubles else sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


WITH = f"WITH {EVENTS_SQL}"

# ---------------------------------------------------------------- aggregates

STATS_SQL = "count(value)::BIGINT AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS min, max(value) AS max, var_samp(value) AS variance, CASE WHEN count(value) >= 2 THEN mad(value) END AS mad"


@query(f"{WITH} SELECT video, segment, {STATS_SQL} FROM e GROUP BY ALL", "mean median min max variance mad")
def robust_stats(spark, d):
    return A.stats(events(spark, d), ["video", "segment"], "value")


@query(f"{WITH} SELECT label, 1.4826 * mad(value) AS spread FROM e GROUP BY ALL", "spread")
def mad_spread(spark, d):
    return A.spread(events(spark, d), ["label"], "value")


DIST_SQL = f"""{WITH}, ct AS (SELECT video, segment, label, count(*) AS c FROM e GROUP BY ALL), p AS (SELECT video, segment, label, c / sum(c) OVER (PARTITION BY video, segment) AS p FROM ct),
n AS (SELECT video, count(DISTINCT segment) AS rows FROM p GROUP BY 1),
m AS (SELECT video, label, sum(p) / any_value(rows) AS share FROM p JOIN n USING (video) GROUP BY 1, 2),
modal AS (SELECT video, label AS modal FROM m QUALIFY row_number() OVER (PARTITION BY video ORDER BY round(share, 12) DESC, label) = 1),
best AS (SELECT video, segment, label AS best FROM p QUALIFY row_number() OVER (PARTITION BY video, segment ORDER BY p DESC, label) = 1),
a AS (SELECT video, avg((best = modal)::INT) AS agreement FROM best JOIN modal USING (video) GROUP BY 1)
SELECT video, label, share, modal, agreement FROM m JOIN modal USING (video) JOIN a USING (video)"""


def label_shares(spark, d):
    e = events(spark, d)
    n = e.groupBy("video", "segment", "label").agg(F.count(F.lit(1)).alias("c"))
    return n.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("video", "segment")))


@query(DIST_SQL, "share agreement")
def modal_distribution(spark, d):
    return A.distribution(label_shares(spark, d), ["video"], "segment", "label", "p")


@query(f"{WITH}, c AS (SELECT video, label, count(*)::BIGINT AS n, avg(value) AS score FROM e GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, score DESC, label)::INT AS rank FROM c QUALIFY rank <= 3", "score")
def labelled_topk(spark, d):
    return A.labelled(events(spark, d), ["video"], "label", "value", 3)


@query(f"{WITH}, f AS (SELECT video, segment, label, frame // 3600 AS hr, count(*) AS c FROM e GROUP BY ALL) SELECT video, segment, label, min(hr)::BIGINT AS first_frame, max(hr)::BIGINT AS last_frame, count(*)::BIGINT AS frame_count, max(c)::BIGINT AS max_per_frame FROM f GROUP BY ALL")
def temporal_union(spark, d):
    return A.temporal_union(events(spark, d).withColumn("at", F.floor(F.col("frame") / 3600)), ["video", "segment", "label"], "at")


@query(
    """WITH m AS (SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, sum(l_discount * l_quantity) / sum(l_quantity) AS mean FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, any_value(n) AS n, any_value(mean) AS mean, CASE WHEN any_value(n) > 1 THEN sqrt(sum(l_quantity * (l_discount - mean) ** 2) / sum(l_quantity)) END AS sd FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY 1, 2""",
    "mean sd",
)
def weighted_mean_sd(spark, d):
    return A.weighted(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount", "l_quantity")


@query(f"{WITH}, s AS (SELECT video, label, sum(value) AS w FROM e GROUP BY ALL) SELECT video, label, w / sum(w) OVER (PARTITION BY video) AS share FROM s", "share")
def shares_by_time(spark, d):
    return A.mix(events(spark, d), ["video"], "label", "value")


@query(f"{WITH}, c AS (SELECT video, segment, count(*) AS c FROM e GROUP BY ALL) SELECT CASE WHEN c <= 0 THEN 'none' WHEN c = 1 THEN 'single' WHEN c <= 2 THEN 'couple' WHEN c <= 5 THEN 'group' ELSE 'crowd' END AS band, count(*)::BIGINT AS n FROM c GROUP BY 1")
def crowd_bands(spark, d):
    c = events(spark, d).groupBy("video", "segment").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(B.crowd(F.col("c")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH c AS (SELECT l_returnflag AS video, l_orderkey AS image, floor(l_discount * 50)::INT AS cell, l_quantity / 100 AS share, l_tax AS r, l_discount AS g FROM lineitem),
i AS (SELECT video, count(DISTINCT image) AS images FROM c GROUP BY 1),
m AS (SELECT video, cell, sum(share) / any_value(images) AS share, sum(r * share) / sum(share) AS r, sum(g * share) / sum(share) AS g FROM c JOIN i USING (video) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY video ORDER BY share DESC, r, g, cell)::INT AS rank FROM m QUALIFY rank <= 6""",
    "share r g",
)
def palette_merge(spark, d):
    li = table(spark, d, "lineitem")
    c = li.select(F.col("l_returnflag").alias("video"), F.col("l_orderkey").alias("image"), F.floor(F.col("l_discount") * 50).cast("int").alias("cell"), (F.col("l_quantity") / 100).alias("share"), F.col("l_tax").alias("r"), F.col("l_discount").alias("g"))
    return A.palette_merge(c, ["video"], "image", "cell", "share", ["r", "g"], 6)


@query(
    """WITH h AS (SELECT l_returnflag AS video, l_linestatus AS part, least(floor(l_extendedprice / 5000), 15)::INT AS bin, count(*) AS c, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
s AS (SELECT video, part, bin, c / sum(c) OVER (PARTITION BY video, part) AS share, sum(q) OVER (PARTITION BY video, part) AS w FROM h),
t AS (SELECT video, sum(w) AS w FROM s GROUP BY 1) SELECT s.video, bin, sum(share * s.w) / any_value(t.w) AS share FROM s JOIN t USING (video) GROUP BY 1, 2""",
    "share",
)
def histogram_merge(spark, d):
    li = table(spark, d, "lineitem")
    part = Window.partitionBy("video", "part")
    h = li.groupBy(F.col("l_returnflag").alias("video"), F.col("l_linestatus").alias("part"), F.least(F.floor(F.col("l_extendedprice") / 5000), F.lit(15)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.sum("l_quantity").alias("q"))
    h = h.select("video", "part", "bin", (F.col("c") / F.sum("c").over(part)).alias("share"), F.sum("q").over(part).alias("w"))
    return A.histogram_merge(h, ["video"], "bin", "share", "w")


@query(f"{WITH} SELECT video, label, count(*)::BIGINT AS n, avg(value) AS x, avg(k) AS y, avg(value * k) AS size, sqrt(var_samp(value) + var_samp(k)) AS spread FROM e GROUP BY ALL", "x y size spread")
def things_spread(spark, d):
    return A.things(events(spark, d).withColumn("size", F.col("value") * F.col("k")), ["video", "label"], "value", "k", "size")


@query("SELECT l_returnflag, sum(l_discount * l_quantity) AS top, sum(l_quantity) AS bottom, sum(l_discount * l_quantity) / sum(l_quantity) AS ratio FROM lineitem GROUP BY 1", "top bottom ratio")
def pooled_ratio(spark, d):
    return A.ratio(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")


@query(f"{WITH} SELECT label, count(*)::BIGINT AS n, avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95 FROM e GROUP BY 1", "mean sd p5 p25 p50 p75 p95")
def numeric_report(spark, d):
    return A.numeric_report(events(spark, d), ["label"], "value")


@query(f"{WITH}, g AS (SELECT DISTINCT segment FROM e), l AS (SELECT DISTINCT label FROM e UNION SELECT 'none seen'), t AS (SELECT segment, count(*) AS total FROM e GROUP BY 1), c AS (SELECT segment, label, count(*) AS n FROM e GROUP BY ALL) SELECT segment, label, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / total AS share FROM g CROSS JOIN l LEFT JOIN c USING (segment, label) JOIN t USING (segment)", "share")
def categorical_report(spark, d):
    e = events(spark, d)
    return A.categorical_report(e, e.select("label").distinct().unionByName(spark.createDataFrame([("none seen",)], "label string")), ["segment"], "label")


@query(f"{WITH} SELECT label, count(*)::BIGINT AS n, avg((abs(k - 50) <= 15 AND value < 50)::INT) AS share FROM e WHERE k IS NOT NULL GROUP BY 1", "share")
def address_share(spark, d):
    return A.conditional_share(events(spark, d), ["label"], (F.abs(F.col("k") - 50) <= 15) & (F.col("value") < 50), F.col("k").isNotNull())


@query(f"{WITH}, f AS (SELECT video, segment, frame // 3600 AS hr, coalesce(max(CASE WHEN label = 'view' THEN value END), 0) AS value FROM e GROUP BY ALL) SELECT video, segment, {STATS_SQL} FROM f GROUP BY ALL", "mean median min max variance mad")
def framing_stats(spark, d):
    f = events(spark, d).groupBy("video", "segment", F.floor(F.col("frame") / 3600).alias("at")).agg(F.coalesce(F.max(F.when(F.col("label") == "view", F.col("value"))), F.lit(0.0)).alias("value"))
    return A.stats(f, ["video", "segment"], "value")


@query(f"{WITH}, w AS (SELECT video, label, sum(value) AS w FROM e GROUP BY ALL) SELECT video, label, w / sum(w) OVER (PARTITION BY video) AS share, row_number() OVER (PARTITION BY video ORDER BY w DESC, label)::INT AS rank FROM w QUALIFY rank <= 2", "share")
def whole_item_ranking(spark, d):
    return A.top_by(A.mix(events(spark, d), ["video"], "label", "value"), ["video"], [F.col("share").desc(), F.col("label")], 2)


@query(
    f"""{WITH}, c0 AS (SELECT video, label, count(*) AS n FROM e GROUP BY ALL), c AS (SELECT video, label, row_number() OVER (PARTITION BY video ORDER BY n DESC, label) AS r FROM c0), p AS (SELECT video, max(label) FILTER (r = 1) AS one, max(label) FILTER (r = 2) AS two, max(label) FILTER (r = 3) AS three FROM c GROUP BY 1),
x AS (SELECT *, coalesce(one || two IN ('viewclick', 'clickview', 'errorpurchase', 'purchaseerror'), false) AS clash FROM p)
SELECT video, concat_ws(',', one, CASE WHEN clash THEN three ELSE two END) AS kept, CASE WHEN clash THEN two ELSE '' END AS dropped FROM x"""
)
def exclusive_topk(spark, d):
    e = events(spark, d).groupBy("video", "label").agg((-F.count(F.lit(1))).alias("rank"))
    found = A.exclusive_top(e, ["video"], "label", ["rank"], [("view", "click"), ("error", "purchase")], 2)
    return found.select("video", F.array_join("kept", ",").alias("kept"), F.array_join("dropped", ",").alias("dropped"))


@query()
def box_suppression(spark, d):
    e = events(spark, d)
    b = F.struct(F.col("value").alias("score"), F.col("k").alias("x1"), (F.col("segment") * 3).alias("y1"), (F.col("k") + 30).alias("x2"), (F.col("segment") * 3 + 30).alias("y2"))
    return e.groupBy("video").agg(F.collect_list(b).alias("boxes")).select("video", F.size(A.suppressed(F.col("boxes"), 0.4)).alias("kept"), F.size("boxes").alias("boxes"))


# ---------------------------------------------------------------- routing

FLAG_SQL = f"""{WITH}, p AS (SELECT video, segment, frame // 21600 AS part, count(*) FILTER (label = 'view') AS person, count(*) FILTER (label = 'click') AS face, count(*) FILTER (label = 'error') AS text, count(*) FILTER (label = 'purchase') AS object FROM e GROUP BY ALL),
f AS (SELECT video, segment, count(*)::BIGINT AS parts, {', '.join(f'bool_or({n} > 0) AS {n}, max({n})::BIGINT AS {n}_max, avg(({n} > 0)::INT) AS {n}_agreement' for n in ('person', 'face', 'text', 'object'))} FROM p GROUP BY ALL)"""
NAMED = ("person", "face", "text", "object")


def flag_table(spark, d):
    e = events(spark, d).withColumn("part", F.floor(F.col("frame") / 21600))
    return R.flags(e, ["video", "segment"], {n: F.col("label") == x for n, x in zip(NAMED, ("view", "click", "error", "purchase"))}, "part")


@query(f"{FLAG_SQL} SELECT * FROM f", " ".join(f"{n}_agreement" for n in NAMED))
def flag_summary(spark, d):
    return flag_table(spark, d)


RULES_SQL = ", ".join(f"({o}, '{e}', '{k}', '{n}')" for o, e, k, n in R.RULES)
DECIDED_SQL = f"{FLAG_SQL}, r(ord, expert, kind, need) AS (VALUES {RULES_SQL}), x AS (SELECT video, segment, ord, expert, kind, need = '' OR " + " OR ".join(f"(need = '{n}' AND {n} AND {n}_agreement >= 0.5)" for n in NAMED) + " AS fired FROM f CROSS JOIN r)"


def decided(spark, d):
    return R.decisions(R.facts(flag_table(spark, d), list(NAMED), 0.5), ["video", "segment"], list(NAMED))


@query(f"{DECIDED_SQL} SELECT * FROM x")
def routing_decisions(spark, d):
    return decided(spark, d)


@query(f"{DECIDED_SQL} SELECT video, expert, sum(fired::INT)::BIGINT AS n, avg(fired::INT) AS share FROM x GROUP BY ALL", "share")
def fired_share(spark, d):
    return R.fired(decided(spark, d), ["video"])


# ---------------------------------------------------------------- sequences

SPANS_SQL = f"{WITH}, s AS (SELECT video, segment, min(frame) AS start, max(frame) AS \"end\" FROM e GROUP BY ALL)"


def day_spans(spark, d):
    return events(spark, d).groupBy("video", "segment").agg(F.min("frame").alias("start"), F.max("frame").alias("end"))


@query(f"{SPANS_SQL} SELECT DISTINCT video, segment, unnest(list_append(generate_series(start, \"end\", 7200), \"end\")) AS frame FROM s")
def detection_schedule(spark, d):
    return Q.schedule(day_spans(spark, d), ["video", "segment"], "start", "end", 7200)


RANGES_SQL = f"""{WITH}, r AS (SELECT video, frame AS start, frame + k * 3600 AS "end", 2000000::BIGINT AS count FROM e),
c AS (SELECT *, lead(start) OVER (PARTITION BY video ORDER BY start, "end") AS nxt FROM r)
SELECT video, greatest(start, 0) AS start, least("end", coalesce(nxt - 1, "end"), count - 1) AS "end" FROM c WHERE greatest(start, 0) <= least("end", coalesce(nxt - 1, "end"), count - 1)"""


def ranges(spark, d):
    return events(spark, d).select("video", F.col("frame").alias("start"), (F.col("frame") + F.col("k") * 3600).alias("end"), F.lit(2000000).cast("long").alias("count"))


@query(RANGES_SQL)
def range_normalise(spark, d):
    return Q.normalise_ranges(ranges(spark, d), ["video"], "start", "end", "count")


@query(
    f"""{WITH}, r AS (SELECT video, event_id, frame AS start, frame + k * 600 AS "end" FROM e), m AS (SELECT *, max("end") OVER (PARTITION BY video ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
i AS (SELECT video, sum((before IS NOT NULL AND start > before)::INT) OVER (PARTITION BY video ORDER BY start, "end", event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island, start, "end" FROM m)
SELECT video, island, count(*)::BIGINT AS n, min(start) AS start, max("end") AS "end" FROM i GROUP BY 1, 2"""
)
def gaps_islands(spark, d):
    r = events(spark, d).select("video", "event_id", F.col("frame").alias("start"), (F.col("frame") + F.col("k") * 600).alias("end"))
    return Q.islands(r, ["video"], "start", "end").groupBy("video", "island").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


HOURS_SQL = f"{WITH}, h AS (SELECT video, frame // 3600 AS frame, avg(value) AS value, avg(k) AS k FROM e GROUP BY ALL)"


def hours(spark, d):
    return events(spark, d).groupBy("video", F.floor(F.col("frame") / 3600).alias("frame")).agg(F.avg("value").alias("value"), F.avg("k").alias("k"))


@query(
    f"""{HOURS_SQL}, n AS (SELECT *, lead(frame) OVER w AS f2, lead(value) OVER w AS v2, lead(k) OVER w AS k2 FROM h WINDOW w AS (PARTITION BY video ORDER BY frame)),
x AS (SELECT *, unnest(generate_series(frame, CASE WHEN f2 - frame BETWEEN 2 AND 6 THEN f2 - 1 ELSE frame END)) AS hr FROM n)
SELECT video, hr AS frame, CASE WHEN hr = frame THEN value ELSE value + (v2 - value) * ((hr - frame) / (f2 - frame)) END AS value, CASE WHEN hr = frame THEN k ELSE k + (k2 - k) * ((hr - frame) / (f2 - frame)) END AS k, hr <> frame AS interpolated FROM x""",
    "value k",
)
def interpolate_gaps(spark, d):
    return Q.interpolate(hours(spark, d), ["video"], "frame", ["value", "k"], 6)


@query(f"{WITH} SELECT * FROM e QUALIFY (row_number() OVER (PARTITION BY video ORDER BY frame, event_id) - 1) % 5 = 0", "value")
def series_stride(spark, d):
    return Q.stride(events(spark, d), ["video"], ["frame", "event_id"], 5)


@query(
    f"""{WITH}, p AS (SELECT video, event_id, value, count(*) OVER (PARTITION BY video) AS n, row_number() OVER (PARTITION BY video ORDER BY frame, event_id) - 1 AS i FROM e),
s AS (SELECT *, ((least(4, n) * (i + 1) - 1) // n)::INT AS span FROM p) SELECT video, event_id, value, span FROM s QUALIFY row_number() OVER (PARTITION BY video, span ORDER BY value DESC, i) = 1""",
    "value",
)
def equal_span_best(spark, d):
    return Q.span_best(events(spark, d).select("video", "event_id", "frame", "value"), ["video"], ["frame", "event_id"], "value", 4).drop("frame")


@query(f"{WITH}, m AS (SELECT *, max(value) OVER (PARTITION BY video, label) AS mv, max(k) OVER (PARTITION BY video, label) AS mk FROM e) SELECT event_id, (CASE WHEN mv > 0 THEN value / mv ELSE 1 END) * (CASE WHEN mk > 0 THEN k / mk ELSE 1 END) AS score FROM m", "score")
def relative_scores(spark, d):
    return events(spark, d).select("event_id", Q.relative_score(None, ["video", "label"], ["value", "k"]).alias("score"))


@query(
    f"""{WITH}, k AS (SELECT video, segment, event_id, frame FROM e WHERE label = 'view'), c AS (SELECT *, (lag(frame) OVER w + frame) / 2 AS low, (lead(frame) OVER w + frame) / 2 AS high FROM k WINDOW w AS (PARTITION BY video, segment ORDER BY frame))
SELECT c.event_id, count(*)::BIGINT AS n, avg(e.value) AS value FROM e JOIN c ON e.video = c.video AND e.segment = c.segment AND (low IS NULL OR e.frame >= low) AND (high IS NULL OR e.frame < high) GROUP BY 1""",
    "value",
)
def keyframe_cells(spark, d):
    e = events(spark, d)
    cell = Q.cells(e.where("label = 'view'").select("video", "segment", "event_id", "frame"), ["video", "segment"], "frame")
    return Q.in_cells(e, cell, ["video", "segment"], "frame").groupBy(F.col("cell_event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))


@query(
    f"""{WITH}, p AS (SELECT video, label || ' > ' || lead(label) OVER w AS change, value + lead(value) OVER w AS w FROM e WINDOW w AS (PARTITION BY video ORDER BY frame, event_id)),
s AS (SELECT video, change, sum(w) AS w FROM p WHERE change IS NOT NULL GROUP BY 1, 2) SELECT video, change, w / sum(w) OVER (PARTITION BY video) AS share FROM s""",
    "share",
)
def transition_mix(spark, d):
    return Q.transitions(events(spark, d), ["video"], ["frame", "event_id"], "label", "value")


FLAT_SQL = f"{WITH}, s AS (SELECT video, frame, event_id, value, value - lag(value) OVER (PARTITION BY video ORDER BY frame, event_id) AS step FROM e), f AS (SELECT coalesce(quantile_cont(abs(step), 0.5) / 2, 0) AS flat FROM s WHERE step <> 0)"


@query(f"{FLAT_SQL} SELECT flat FROM f", "flat")
def flat_step(spark, d):
    return Q.flat_step(events(spark, d), ["video"], ["frame", "event_id"], "value")


@query(f"{FLAT_SQL}, t AS (SELECT video, CASE WHEN step > flat THEN 'rising' WHEN step < -flat THEN 'falling' WHEN step IS NOT NULL THEN 'flat' END AS trend FROM s CROSS JOIN f) SELECT video, trend, count(*)::BIGINT AS n FROM t WHERE trend IS NOT NULL GROUP BY ALL")
def value_trends(spark, d):
    e = events(spark, d)
    both = e.crossJoin(F.broadcast(Q.flat_step(e, ["video"], ["frame", "event_id"], "value")))  # one row
    t = both.select("video", Q.trend("value", F.col("flat"), ["video"], ["frame", "event_id"]).alias("trend"))
    return t.where("trend is not null").groupBy("video", "trend").agg(F.count(F.lit(1)).alias("n"))


@query(f"{SPANS_SQL} SELECT video, segment, (start - min(start) OVER w) / nullif(max(\"end\") OVER w - min(start) OVER w, 0) AS place, ln(\"end\" - start + 1) AS pace FROM s WINDOW w AS (PARTITION BY video)", "place pace")
def pace_arc(spark, d):
    w = Window.partitionBy("video")
    s = day_spans(spark, d)
    at = F.try_divide(F.col("start") - F.min("start").over(w), F.max("end").over(w) - F.min("start").over(w))
    return s.select("video", "segment", at.alias("place"), F.log(F.col("end") - F.col("start") + 1).alias("pace"))


@query(f"{SPANS_SQL} SELECT video, segment, least(greatest(round_even((\"end\" - start) / 7200, 0), 1), 8)::INT AS spans FROM s")
def span_counts(spark, d):
    return day_spans(spark, d).select("video", "segment", F.least(F.greatest(F.bround((F.col("end") - F.col("start")) / 7200, 0), F.lit(1)), F.lit(8)).cast("int").alias("spans"))


@query(
    f"""{SPANS_SQL}, v AS (SELECT video, max("end") AS stop FROM s GROUP BY 1), i AS (SELECT video, i::INT AS i, stop * (i + 0.5) / 6 AS instant FROM v CROSS JOIN range(6) t(i))
SELECT i.video, i, instant, segment FROM i JOIN s ON i.video = s.video QUALIFY row_number() OVER (PARTITION BY i.video, i ORDER BY ("end" <= instant)::INT, CASE WHEN "end" > instant THEN "end" ELSE -"end" END, start) = 1""",
    "instant",
)
def instant_picks(spark, d):
    return Q.instants(day_spans(spark, d), ["video"], "start", "end", 6).select("video", "i", "instant", "segment")


@query(f"{WITH} SELECT video, segment, event_id FROM e QUALIFY row_number() OVER (PARTITION BY video, segment, label ORDER BY value DESC, event_id) > 1")
def duplicate_yields(spark, d):
    return Q.yields(events(spark, d), ["video", "segment", "label"], [F.col("value").desc(), F.col("event_id")]).select("video", "segment", "event_id")


# ---------------------------------------------------------------- joins


@query(f"{WITH}, v AS (SELECT video, frame, value FROM e WHERE label = 'view') SELECT p.event_id, CASE WHEN p.frame - v.frame <= 21600 THEN v.value END AS held FROM (SELECT * FROM e WHERE label = 'purchase') p ASOF LEFT JOIN v ON p.video = v.video AND p.frame >= v.frame", "held")
def asof_hold(spark, d):
    e = events(spark, d).withColumn("seen", F.when(F.col("label") == "view", F.col("value")))
    return e.select("event_id", "label", Q.held(e, ["video"], "frame", "seen", 21600).alias("held")).where("label = 'purchase'").drop("label")


#: Pair queries see all events, with the hour as place: a day holds too many users.
PLACES_SQL = f"{WITH}, h AS (SELECT *, frame // 3600 AS hour FROM e)"
PAIRS_SQL = f"{PLACES_SQL}, s AS (SELECT video, hour AS segment, avg(value) AS value, avg(k) AS k FROM h GROUP BY ALL), p AS (SELECT a.video AS a, b.video AS b, a.segment, a.value AS av, b.value AS bv, a.k AS ak, b.k AS bk FROM s a JOIN s b ON a.segment = b.segment AND a.video < b.video)"


def by_hour(spark, d):
    return events(spark, d).withColumn("segment", F.floor(F.col("frame") / 3600))


def hourly(spark, d):
    """One row a user and hour: video, segment, value, k."""
    return by_hour(spark, d).groupBy("video", "segment").agg(F.avg("value").alias("value"), F.avg("k").alias("k"))


@query(f"{PLACES_SQL}, p AS (SELECT DISTINCT video, hour FROM h) SELECT a.video AS a, b.video AS b, count(*)::BIGINT AS n FROM p a JOIN p b ON a.hour = b.hour AND a.video < b.video GROUP BY 1, 2")
def co_presence(spark, d):
    return meetings.counts(by_hour(spark, d), "video", "segment")


@query(f"{PAIRS_SQL} SELECT a, b, count(*)::BIGINT AS n, count(*) >= 5 AS available, CASE WHEN count(*) >= 5 AND stddev_pop(av) >= 1e-9 AND stddev_pop(bv) >= 1e-9 THEN covar_pop(av, bv) / (stddev_pop(av) * stddev_pop(bv)) END AS r FROM p GROUP BY 1, 2", "r")
def synchrony(spark, d):
    return meetings.synchrony(hourly(spark, d), "video", "segment", "value", 5)


@query(f"{PAIRS_SQL}, g AS (SELECT a, b, avg(av - bv) AS dx, avg(ak - bk) AS dy, coalesce(avg(CASE WHEN bv > 0 THEN av / bv END), 1) AS ratio FROM p GROUP BY 1, 2) SELECT *, CASE WHEN dx < 0 THEN 'left' ELSE 'right' END AS side, CASE WHEN dy < 0 THEN 'above' ELSE 'below' END AS height, CASE WHEN ratio > 1.15 THEN 'a' WHEN ratio < 0.87 THEN 'b' END AS nearer FROM g", "dx dy ratio")
def placement(spark, d):
    return meetings.placement(hourly(spark, d), "video", "segment", "value", "k", "value")


LOOKS_SQL = f"{PAIRS_SQL}, l AS (SELECT a, b, segment, abs(ak - bk) < 20 AS hit FROM p), g AS (SELECT a, b, segment, count(*) AS n, sum(hit::INT) AS hits FROM l GROUP BY ALL), t AS (SELECT a, b, sum(n)::BIGINT AS n, sum(hits)::BIGINT AS hits, sum(hits) / sum(n) AS share FROM g GROUP BY ALL), k AS (SELECT a, b, hits / n AS peak_share, n::BIGINT AS peak_n, segment AS peak_segment FROM g WHERE n >= 1 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY hits / n DESC, n DESC, segment) = 1)"


@query(f"{LOOKS_SQL} SELECT * FROM t LEFT JOIN k USING (a, b)", "share peak_share")
def looks_at(spark, d):
    return meetings.looks(hourly(spark, d), "video", "segment", "k", 20)


@query(f"{LOOKS_SQL} SELECT a, b FROM t LEFT JOIN k USING (a, b) WHERE peak_share >= 0.5")
def relation_evidence(spark, d):
    return meetings.looks(hourly(spark, d), "video", "segment", "k", 20, 0.5)


@query(f"{WITH}, s AS (SELECT video, segment, value AS x, k AS y FROM e QUALIFY row_number() OVER (PARTITION BY video, segment ORDER BY frame, event_id) = 1) SELECT a.segment, a.video AS entity, b.video AS target, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM s a JOIN s b ON a.segment = b.segment AND a.video <> b.video WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 10 QUALIFY row_number() OVER (PARTITION BY a.segment, a.video ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.video) = 1", "distance")
def nearest_target(spark, d):
    s = A.top_by(events(spark, d), ["video", "segment"], [F.col("frame"), F.col("event_id")], 1)
    return J.nearest_target(s, ["segment"], "video", "value", "k", 10.0)


BOX_SQL = "struct_pack(x1 := k, y1 := segment * 2, x2 := k + 20 + segment, y2 := segment * 2 + 25)"


@query(
    f"""{WITH}, b AS (SELECT video, segment, event_id, k AS x1, segment * 2 AS y1, k + 20 + segment AS x2, segment * 2 + 25 AS y2 FROM e),
p AS (SELECT a.event_id AS a, b.event_id AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab FROM b a JOIN b ON a.video = b.video AND a.segment = b.segment AND a.event_id < b.event_id)
SELECT a, b, i / (aa + ab - i) AS iou FROM p WHERE i > 0""",
    "iou",
)
def box_iou_pairs(spark, d):
    c = F.col
    e = events(spark, d).select("video", "segment", "event_id", G.box(c("k"), c("segment") * 2, c("k") + 20 + c("segment"), c("segment") * 2 + 25).alias("box"))
    p = e.alias("a").join(e.alias("b"), (c("a.video") == c("b.video")) & (c("a.segment") == c("b.segment")) & (c("a.event_id") < c("b.event_id")) & G.overlaps(c("a.box"), c("b.box")))
    return p.select(c("a.event_id").alias("a"), c("b.event_id").alias("b"), G.iou(c("a.box"), c("b.box")).alias("iou"))


MATCH_SQL = f"""{WITH}, a AS (SELECT video, event_id AS id, frame AS start, frame + 20000 AS "end" FROM e WHERE label = 'view'), b AS (SELECT video, event_id AS id, frame - 5000 AS start, frame + 15000 AS "end" FROM e WHERE label = 'click'),
o AS (SELECT a.video, a.id AS a_id, b.id AS b_id, least(a."end", b."end") - greatest(a.start, b.start) + 1 AS i, a."end" - a.start + 1 AS la, b."end" - b.start + 1 AS lb FROM a JOIN b ON a.video = b.video AND a.start <= b."end" AND b.start <= a."end"),
p AS (SELECT video, a_id, b_id, i / (la + lb - i) AS iou FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY video, a_id ORDER BY iou DESC, b_id) AS ra, row_number() OVER (PARTITION BY video, b_id ORDER BY iou DESC, a_id) AS rb FROM p)
SELECT video, a_id, b_id, iou FROM r WHERE ra = 1 AND rb = 1 AND iou >= 0.5"""


@query(MATCH_SQL, "iou")
def mutual_best_intervals(spark, d):
    e = events(spark, d)
    a = e.where("label = 'view'").select("video", F.col("event_id").alias("id"), F.col("frame").alias("start"), (F.col("frame") + 20000).alias("end"))
    b = e.where("label = 'click'").select("video", F.col("event_id").alias("id"), (F.col("frame") - 5000).alias("start"), (F.col("frame") + 15000).alias("end"))
    return J.mutual_best(a, b, ["video"], 0.5, 20000)


@query(f"{WITH}, s AS (SELECT video, event_id AS id, frame AS start, frame + 7200 AS \"end\" FROM e WHERE label = 'view') SELECT e.event_id, min(s.id) AS id FROM e LEFT JOIN s ON e.video = s.video AND e.frame BETWEEN s.start AND s.\"end\" WHERE e.label = 'purchase' GROUP BY 1")
def point_in_interval(spark, d):
    e = events(spark, d)
    s = e.where("label = 'view'").select("video", F.col("event_id").alias("id"), F.col("frame").alias("start"), (F.col("frame") + 7200).alias("end"))
    return J.first_span(e.where("label = 'purchase'").select("event_id", "video", "frame"), s, ["video"], "frame", 7200).select("event_id", "id")


@query()
def greedy_cut_match(spark, d):
    e = events(spark, d)
    return J.greedy_matches(e.where("label = 'view'"), e.where("label = 'click'"), "video", "frame", 3600.0)


@query()
def box_tracks(spark, d):
    e = events(spark, d)
    b = e.select("video", F.col("event_id").alias("id"), F.floor(F.col("frame") / 3600).alias("frame"), F.col("k").alias("x1"), F.lit(0).alias("y1"), (F.col("k") + 40).alias("x2"), F.lit(30).alias("y2"))
    return J.link_tracks(b, "video")


# ---------------------------------------------------------------- distances

USER_MIX_SQL = f"{WITH}, u AS (SELECT video AS item, label, sum(value) AS w FROM e GROUP BY ALL), m AS (SELECT item, label, w, w / sum(w) OVER (PARTITION BY item) AS share FROM u), i AS (SELECT DISTINCT item FROM m), pr AS (SELECT x.item AS a, y.item AS b FROM i x JOIN i y ON x.item < y.item)"


def item_mix(spark, d):
    """Label mixes of users, the items of the collection."""
    u = events(spark, d).groupBy(F.col("video").alias("item"), "label").agg(F.sum("value").alias("w"))
    return u.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("item")))


HELL_SQL = f"{USER_MIX_SQL}, h AS (SELECT pr.a, pr.b, sqrt(greatest(0, 1 - coalesce(sum(sqrt(x.share * y.share)), 0))) AS raw FROM pr LEFT JOIN (m x JOIN m y ON x.label = y.label) ON x.item = pr.a AND y.item = pr.b GROUP BY 1, 2)"


@query(f"{HELL_SQL} SELECT * FROM h", "raw")
def hellinger_pairs(spark, d):
    return blocks.pairwise(item_mix(spark, d), "share", "mix")


JAC_SQL = f"{USER_MIX_SQL}, t AS (SELECT item, sum(w) AS t FROM m GROUP BY 1), l AS (SELECT x.item AS a, y.item AS b, sum(least(x.w, y.w)) AS low FROM m x JOIN m y ON x.label = y.label AND x.item < y.item GROUP BY 1, 2), j AS (SELECT pr.a, pr.b, 1 - coalesce(low, 0) / nullif(ta.t + tb.t - coalesce(low, 0), 0) AS raw FROM pr LEFT JOIN l USING (a, b) JOIN t ta ON ta.item = pr.a JOIN t tb ON tb.item = pr.b)"


@query(f"{JAC_SQL} SELECT * FROM j", "raw")
def jaccard_pairs(spark, d):
    return blocks.pairwise(item_mix(spark, d), "w", "set")


@query(f"{WITH}, v AS (SELECT video AS item, avg(value) AS x FROM e GROUP BY 1) SELECT a.item AS a, b.item AS b, abs(a.x - b.x) AS raw FROM v a JOIN v b ON a.item < b.item", "raw")
def difference_pairs(spark, d):
    return blocks.differences(events(spark, d).groupBy(F.col("video").alias("item")).agg(F.avg("value").alias("x")), "x")


NATION_SQL = """WITH s AS (SELECT c_nationkey AS item, c_acctbal AS x, 1.0 AS w, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
p AS (SELECT item, x, (r - 0.5) / n AS pos, lead(x) OVER w AS x2, lead((r - 0.5) / n) OVER w AS pos2, r FROM s WINDOW w AS (PARTITION BY item ORDER BY r)),
g AS (SELECT (i + 0.5) / 100 AS t, i FROM range(100) t(i)),
q AS (SELECT item, i, CASE WHEN t <= pos OR pos2 IS NULL THEN x ELSE x + (x2 - x) * (t - pos) / (pos2 - pos) END AS q FROM p JOIN g ON (t >= pos OR r = 1) AND (pos2 IS NULL OR t < pos2))
SELECT a.item AS a, b.item AS b, avg(abs(a.q - b.q)) AS raw FROM q a JOIN q b ON a.i = b.i AND a.item < b.item GROUP BY 1, 2"""


@query(NATION_SQL, "raw")
def wasserstein_pairs(spark, d):
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("item"), F.col("c_acctbal").alias("x"), F.lit(1.0).alias("w"))
    return D.wasserstein(s, "x", "w")


@query(f"{USER_MIX_SQL}, n AS (SELECT count(DISTINCT item) AS n FROM m), f AS (SELECT label, count(DISTINCT item) AS df FROM m GROUP BY 1) SELECT item, label, w * ln((n + 1) / df) AS w FROM m JOIN f USING (label) CROSS JOIN n", "w")
def rare_weighting(spark, d):
    return D.rare(item_mix(spark, d).select("item", "label", "w"))


FIELDS_SQL = f"""{HELL_SQL}, jm AS (SELECT video AS item, avg(value) AS x, avg(CASE WHEN label = 'error' THEN k END) AS y FROM e GROUP BY 1),
raw AS (SELECT 'mix' AS field, 'plastic' AS level, 'label' AS grp, a, b, raw FROM h UNION ALL SELECT 'mean', 'plastic', 'value', a.item, b.item, abs(a.x - b.x) FROM jm a JOIN jm b ON a.item < b.item UNION ALL SELECT 'errors', 'figurative', 'value', a.item, b.item, abs(a.y - b.y) FROM jm a JOIN jm b ON a.item < b.item),
q AS (SELECT field, quantile_cont(raw, 0.9) AS q9 FROM raw GROUP BY 1),
cal AS (SELECT raw.*, CASE WHEN raw IS NULL THEN NULL WHEN q9 > 0 THEN least(raw / q9, 1) ELSE raw END AS calibrated FROM raw JOIN q USING (field)),
lk AS (SELECT 'errors' AS field, item FROM jm WHERE y IS NULL), mn AS (SELECT field, avg(calibrated) AS mean FROM cal GROUP BY 1),
imp AS (SELECT cal.*, CASE WHEN calibrated IS NULL AND (la.item IS NOT NULL) <> (lb.item IS NOT NULL) THEN mean ELSE calibrated END AS imputed FROM cal JOIN mn USING (field) LEFT JOIN lk la ON la.field = cal.field AND la.item = a LEFT JOIN lk lb ON lb.field = cal.field AND lb.item = b),
g AS (SELECT a, b, level, grp, avg(imputed) AS score FROM imp GROUP BY ALL), lv AS (SELECT a, b, level, avg(score) AS score FROM g GROUP BY ALL), al AS (SELECT a, b, avg(score) AS score FROM lv GROUP BY ALL)"""


def field_pairs(spark, d):
    e = events(spark, d)
    v = e.groupBy(F.col("video").alias("item")).agg(F.avg("value").alias("x"), F.avg(F.when(F.col("label") == "error", F.col("k"))).alias("y"))
    tag = lambda df, f, l, g: df.select(F.lit(f).alias("field"), F.lit(l).alias("level"), F.lit(g).alias("grp"), "a", "b", "raw")  # noqa: E731,E741
    raw = tag(D.hellinger(item_mix(spark, d)), "mix", "plastic", "label").unionByName(tag(D.difference(v, "x"), "mean", "plastic", "value")).unionByName(tag(D.difference(v, "y"), "errors", "figurative", "value"))
    return raw, v.where("y is null").select(F.lit("errors").alias("field"), "item")


def collection(spark, d):
    """The three fields as dense vectors, for scores in blocks."""
    e = events(spark, d)
    v = e.groupBy(F.col("video").alias("item")).agg(F.avg("value").alias("mean"), F.avg(F.when(F.col("label") == "error", F.col("k"))).alias("errors"))
    items = v.join(blocks.dense(item_mix(spark, d), "item", "label", "share").withColumnRenamed("v", "mix"), "item", "left")
    return blocks.Collection(items, [("mix", "plastic", "label", "mix"), ("mean", "plastic", "value", "scalar"), ("errors", "figurative", "value", "scalar")])


def imputed(spark, d):
    raw, lacks = field_pairs(spark, d)
    return D.impute(D.calibrate_scale(raw), lacks)


@query(f"{FIELDS_SQL} SELECT field, level, grp, a, b, raw, calibrated FROM cal", "raw calibrated")
def calibrate_scale(spark, d):
    return collection(spark, d).pairs().drop("imputed")


@query(f"{FIELDS_SQL}, rk AS (SELECT field, level, grp, a, b, round(raw, 9) AS raw FROM raw) SELECT field, level, grp, a, b, raw, CASE WHEN raw IS NOT NULL THEN (rank() OVER (PARTITION BY field ORDER BY raw) - 1) / count(raw) OVER (PARTITION BY field) END AS calibrated FROM rk", "raw calibrated")
def calibrate_rank(spark, d):
    return D.calibrate_rank(collection(spark, d).pairs().drop("calibrated", "imputed").withColumn("raw", F.round("raw", 9)))


@query(f"{FIELDS_SQL} SELECT field, level, grp, a, b, raw, calibrated, imputed FROM imp", "raw calibrated imputed")
def impute_mean(spark, d):
    return collection(spark, d).pairs()


@query(f"{FIELDS_SQL} SELECT a, b, level, grp, score FROM g UNION ALL SELECT a, b, level, NULL, score FROM lv UNION ALL SELECT a, b, NULL, NULL, score FROM al", "score")
def score_tree(spark, d):
    return collection(spark, d).tree()


NEAR_SQL = f"{FIELDS_SQL}, w AS (SELECT a, b, round(score, 9) AS score FROM al), x AS (SELECT a AS item, b AS other, score FROM w UNION ALL SELECT b, a, score FROM w) SELECT *, row_number() OVER (PARTITION BY item ORDER BY score, other)::INT AS rank FROM x WHERE score IS NOT NULL QUALIFY rank <= 5"


@query(NEAR_SQL, "score")
def nearest_items(spark, d):
    return collection(spark, d).nearest(5).withColumn("score", F.round("score", 9))


@query(
    f"""{FIELDS_SQL}, cl AS (SELECT item, (item % 3)::INT AS cluster FROM i), j AS (SELECT imp.field, ca.cluster AS ca, cb.cluster AS cb, imputed FROM imp JOIN cl ca ON ca.item = a JOIN cl cb ON cb.item = b WHERE imputed IS NOT NULL),
sd AS (SELECT field, ca AS cluster, true AS own, imputed FROM j WHERE ca = cb UNION ALL SELECT field, ca, false, imputed FROM j WHERE ca <> cb UNION ALL SELECT field, cb, false, imputed FROM j WHERE ca <> cb),
gp AS (SELECT cluster, field, avg(imputed) FILTER (NOT own) - avg(imputed) FILTER (own) AS gap FROM sd GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY gap DESC, field)::INT AS rank FROM gp WHERE gap IS NOT NULL QUALIFY rank <= 2""",
    "gap",
)
def held_by(spark, d):
    x = collection(spark, d)
    members = x.items.select("item", F.pmod("item", F.lit(3)).cast("int").alias("cluster"))
    return x.held_by(members, 2)


@query(f"{FIELDS_SQL} SELECT field, level, grp, a, b, raw, calibrated FROM cal WHERE a = (SELECT min(item) FROM i) AND b = (SELECT max(item) FROM i)", "raw calibrated")
def explain_pair(spark, d):
    x = collection(spark, d)
    ends = x.items.agg(F.min("item").alias("lo"), F.max("item").alias("hi")).first()
    return x.pairs([ends.lo, ends.hi]).drop("imputed")


@query()
def medoid_clusters(spark, d):
    return medoids.k_medoids(collection(spark, d).whole(), "score", 4)


@query()
def cluster_recovery(spark, d):
    return medoids.recovery(collection(spark, d).whole(), "score", 4)


# ---------------------------------------------------------------- vectors and entities

DOT = "list_dot_product({a}, {b})"
UNIT_SQL = "u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)"
MEAN_SQL = f"{UNIT_SQL}, pl AS (SELECT label, i, avg(u[i]) AS x FROM u CROSS JOIN range(1, 65) t(i) GROUP BY 1, 2), mv AS (SELECT label, list(x ORDER BY i) AS v FROM pl GROUP BY 1), mu AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS p FROM mv)"


def label_means(spark, d):
    return E.mean_unit(table(spark, d, "embeddings"), ["label"], "embedding")


@query(f"WITH {MEAN_SQL} SELECT label, i::INT - 1 AS i, p[i] AS x FROM mu CROSS JOIN range(1, 65) t(i)", "x")
def mean_unit_vector(spark, d):
    return label_means(spark, d).select("label", F.posexplode("vector").alias("i", "x"))


ZERO_SQL = f"WITH {MEAN_SQL}, s AS (SELECT vec_id, mu.label, list_dot_product(u, p) AS score FROM u CROSS JOIN mu), f AS (SELECT *, exp(100 * (score - max(score) OVER (PARTITION BY vec_id))) AS e FROM s), r AS (SELECT vec_id, label::INT AS label, score, e / sum(e) OVER (PARTITION BY vec_id) AS share, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label)::INT AS rank FROM f)"


def prompts(spark, d):
    return label_means(spark, d)


@query(f"{ZERO_SQL} SELECT * FROM r WHERE rank <= 3", "score share")
def zero_shot_topk(spark, d):
    return E.zero_shot(table(spark, d, "embeddings"), "vec_id", "embedding", prompts(spark, d), 3)


@query(f"WITH {UNIT_SQL}, p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_dot_product(a.u, b.u) AS cosine FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b)::INT AS rank FROM p QUALIFY rank <= 5", "cosine")
def cosine_topk(spark, d):
    return E.nearest_cosine(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 5)


@query(f"WITH {UNIT_SQL}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.u, b.u) AS c FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id), x AS (SELECT a, b, round(c - 0.406, 4) AS f, round(c * 0.9 + 0.1 - 0.701, 4) AS bd, c FROM p) SELECT a, b, CASE WHEN c < 0.058 THEN NULL WHEN bd >= 0 AND (f < 0 OR bd > f) THEN 'body' WHEN f >= 0 THEN 'face' END AS link FROM x")
def link_threshold(spark, d):
    p = E.cosine_pairs(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding")
    return p.select("a", "b", E.link(F.col("cosine"), F.col("cosine") * 0.9 + 0.1).alias("link"))


@query(f"WITH {UNIT_SQL}, p AS (SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, b.vec_id) AS r FROM u a JOIN u b ON abs(a.vec_id - b.vec_id) > 1) SELECT avg((label = other)::INT) AS same, count(*)::BIGINT AS n FROM p WHERE r = 1", "same")
def scene_consistency(spark, d):
    v = table(spark, d, "embeddings")
    own, other = v.select(F.col("vec_id").alias("a"), "label"), v.select(F.col("vec_id").alias("b"), F.col("label").alias("other"))
    p = E.nearest_cosine(v, [], "vec_id", "embedding", 1, 1).join(own, "a").join(other, "b")
    return p.agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("same"), F.count(F.lit(1)).alias("n"))


@query()
def complete_linkage(spark, d):
    return E.complete_linkage(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.5)


@query()
def neighbour_clusters(spark, d):
    return E.first_neighbours(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query()
def keyframe_select(spark, d):
    v = table(spark, d, "embeddings").withColumn("sharp", F.pmod(F.xxhash64("vec_id"), F.lit(1000)))
    return E.pick_keyframes(v, "label", "vec_id", "embedding", "sharp", 5)


@query()
def text_grouping(spark, d):
    return E.group_texts(table(spark, d, "conversations"), ["conv_id"], "text", "turn").drop("variants")


# ---------------------------------------------------------------- scoring

LABELLED_SQL = "WITH x AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.lang, d.source, (d.n_chars > 1500)::INT AS said FROM labels l JOIN documents d USING (doc_id))"


def labelled_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    return table(spark, d, "labels").join(docs, "doc_id").withColumn("said", (F.col("n_chars") > 1500).cast("int"))


@query(f"{LABELLED_SQL} SELECT quality AS truth, said AS found, count(*)::BIGINT AS n FROM x GROUP BY 1, 2")
def confusion_report(spark, d):
    return C.confusion(labelled_docs(spark, d), "quality", "said")


@query(f"{LABELLED_SQL}, c AS (SELECT quality AS truth, count(*) AS n, count(*) FILTER (quality = said) AS hit FROM x GROUP BY 1) SELECT sum(hit) / sum(n) AS accuracy, avg(hit / n) AS balanced, max(n) / sum(n) AS majority, sum(n)::BIGINT AS n FROM c", "accuracy balanced majority")
def accuracy_report(spark, d):
    return C.accuracy(C.confusion(labelled_docs(spark, d), "quality", "said"))


@query(f"{LABELLED_SQL}, c AS (SELECT lang, count(*) FILTER (quality = 1 AND said = 1)::BIGINT AS tp, count(*) FILTER (quality = 0 AND said = 1)::BIGINT AS fp, count(*) FILTER (quality = 1 AND said = 0)::BIGINT AS fn, count(*) FILTER (quality = 0 AND said = 0)::BIGINT AS tn FROM x GROUP BY 1) SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM c", "precision recall f1 fpr")
def binary_rates(spark, d):
    return C.binary_rates(labelled_docs(spark, d), "quality", "said", ["lang"])


@query(f"{LABELLED_SQL} SELECT lang, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS p, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)::BIGINT AS q, (sum(CASE WHEN quality = 1 THEN r END) - sum(quality) * (sum(quality) + 1) / 2) / nullif(sum(quality) * sum(1 - quality), 0) AS auc FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM x) GROUP BY 1", "auc")
def auc_midrank(spark, d):
    return C.auc(labelled_docs(spark, d).withColumn("good", F.col("quality") == 1), ["lang"], "good", "n_chars")


@query(f"{LABELLED_SQL}, b AS (SELECT lang, n_chars, sum(quality) AS p, count(*) AS n FROM x GROUP BY 1, 2), r AS (SELECT lang, p, sum(p) OVER w / sum(n) OVER w AS precision FROM b WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)) SELECT lang, sum(precision * p) / nullif(sum(p), 0) AS ap FROM r GROUP BY 1", "ap")
def average_precision(spark, d):
    return C.average_precision(labelled_docs(spark, d).withColumn("good", F.col("quality") == 1), ["lang"], "good", "n_chars")


@query(f"{ZERO_SQL}, x AS (SELECT emb.label AS truth, r.label AS found FROM r JOIN embeddings emb USING (vec_id) WHERE rank = 1), c AS (SELECT truth, found, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), a AS (SELECT truth, sum(n) AS m FROM c GROUP BY 1), b AS (SELECT found, sum(n) AS m FROM c GROUP BY 1) SELECT (SELECT sum(top) FROM (SELECT max(n) AS top FROM c GROUP BY found)) / t AS wcp, 2 * (SELECT sum(c.n / t * ln(c.n * t / (a.m * b.m))) FROM c JOIN a USING (truth) JOIN b USING (found)) / ((SELECT -sum(m / t * ln(m / t)) FROM a) + (SELECT -sum(m / t * ln(m / t)) FROM b)) AS nmi, t::BIGINT AS n FROM t", "wcp nmi")
def cluster_purity_nmi(spark, d):
    best = E.zero_shot(table(spark, d, "embeddings"), "vec_id", "embedding", prompts(spark, d), 1).select("vec_id", F.col("label").alias("found"))
    return C.cluster_scores(best.join(table(spark, d, "embeddings").select("vec_id", F.col("label").alias("truth")), "vec_id"), "truth", "found")


@query("WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS ry FROM lineitem) SELECT l_returnflag, count(*)::BIGINT AS n, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) AS rho FROM r GROUP BY 1", "rho")
def spearman_rank(spark, d):
    return C.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount")


@query(f"{LABELLED_SQL}, k AS (SELECT lang, avg((quality = said)::INT) AS same, avg(quality) AS pa, avg(said) AS pb FROM x GROUP BY 1) SELECT lang, same, (same - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0) AS kappa FROM k", "same kappa")
def kappa(spark, d):
    return C.kappa(labelled_docs(spark, d), ["lang"], "quality", "said")


FUZZY_SQL = f"{WITH}, a AS (SELECT DISTINCT video, label FROM e WHERE segment < 16), b AS (SELECT DISTINCT video, label FROM e WHERE segment >= 16), s(l, r) AS (SELECT x.label, y.label FROM (SELECT DISTINCT label FROM e) x, (SELECT DISTINCT label FROM e) y WHERE x.label = y.label OR substr(x.label, 1, 1) = substr(y.label, 1, 1)), f AS (SELECT video, label, EXISTS (SELECT 1 FROM s JOIN b ON b.label = s.r WHERE s.l = a.label AND b.video = a.video) AS hit FROM a), g AS (SELECT video, label, EXISTS (SELECT 1 FROM s JOIN a ON a.label = s.l WHERE s.r = b.label AND a.video = b.video) AS hit FROM b), fa AS (SELECT video, count(*) AS n, count(*) FILTER (hit) AS h FROM f GROUP BY 1), ga AS (SELECT video, count(*) AS n, count(*) FILTER (hit) AS h FROM g GROUP BY 1) SELECT video, coalesce(fa.n - fa.h, 0)::BIGINT AS only_first, coalesce(fa.h, 0)::BIGINT AS common, coalesce(ga.n - ga.h, 0)::BIGINT AS only_second FROM fa FULL JOIN ga USING (video)"


def fuzzy_overlap(spark, d, until, since):
    """Labels of the days before ``until`` against those of the days from ``since``."""
    e = events(spark, d)
    names = e.select("label").distinct()
    sim = names.select(F.col("label").alias("l")).join(names.select(F.col("label").alias("r")), F.left("l", F.lit(1)) == F.left("r", F.lit(1))).withColumn("sim", F.lit(1.0))
    return C.fuzzy_overlap(e.where(F.col("segment") < until).select("video", "label").distinct(), e.where(F.col("segment") >= since).select("video", "label").distinct(), sim, ["video"], "label", 0.9)


@query(FUZZY_SQL)
def fuzzy_topic_overlap(spark, d):
    return fuzzy_overlap(spark, d, 16, 16)


@query(f"{LABELLED_SQL} SELECT lang, source, count(*)::BIGINT AS n, avg((quality = said)::INT) AS recall FROM x GROUP BY GROUPING SETS ((), (lang), (source))", "recall")
def grouping_sets_recall(spark, d):
    x = labelled_docs(spark, d).withColumn("hit", (F.col("quality") == F.col("said")).cast("double"))
    return x.groupingSets([[], [F.col("lang")], [F.col("source")]], F.col("lang"), F.col("source")).agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("recall"))


@query(f"{WITH}, c AS (SELECT label, segment, video, count(*) AS c FROM e GROUP BY ALL) SELECT label, CASE WHEN c <= 1 THEN '0-1' WHEN c <= 2 THEN '2' WHEN c <= 6 THEN '3-6' WHEN c <= 12 THEN '7-12' WHEN c <= 30 THEN '13-30' ELSE '31+' END AS band, count(*)::BIGINT AS n FROM c GROUP BY 1, 2")
def group_sizes_binned(spark, d):
    c = events(spark, d).groupBy("label", "segment", "video").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("label", B.group_size(F.col("c")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {x!r}::DOUBLE)::INT" for x in C.POISSON) + ")"


CI_SQL = f"{WITH}, i AS (SELECT video, avg(value) AS x FROM e GROUP BY 1), w AS (SELECT draw, x, {poisson_sql(uniform_sql(0, 'draw', 'video'))} AS w FROM i, range(1, 201) r(draw)), m AS (SELECT draw, sum(x * w) / nullif(sum(w), 0) AS m FROM w GROUP BY 1), ci AS (SELECT (SELECT avg(x) FROM i) AS mean, (SELECT count(*) FROM i)::BIGINT AS items, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m)"


@query(f"{CI_SQL} SELECT * FROM ci", "mean low high")
def bootstrap_ci(spark, d):
    return C.bootstrap_mean(events(spark, d), "video", "value")


@query(
    f"""{HELL_SQL}, v AS (SELECT video AS item, avg(value) AS m FROM e GROUP BY 1), t AS (SELECT h.a, h.b, h.raw AS x, abs(va.m - vb.m) AS y FROM h JOIN v va ON va.item = a JOIN v vb ON vb.item = b), n AS (SELECT item, row_number() OVER (ORDER BY item) AS pos FROM v),
sh AS (SELECT perm, item, row_number() OVER (PARTITION BY perm ORDER BY CASE WHEN perm = 0 THEN 0 ELSE {uniform_sql(0, 'perm', 'item')} END, item) AS pos FROM v, range(0, 50) r(perm)), f AS (SELECT perm, n.item, sh.item AS other FROM sh JOIN n USING (pos)),
z AS (SELECT f1.perm, t.a, t.b, t.x, u.y FROM t JOIN f f1 ON f1.item = t.a JOIN f f2 ON f2.item = t.b AND f2.perm = f1.perm JOIN t u ON u.a = least(f1.other, f2.other) AND u.b = greatest(f1.other, f2.other)),
k AS (SELECT perm, rank() OVER (PARTITION BY perm ORDER BY x) + (count(*) OVER (PARTITION BY perm, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY perm ORDER BY y) + (count(*) OVER (PARTITION BY perm, y) - 1) / 2 AS ry FROM z),
c AS (SELECT perm, corr(rx, ry) AS rho FROM k GROUP BY 1), o AS (SELECT rho AS own FROM c WHERE perm = 0) SELECT own AS rho, (1 + count(*) FILTER (c.rho >= own)) / 50 AS p FROM c, o WHERE perm > 0 GROUP BY own""",
    "rho p",
)
def mantel_test(spark, d):
    v = events(spark, d).groupBy(F.col("video").alias("item")).agg(F.avg("value").alias("y"))
    items = v.join(blocks.dense(item_mix(spark, d), "item", "label", "share").withColumnRenamed("v", "x"), "item")
    return ranked.mantel(items, ("x", "small mix"), ("y", "scalar"), 49)


@query(
    f"""{WITH}, h AS (SELECT least(floor(value / 200 * 480), 479)::INT AS bin, count(*) AS n FROM e WHERE value BETWEEN 0 AND 200 GROUP BY 1)
SELECT i::INT AS i, i * 200.0::DOUBLE / 240 AS x, sum(exp(-(pow((i * 200.0::DOUBLE / 240 - (bin + 0.5) * 200 / 480) / 4.0, 2)) / 2) / (4.0 * sqrt(2 * pi())) * n) / sum(n) AS density FROM h CROSS JOIN range(241) t(i) GROUP BY 1, 2""",
    "x density",
)
def value_density(spark, d):
    return C.density(events(spark, d), "value", 0.0, 200.0)


# ---------------------------------------------------------------- strings and records


@query("SELECT conv_id, turn, CASE WHEN m <> '' THEN m ELSE t END AS sentence FROM (SELECT conv_id, turn, regexp_extract(b, '(?s)^(.+?[.!?])(\\s|$)', 1) AS m, b AS t FROM (SELECT conv_id, turn, regexp_replace(trim(text), '^[\"'']+|[\"'']+$', '', 'g') AS b FROM conversations))")
def first_sentence(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.first_sentence(F.col("text")).alias("sentence"))


@query("SELECT p_partkey, trim(regexp_replace(translate(lower(p_type), '_', ' '), '-(merged|other|stuff|things?)\\b', '', 'g')) AS label FROM part")
def plain_labels(spark, d):
    return table(spark, d, "part").select("p_partkey", S.plain(F.col("p_type")).alias("label"))


@query()
def vocabulary_match(spark, d):
    return table(spark, d, "documents").select("doc_id", S.vocabulary_match(F.col("text"), ["the", "license", "general public license", "idiot", "clown"]).alias("found"))


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z])(clown|clowns|clownes|idiot|idiots|idiotes|man|mans|manes|men)([^a-z]|$)') AS person FROM documents")
def person_words(spark, d):
    return table(spark, d, "documents").select("doc_id", S.names_any(F.col("text"), ["clown", "idiot", "man"]).alias("person"))


@query(f"{WITH}, r AS (SELECT video, count(*)::BIGINT AS n, avg(value) AS mean, var_samp(value) AS v FROM e GROUP BY 1) SELECT video, n, mean, sqrt(v) AS sd FROM r", "mean sd")
def measures(spark, d):
    s = A.stats(events(spark, d), ["video"], "value")
    m = s.select("video", records.measure(F.col("n"), F.col("mean"), F.col("variance"), F.col("median")).alias("m"))
    return m.select("video", "m.n", "m.mean", "m.sd")


@query()
def item_records(spark, d):
    s = A.stats(events(spark, d), ["video", "segment"], "value")
    t = records.timeline(s, ["video"], "segment", ["n", "mean", "median"])
    return records.sized(t, F.struct("video", "timeline"), F.lit(100_000)).select("video", "json", "bytes", "saved")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*)::BIGINT AS n, sum(value) AS total FROM events GROUP BY 1, 2", "total")
def tumbling_counts(spark, d):
    e = table(spark, d, "events")
    w = F.window("ts", "1 hour")
    return e.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


from . import episodes, frames, images, judged, kits, more, motion, parts, shapes, shown, stores, terminal  # noqa: E402,F401  they register their queries
