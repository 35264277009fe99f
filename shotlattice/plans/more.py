"""More registered queries: measures of media, geometry and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B, geometry as G, strings as S
from ..functions.chance import uniform_sql
from ..operators import joins as J, media as M, meetings, scoring as C, similarity
from ..sources import readers
from .adapters import events, table
from .catalogue import CI_SQL, FIELDS_SQL, LABELLED_SQL, PLACES_SQL, SPANS_SQL, WITH, by_hour, day_spans, labelled_docs, poisson_sql, query

c = F.col


@query(f"{WITH} SELECT video, count(*) FILTER (label <> 'error' AND k >= 20)::BIGINT AS kept, count(*) FILTER (label = 'error')::BIGINT AS withheld_footage, count(*) FILTER (label <> 'error' AND k < 20)::BIGINT AS withheld_quality FROM e GROUP BY 1")
def split_counts(spark, d):
    return M.split_counts(events(spark, d), ["video"], c("label") != "error", c("k") >= 20)


@query(
    f"""{WITH}, p AS (SELECT video, segment, frame, event_id, least(value / 200, 1.2) AS x, k / 100 AS y, (event_id % 10) / 10 AS v FROM e),
s AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(v) OVER w AS v0 FROM p WINDOW w AS (PARTITION BY video, segment ORDER BY frame, event_id))
SELECT video, count(*)::BIGINT AS n, avg(sqrt((x - x0) ** 2 + (y - y0) ** 2)) AS movement FROM s WHERE v >= 0.5 AND v0 >= 0.5 AND x BETWEEN 0 AND 1 AND x0 BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND y0 BETWEEN 0 AND 1 GROUP BY 1""",
    "movement",
)
def pose_movement(spark, d):
    joint = F.struct(F.least(c("value") / 200, F.lit(1.2)).alias("x"), (c("k") / 100).alias("y"), (c("event_id") % 10 / 10).alias("v"))
    return M.pose_movement(events(spark, d).withColumn("joints", F.array(joint)), ["video"], "segment", ["frame", "event_id"], "joints")


@query(f"{WITH} SELECT video, sum(CASE WHEN label = 'purchase' THEN value ELSE 0 END) / sum(value) AS share FROM e WHERE label <> 'error' GROUP BY 1", "share")
def time_share(spark, d):
    return M.weighted_share(events(spark, d), ["video"], c("label") == "purchase", "value", c("label") != "error")


PROFILE_SQL = f"{WITH}, g AS (SELECT video, segment, list(DISTINCT label) AS ls, sum(value) AS w FROM e GROUP BY ALL), x AS (SELECT video, unnest(ls) AS label, w / len(ls) AS w FROM g), t AS (SELECT video, label, sum(w) AS w FROM x GROUP BY ALL)"


@query(f"{PROFILE_SQL} SELECT video, label, w / sum(w) OVER (PARTITION BY video) AS share FROM t", "share")
def split_profile(spark, d):
    g = events(spark, d).groupBy("video", "segment").agg(F.collect_set("label").alias("ls"), F.sum("value").alias("w"))
    return M.split_profile(g, ["video"], "ls", "w")


@query(f"{WITH}, s AS (SELECT segment, video AS person, label AS other, avg(value) AS score FROM e GROUP BY ALL) SELECT *, CASE WHEN row_number() OVER (PARTITION BY segment, person ORDER BY score DESC, other) = 1 THEN score ELSE 0 END AS best FROM s", "score best")
def best_partner(spark, d):
    s = events(spark, d).groupBy("segment", c("video").alias("person"), c("label").alias("other")).agg(F.avg("value").alias("score"))
    return M.best_partner(s, ["segment"], "person", "other", "score")


@query(f"{SPANS_SQL}, l AS (SELECT *, \"end\" - start + 1 AS n FROM s) SELECT video, start, \"end\", n / sum(n) OVER (PARTITION BY video) AS covered FROM l QUALIFY row_number() OVER (PARTITION BY video ORDER BY n DESC, start) = 1", "covered")
def longest_range(spark, d):
    return M.longest(day_spans(spark, d), ["video"], "start", "end")


@query(f"{PLACES_SQL}, p AS (SELECT DISTINCT a.video AS a, b.video AS b FROM h a JOIN h b ON a.hour = b.hour AND a.video < b.video), n AS (SELECT a AS node FROM p UNION ALL SELECT b FROM p) SELECT node, count(*)::BIGINT AS degree FROM n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def graph_degrees(spark, d):
    return meetings.degrees(by_hour(spark, d), "video", "segment", 8)


@query(f"{WITH} SELECT event_id, coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0) AS depth FROM e WINDOW w AS (PARTITION BY video, segment)", "depth")
def min_max_scaled(spark, d):
    return events(spark, d).select("event_id", M.min_max(None, ["video", "segment"], "value").alias("depth"))


@query(
    f"""{WITH}, b AS (SELECT segment, event_id AS id, value - 20 AS x1, k - 20 AS y1, value + 20 + k / 10 AS x2, k + 20 AS y2 FROM e WHERE label = 'view'), p AS (SELECT segment, event_id AS id, value AS x, k AS y FROM e WHERE label = 'error')
SELECT p.id, b.id AS holder FROM p JOIN b ON p.segment = b.segment AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY round((x2 - x1) * (y2 - y1), 6), b.id) = 1"""
)
def smallest_holder(spark, d):
    e = events(spark, d)
    b = e.where("label = 'view'").select("segment", c("event_id").alias("id"), G.box(c("value") - 20, c("k") - 20, c("value") + 20 + c("k") / 10, c("k") + 20).alias("box"))
    return M.smallest_holder(e.where("label = 'error'").select("segment", c("event_id").alias("id"), c("value").alias("x"), c("k").alias("y")), b, ["segment"], "x", "y")


@query(f"{WITH}, a AS (SELECT video, label FROM e WHERE segment < 16), b AS (SELECT video, label FROM e WHERE segment >= 16) SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def differing_rows(spark, d):
    e = events(spark, d)
    return M.differing(e.where("segment < 16").select("video", "label"), e.where("segment >= 16").select("video", "label"))


@query(f"{WITH}, a AS (SELECT label, count(value)::BIGINT AS n, stddev_pop(value) AS sd, avg((value NOT BETWEEN 1 AND 150)::INT) AS o FROM e GROUP BY 1) SELECT label, n, array_to_string(list_filter([CASE WHEN n >= 20 AND sd < 1.49 THEN 'constant' END, CASE WHEN o > 0.01 THEN 'out of range' END], lambda x: x IS NOT NULL), ',') AS flags FROM a")
def numeric_flags(spark, d):
    return M.numeric_flags(events(spark, d), ["label"], "value", 1.0, 150.0)


@query(f"{WITH}, n AS (SELECT video, label, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT video, max(n) AS m, sum(n) AS n FROM n GROUP BY 1) SELECT video, n::BIGINT AS n, m / n AS top, n >= 20 AND m / n >= 0.5 AS collapsed FROM t", "top")
def collapsed_labels(spark, d):
    return M.collapsed(events(spark, d), ["video"], "label", 0.5)


@query(f"{WITH} SELECT event_id, (SELECT o FROM (VALUES (0), (25), (40), (90)) t(o) ORDER BY abs(k - o), o LIMIT 1)::INT AS option FROM e")
def nearest_option(spark, d):
    return events(spark, d).select("event_id", M.nearest_option(c("k"), [0, 25, 40, 90]).alias("option"))


@query(f"{LABELLED_SQL}, g AS (SELECT lang, cut, quality = 1 AS t, n_chars >= cut AS s FROM x CROSS JOIN (VALUES (500.0::DOUBLE), (1000.0), (3000.0)) v(cut)), a AS (SELECT lang, cut, count(*) FILTER (t AND s) AS tp, count(*) FILTER (NOT t AND s) AS fp, count(*) FILTER (t AND NOT s) AS fn FROM g GROUP BY 1, 2) SELECT lang, cut, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM a", "cut precision recall f1")
def threshold_sweep(spark, d):
    return M.swept(labelled_docs(spark, d), "quality", "n_chars", [500.0, 1000.0, 3000.0], ["lang"])


@query(f"{WITH}, i AS (SELECT label, video, avg(value) AS m, quantile_cont(value, 0.5) AS p FROM e GROUP BY ALL) SELECT label, count(*)::BIGINT AS items, avg(m) AS mean, quantile_cont(p, 0.5) AS median FROM i GROUP BY 1", "mean median")
def typical_values(spark, d):
    return M.typical(events(spark, d), "label", "video", "value")


@query(f"{WITH}, r AS (SELECT label, avg((value >= 60)::INT) AS rate FROM e GROUP BY 1), o AS (SELECT label, k, row_number() OVER (PARTITION BY label ORDER BY k) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM e) SELECT label, rate, min(k) + (max(k) - min(k)) * max((1 - rate) * (n - 1) - floor((1 - rate) * (n - 1))) AS cut FROM o JOIN r USING (label) WHERE r = floor((1 - rate) * (n - 1)) OR r = ceil((1 - rate) * (n - 1)) GROUP BY 1, 2", "rate cut")
def matched_cuts(spark, d):
    return M.matched_cut(events(spark, d), ["label"], "value", "k", 60.0)


@query(f"{WITH}, a AS (SELECT event_id AS id, video, label, row_number() OVER (PARTITION BY video ORDER BY event_id) AS r, row_number() OVER (PARTITION BY video ORDER BY {uniform_sql(1, 'event_id')}, event_id) AS h FROM e) SELECT a.id, a.label, b.label AS dealt FROM a JOIN a b ON a.video = b.video AND a.r = b.h")
def dealt_labels(spark, d):
    return M.dealt(events(spark, d).select(c("event_id").alias("id"), "video", "label"), ["video"], "label", 1).select("id", "label", "dealt")


@query(f"{WITH}, a AS (SELECT video, event_id AS id, frame AS s, frame + k * 60 AS t FROM e) SELECT x.video, x.id AS a, y.id AS b FROM a x JOIN a y ON x.video = y.video AND x.id < y.id AND x.s <= y.t AND y.s <= x.t")
def overlapping_ranges(spark, d):
    a = events(spark, d).select("video", c("event_id").alias("id"), c("frame").alias("start"), (c("frame") + c("k") * 60).alias("end"))
    return J.overlapping(a, a, ["video"], 6000).where("a_id < b_id").select("video", c("a_id").alias("a"), c("b_id").alias("b"))


@query("SELECT l.doc_id FROM documents l WHERE l.doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_keys(spark, d):
    return readers.missing(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY {uniform_sql(3, 'o_orderkey')}, o_orderkey LIMIT 50")
def seeded_sample(spark, d):
    return readers.seeded_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", table(spark, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey")), 50, 3)


@query("SELECT source, CASE WHEN p = '' THEN '' ELSE p END AS prefix FROM (SELECT source, coalesce(regexp_extract(left(lo, coalesce(list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda i: left(lo, i) = left(hi, i))), 0)), '^(.*[-_ #/])?', 1), '') AS p FROM (SELECT p_brand AS source, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY 1))")
def shared_prefixes(spark, d):
    ends = table(spark, d, "part").groupBy(c("p_brand").alias("source")).agg(F.min("p_name").alias("lo"), F.max("p_name").alias("hi"))
    return ends.select("source", S.shared_prefix(c("lo"), c("hi")).alias("prefix"))


@query(f"{WITH}, w AS (SELECT avg(k) FILTER (label = 'view') AS a, count(*) AS n, sum(value) AS v, video FROM e GROUP BY video) SELECT video, CASE WHEN a > 52 THEN 'warm' WHEN a < 48 THEN 'cool' WHEN a IS NOT NULL THEN 'neutral' END AS tone, CASE WHEN n = 0 THEN 'empty' WHEN n < 60 THEN 'under_tracked' WHEN n > 120 THEN 'turnover_or_fragmented' ELSE 'consistent' END AS tracks FROM w")
def named_bands(spark, d):
    w = events(spark, d).groupBy("video").agg((F.avg(F.when(c("label") == "view", c("k"))) - 47).alias("a"), F.count(F.lit(1)).alias("n"))
    return w.select("video", F.when(c("a") > 5, "warm").when(c("a") < 1, "cool").when(c("a").isNotNull(), "neutral").alias("tone"), B.assess(F.lit(60), c("n")).alias("tracks"))


@query(f"{LABELLED_SQL}, s AS (SELECT source, avg(quality) AS p FROM x GROUP BY 1), l AS (SELECT lang, avg(p) AS p FROM (SELECT lang, source, avg(quality) AS p FROM x GROUP BY 1, 2) GROUP BY 1) SELECT lang, p FROM l", "p")
def mean_of_means(spark, d):
    each = labelled_docs(spark, d).groupBy("lang", "source").agg(F.avg("quality").alias("p"))
    return each.groupBy("lang").agg(F.avg("p").alias("p"))


def readings(spark, d):
    """Readings of users as a collection for the similarity query."""
    e = events(spark, d).withColumnRenamed("video", "item")
    named = lambda df, name: df.withColumn("field", F.lit(name))
    w = e.groupBy("item", "label").agg(F.sum("value").alias("w"))
    labels = named(w, "medium").unionByName(named(w, "objects"))
    x = e.groupBy("item").agg(F.avg("value").alias("x"))
    y = e.groupBy("item").agg(F.avg((c("label") == "error").cast("double")).alias("x"))
    numbers = named(x, "brightness").unionByName(named(y, "outdoor"))
    samples = named(e.select("item", F.log1p("value").alias("x"), F.lit(1.0).alias("w")), "shot lengths")
    arc = e.groupBy("item", c("segment").alias("place")).agg(F.avg("value").alias("x"), F.max("label").alias("state"), F.count(F.lit(1)).cast("double").alias("w"))
    return similarity.Readings(e.select("item").distinct(), labels, numbers, samples, named(arc, "brightness arc").unionByName(named(arc, "emotion arc")), tuple(f for f in similarity.FIELDS if f[0] in ("medium", "objects", "brightness", "outdoor", "shot lengths")), tuple(f for f in similarity.ARCS if f[0] in ("brightness arc", "emotion arc")))


#: All fields and arcs with readings of their own from the same events: field i takes those with (k + i) % 3 <> 0, every fifth none of the users whose number is divisible by 7.
EVERY = tuple((i, *f) for i, f in enumerate((*similarity.FIELDS, *similarity.ARCS)))


def all_readings(spark, d):
    rows = spark.createDataFrame([(i, name, kind, name.endswith(" arc")) for i, name, _, _, kind in EVERY], "i int, field string, kind string, arc boolean")
    x = events(spark, d).withColumnRenamed("video", "item").crossJoin(F.broadcast(rows))  # 40 rows beside each
    x = x.where(((c("k") + c("i")) % 3 != 0) & ((c("i") % 5 != 0) | (c("item") % 7 != 0)))
    x = x.withColumn("label", F.when(c("kind") == "histogram", F.concat(F.element_at(F.array(*map(F.lit, "rgb")), (c("k") % 3 + 1).cast("int")), F.lit(":"), c("event_id") % 4)).otherwise(c("label")))
    f = x.where("not arc")
    labels = f.where("kind in ('mix', 'set', 'histogram')").groupBy("field", "item", "label").agg(F.sum("value").alias("w"))
    share = F.avg((c("label") == "error").cast("double"))
    numbers = f.where("kind in ('share', 'scalar')").groupBy("field", "item", "kind").agg(share.alias("s"), F.avg("value").alias("v")).select("field", "item", F.when(c("kind") == "share", c("s")).otherwise(c("v")).alias("x"))
    samples = f.where("kind = 'samples'").select("field", "item", F.log1p("value").alias("x"), F.lit(1.0).alias("w"))
    arcs = x.where("arc").groupBy("field", "item", c("segment").alias("place")).agg(F.avg("value").alias("x"), F.max("label").alias("state"), F.count(F.lit(1)).cast("double").alias("w"))
    return similarity.Readings(events(spark, d).select(c("video").alias("item")).distinct(), labels, numbers, samples, arcs)


EVERY_SQL = f"""{WITH}, fl(i, field, level, grp, kind) AS (VALUES {', '.join(f"({i}, '{n}', '{lv}', '{g}', '{k}')" for i, n, lv, g, k in EVERY)}), it AS (SELECT DISTINCT video AS item FROM e),
x AS (SELECT fl.*, e.video AS item, event_id, segment, value, k, CASE WHEN kind = 'histogram' THEN ['r', 'g', 'b'][k % 3 + 1] || ':' || (event_id % 4) ELSE label END AS label FROM e, fl WHERE (k + i) % 3 <> 0 AND (i % 5 <> 0 OR e.video % 7 <> 0)),
lb AS (SELECT field, kind, item, label, sum(value) AS w FROM x WHERE grp <> 'arc' AND kind IN ('mix', 'set', 'histogram') GROUP BY ALL), sh AS (SELECT field, item, CASE WHEN kind = 'histogram' THEN left(label, 1) ELSE '' END AS part, label, w FROM lb WHERE kind <> 'set'),
ar AS (SELECT field, kind, item, segment AS place, avg(value) AS x, max(label) AS state, count(*)::DOUBLE AS w FROM x WHERE grp = 'arc' GROUP BY ALL), st AS (SELECT field, kind, item, place, w, x - lag(x) OVER o AS step, state || ' > ' || lead(state) OVER o AS change, w + lead(w) OVER o AS w2 FROM ar WINDOW o AS (PARTITION BY field, item ORDER BY place)),
fs AS (SELECT field, quantile_cont(abs(step), 0.5) / 2 AS flat FROM st WHERE kind = 'number' AND step <> 0 GROUP BY 1), mv AS (SELECT field, item, CASE WHEN step > flat THEN 'rising' WHEN step < -flat THEN 'falling' ELSE 'flat' END AS label, sum(w) AS w FROM st JOIN fs USING (field) WHERE kind = 'number' AND step IS NOT NULL GROUP BY ALL UNION ALL SELECT field, item, change, sum(w2) FROM st WHERE kind <> 'number' AND change IS NOT NULL GROUP BY ALL),
pt AS (SELECT field, item, part, label, w / sum(w) OVER (PARTITION BY field, item, part) AS p FROM (SELECT * FROM sh UNION ALL SELECT field, item, '' AS part, label, w FROM mv)), hv AS (SELECT DISTINCT field, item, part FROM pt),
rt AS (SELECT a.field, a.item AS a, b.item AS b, a.part, sum(sqrt(a.p * b.p)) AS root FROM pt a JOIN pt b ON a.field = b.field AND a.part = b.part AND a.label = b.label AND a.item < b.item GROUP BY ALL),
hd AS (SELECT x.field, x.item AS a, y.item AS b, avg(sqrt(greatest(0, 1 - coalesce(root, 0)))) AS raw FROM hv x JOIN hv y ON x.field = y.field AND x.part = y.part AND x.item < y.item LEFT JOIN rt ON rt.field = x.field AND rt.a = x.item AND rt.b = y.item AND rt.part = x.part GROUP BY 1, 2, 3),
sn AS (SELECT field, count(DISTINCT item) AS n FROM lb WHERE kind = 'set' GROUP BY 1), sd AS (SELECT field, label, count(DISTINCT item) AS df FROM lb WHERE kind = 'set' GROUP BY ALL), sw AS (SELECT lb.field, item, label, CASE WHEN field IN ('tags', 'place', 'objects', 'animals') THEN w * ln((n + 1) / df) ELSE w END AS w FROM lb JOIN sn USING (field) JOIN sd USING (field, label)),
tw AS (SELECT field, item, sum(w) AS t FROM sw GROUP BY ALL), lw AS (SELECT a.field, a.item AS a, b.item AS b, sum(least(a.w, b.w)) AS low FROM sw a JOIN sw b ON a.field = b.field AND a.label = b.label AND a.item < b.item GROUP BY ALL), jd AS (SELECT x.field, x.item AS a, y.item AS b, 1 - coalesce(low, 0) / nullif(x.t + y.t - coalesce(low, 0), 0) AS raw FROM tw x JOIN tw y ON x.field = y.field AND x.item < y.item LEFT JOIN lw ON lw.field = x.field AND lw.a = x.item AND lw.b = y.item),
nm AS (SELECT field, item, CASE WHEN kind = 'share' THEN avg((label = 'error')::INT) ELSE avg(value) END AS x FROM x WHERE kind IN ('share', 'scalar') GROUP BY field, kind, item), nd AS (SELECT x.field, x.item AS a, y.item AS b, abs(x.x - y.x) AS raw FROM nm x JOIN nm y ON x.field = y.field AND x.item < y.item),
sa AS (SELECT field, item, ln(1 + value) AS x, row_number() OVER o AS r, count(*) OVER (PARTITION BY field, item) AS n FROM x WHERE kind = 'samples' WINDOW o AS (PARTITION BY field, item ORDER BY value)), sp AS (SELECT field, item, x, (r - 0.5) / n AS pos, lead(x) OVER o AS x2, lead((r - 0.5) / n) OVER o AS pos2, r FROM sa WINDOW o AS (PARTITION BY field, item ORDER BY r)), gr AS (SELECT i AS pt, (i + 0.5) / 100 AS t FROM range(100) g(i)),
sq AS (SELECT field, item, pt, CASE WHEN t <= pos OR pos2 IS NULL THEN x ELSE x + (x2 - x) * (t - pos) / (pos2 - pos) END AS q FROM sp JOIN gr ON (t >= pos OR r = 1) AND (pos2 IS NULL OR t < pos2)), wd AS (SELECT x.field, x.item AS a, y.item AS b, avg(abs(x.q - y.q)) AS raw FROM sq x JOIN sq y ON x.field = y.field AND x.pt = y.pt AND x.item < y.item GROUP BY ALL),
raw AS (SELECT * FROM hd UNION ALL SELECT * FROM jd UNION ALL SELECT * FROM nd UNION ALL SELECT * FROM wd), q9 AS (SELECT field, quantile_cont(raw, 0.9) AS q FROM raw JOIN fl USING (field) WHERE kind IN ('scalar', 'samples') GROUP BY 1),
cal AS (SELECT raw.field, a, b, CASE WHEN q > 0 THEN least(raw / q, 1) ELSE raw END AS v FROM raw LEFT JOIN q9 USING (field) WHERE raw IS NOT NULL), mn AS (SELECT field, avg(v) AS m FROM cal GROUP BY 1),
ha AS (SELECT DISTINCT field, item FROM hv UNION SELECT field, item FROM tw UNION SELECT field, item FROM nm UNION SELECT DISTINCT field, item FROM sq), pr AS (SELECT x.item AS a, y.item AS b FROM it x JOIN it y ON x.item < y.item),
im AS (SELECT fl.level, fl.grp, pr.a, pr.b, CASE WHEN v IS NOT NULL THEN v WHEN (h1.item IS NULL) <> (h2.item IS NULL) THEN m END AS v FROM fl CROSS JOIN pr LEFT JOIN cal ON cal.field = fl.field AND cal.a = pr.a AND cal.b = pr.b LEFT JOIN ha h1 ON h1.field = fl.field AND h1.item = pr.a LEFT JOIN ha h2 ON h2.field = fl.field AND h2.item = pr.b LEFT JOIN mn ON mn.field = fl.field),
gm AS (SELECT a, b, level, grp, avg(v) AS s FROM im GROUP BY ALL), lm AS (SELECT a, b, level, avg(s) AS s FROM gm GROUP BY ALL), al AS (SELECT a, b, avg(s) AS s FROM lm GROUP BY ALL)"""


@query(f"{EVERY_SQL}, y AS (SELECT a AS item, b AS other, s AS score FROM al UNION ALL SELECT b, a, s FROM al) SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(score, 12), other)::INT AS rank FROM y WHERE score IS NOT NULL QUALIFY rank <= 5", "score")
def similarity_nearest(spark, d):
    return similarity.in_blocks(all_readings(spark, d)).nearest(5)


@query(f"{EVERY_SQL} SELECT a, b, level, grp, s AS score FROM gm UNION ALL SELECT a, b, level, NULL, s FROM lm UNION ALL SELECT a, b, NULL, NULL, s FROM al", "score")
def similarity_tree(spark, d):
    return similarity.in_blocks(all_readings(spark, d)).tree()


@query()
def similarity_rank_order(spark, d):
    return similarity.order_by_rank(readings(spark, d))


@query(f"{CI_SQL} SELECT mean, low, high, CASE WHEN low >= 40 AND high <= 60 THEN 'pass' WHEN high < 40 OR low > 60 THEN 'fail' ELSE 'weak' END AS verdict FROM ci", "mean low high")
def interval_verdicts(spark, d):
    ci = C.bootstrap_mean(events(spark, d), "video", "value")
    return ci.select("mean", "low", "high", B.verdict(c("low"), c("high"), F.lit(40.0), F.lit(60.0)).alias("verdict"))


@query(f"{WITH}, s AS (SELECT video, label, segment, value / 200 AS share FROM e WHERE value >= 50) SELECT video, label, list_aggregate(list_sort(list(DISTINCT segment)), 'string_agg', ',') AS segments, sum(share) AS seconds FROM s GROUP BY 1, 2", "seconds")
def subjects(spark, d):
    s = events(spark, d).where("value >= 50")
    return s.groupBy("video", "label").agg(F.array_join(F.array_sort(F.collect_set("segment")), ",").alias("segments"), F.sum(c("value") / 200).alias("seconds"))


@query(f"{WITH}, b AS (SELECT video, segment, avg(k) FILTER (label = 'view') AS back FROM e GROUP BY ALL), t AS (SELECT video, segment, label, avg(k) AS d FROM e WHERE label <> 'view' GROUP BY ALL) SELECT video, segment, label, d / nullif(back, 0) AS ratio, row_number() OVER (PARTITION BY video, segment ORDER BY d DESC, label)::INT AS rank FROM t JOIN b USING (video, segment)", "ratio")
def depth_order(spark, d):
    e = events(spark, d)
    back = e.groupBy("video", "segment").agg(F.avg(F.when(c("label") == "view", c("k"))).alias("back"))
    t = e.where("label <> 'view'").groupBy("video", "segment", "label").agg(F.avg("k").alias("d")).join(back, ["video", "segment"])
    ranked = t.select("video", "segment", "label", F.try_divide("d", "back").alias("ratio"), "d")
    from ..operators.stats import top_by

    return top_by(ranked, ["video", "segment"], [c("d").desc(), c("label")], 1 << 30).drop("d")


@query(f"{WITH} SELECT event_id, CASE WHEN k / 100 < 1 / 3 THEN 'top' WHEN k / 100 > 2 / 3 THEN 'bottom' ELSE 'middle' END || ' ' || CASE WHEN value / 200 < 1 / 3 THEN 'left' WHEN value / 200 > 2 / 3 THEN 'right' ELSE 'centre' END AS place FROM e")
def grid_places(spark, d):
    return events(spark, d).select("event_id", G.ninth(c("value") / 200, c("k") / 100).alias("place"))


@query(f"{WITH}, t AS (SELECT video, segment, label, quantile_cont(value, 0.5) AS height FROM e GROUP BY ALL) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY video, segment ORDER BY height DESC, label) = 1", "height")
def tallest_track(spark, d):
    from ..operators.stats import top_by

    t = events(spark, d).groupBy("video", "segment", "label").agg(F.percentile("value", F.lit(0.5)).alias("height"))
    return top_by(t, ["video", "segment"], [c("height").desc(), c("label")], 1).drop("rank")


@query(f"{WITH} SELECT event_id, least(greatest((k - 0.2 * 40) / 200, 0), 1) AS x1, least(greatest((segment - 0.4 * 60) / 100, 0), 1) AS y1, least(greatest((k + 40 + 0.2 * 40) / 200, 0), 1) AS x2, least(greatest((segment + 60 + 0.1 * 60) / 100, 0), 1) AS y2 FROM e", "x1 y1 x2 y2")
def head_boxes(spark, d):
    b = G.head_box(G.box(c("k"), c("segment"), c("k") + 40, c("segment") + 60), F.lit(200), F.lit(100))
    return events(spark, d).select("event_id", b.alias("b")).select("event_id", "b.*")


@query(f"{WITH} SELECT event_id, k / 100 * exp(-pow(abs(((((value * 3 - segment * 12 + 180) % 360) + 360) % 360) - 180) / 20, 2)) AS score FROM e", "score")
def look_scores(spark, d):
    return events(spark, d).select("event_id", G.look_score(c("k") / 100, c("value") * 3, c("segment") * 12.0).alias("score"))


def centroid_labels(spark, d):
    from ..operators import entity as E
    from .catalogue import prompts

    v = table(spark, d, "embeddings")
    return E.zero_shot(v, "vec_id", "embedding", prompts(spark, d), 1).select("vec_id", c("label").alias("found")).join(v.select("vec_id", c("label").alias("truth")), "vec_id")


@query()
def assignment_scores(spark, d):
    from ..operators import assess

    return assess.assignment_scores(centroid_labels(spark, d).withColumn("item", F.lit(1)), "item", "truth", "found")


@query(
    f"""{FIELDS_SQL}, pw AS (SELECT a AS item, b AS other, imputed AS d FROM imp WHERE field = 'mix' AND imputed IS NOT NULL UNION ALL SELECT b, a, imputed FROM imp WHERE field = 'mix' AND imputed IS NOT NULL), sm AS (SELECT item, item % 3 AS own, other % 3 AS c, avg(d) AS d FROM pw GROUP BY ALL),
ab AS (SELECT item, own, max(d) FILTER (own = c) AS a, min(d) FILTER (own <> c) AS b FROM sm GROUP BY ALL) SELECT item, own::BIGINT AS cluster, coalesce((b - a) / nullif(CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(a, b) END, 0), 0) AS silhouette FROM ab""",
    "silhouette",
)
def cluster_silhouettes(spark, d):
    from ..operators import assess
    from .catalogue import collection

    x = collection(spark, d)
    members = x.items.select("item", F.pmod("item", F.lit(3)).alias("cluster"))
    return assess.silhouettes_of(x.to_clusters(members, "mix"))


@query(
    f"""{FIELDS_SQL}, im AS (SELECT field, a, b, imputed AS v FROM imp WHERE imputed IS NOT NULL), base AS (SELECT a, b, avg(v) AS d FROM im GROUP BY ALL), dr AS (SELECT draw, a, b, sum(v * w) / sum(w) AS d FROM (SELECT draw, a, b, v, exp(2 * {uniform_sql(0, 'draw', 'field')} - 1) AS w FROM im, range(1, 21) r(draw)) GROUP BY ALL),
nr AS (SELECT draw, item, other FROM (SELECT draw, a AS item, b AS other, d FROM dr UNION ALL SELECT draw, b, a, d FROM dr) QUALIFY row_number() OVER (PARTITION BY draw, item ORDER BY d, other) <= 5), o AS (SELECT item, other FROM (SELECT a AS item, b AS other, d FROM base UNION ALL SELECT b, a, d FROM base) QUALIFY row_number() OVER (PARTITION BY item ORDER BY d, other) <= 5)
SELECT o.item, count(nr.draw) / (count(DISTINCT o.other) * 20) AS overlap FROM o LEFT JOIN nr ON nr.item = o.item AND nr.other = o.other GROUP BY 1""",
    "overlap",
)
def neighbour_stability(spark, d):
    from .catalogue import collection

    return collection(spark, d).stability()


@query(
    f"""{LABELLED_SQL}, g AS (SELECT *, (quality = 1)::INT AS good FROM x), w AS (SELECT draw, n_chars, sum(good * w) AS p, sum(w) AS n FROM (SELECT draw, n_chars, good, {poisson_sql(uniform_sql(0, 'draw', 'doc_id'))} AS w FROM g, range(1, 51) r(draw)) GROUP BY ALL),
r AS (SELECT draw, p, sum(p) OVER o / nullif(sum(n) OVER o, 0) AS pr FROM w WINDOW o AS (PARTITION BY draw ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)), ap AS (SELECT draw, sum(pr * p) / nullif(sum(p), 0) AS ap FROM r GROUP BY 1),
h AS (SELECT n_chars, sum(good) AS p, count(*) AS n FROM g GROUP BY 1), hr AS (SELECT p, sum(p) OVER o / sum(n) OVER o AS pr FROM h WINDOW o AS (ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)) SELECT (SELECT sum(pr * p) / sum(p) FROM hr) AS ap, quantile_cont(ap, 0.025) AS low, quantile_cont(ap, 0.975) AS high FROM ap""",
    "ap low high",
)
def precision_interval(spark, d):
    from ..operators import assess

    return assess.precision_interval(labelled_docs(spark, d).withColumn("good", c("quality") == 1), "doc_id", "good", "n_chars")
