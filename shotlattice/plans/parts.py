"""Queries of record assembly, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import assembly as P
from .adapters import events, table
from .catalogue import WITH, query

c = F.col


def people(spark, d):
    return events(spark, d).withColumn("person", (c("k") / 10).cast("int"))


PEOPLE = f"{WITH}, x AS (SELECT *, (k // 10)::INT AS person FROM e)"


@query(f"{PEOPLE}, t AS (SELECT video, segment, person, min(frame) AS first, max(frame) AS last, count(*)::BIGINT AS rows FROM x GROUP BY ALL HAVING count(*) >= 2) SELECT *, row_number() OVER (PARTITION BY video ORDER BY first, segment, person) AS track FROM t")
def dense_tracks(spark, d):
    return P.dense_tracks(people(spark, d), "video", ["segment", "person"], "frame", 2)


PROFILE = f"{PEOPLE}, k0 AS (SELECT video, segment, frame // 21600 AS kf, label, count(*) AS n FROM x GROUP BY ALL), fr AS (SELECT video, segment, count(DISTINCT kf) AS m FROM k0 GROUP BY ALL), pr AS (SELECT video, segment, label, max(n)::BIGINT AS most, count(*) / any_value(m) AS agreement FROM k0 JOIN fr USING (video, segment) WHERE label <> 'error' GROUP BY ALL)"


def profiles(spark, d):
    e = events(spark, d).withColumn("kf", F.floor(c("frame") / 21600)).withColumn("label", F.nullif("label", F.lit("error")))
    return P.profile(e, ["video", "segment"], "kf", "label")


@query(f"{PROFILE} SELECT * FROM pr", "agreement")
def segment_profile(spark, d):
    return profiles(spark, d)


@query(f"{PROFILE}, t AS (SELECT video, label, sum(most)::BIGINT AS total FROM pr GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY video ORDER BY total DESC, label) AS rank FROM t")
def profile_rollup(spark, d):
    return P.rollup(profiles(spark, d), "video", "label")


@query(
    f"""{PEOPLE}, g AS (SELECT video, person, segment, count(*) / 24 AS seconds, count(*)::BIGINT AS series, avg((label = 'view')::INT) AS share_glad, avg((label = 'click')::INT) AS share_calm, avg(value) AS value_mean, quantile_cont(value, 0.5) AS value_median, var_samp(value) AS value_variance FROM x GROUP BY ALL)
SELECT *, CASE WHEN share_calm >= share_glad THEN 'calm' ELSE 'glad' END AS modal FROM g""",
    "seconds share_glad share_calm value_mean value_median value_variance",
)
def person_segments(spark, d):
    felt = {"glad": (c("label") == "view").cast("int"), "calm": (c("label") == "click").cast("int")}
    return P.person_segments(people(spark, d), ["video", "person", "segment"], felt, "value", 24.0)


@query(
    f"{PEOPLE} SELECT video, person, min(frame) AS first_frame, max(frame) AS last_frame, count(DISTINCT frame)::BIGINT AS frames, count(DISTINCT segment)::BIGINT AS segments, count(*)::BIGINT AS series, count(*) FILTER (label = 'view')::BIGINT AS face, count(*) FILTER (label <> 'error')::BIGINT AS pose, avg((value / 100 >= 0.5)::INT) AS inside_share FROM x GROUP BY ALL",
    "inside_share",
)
def person_totals(spark, d):
    return P.person_totals(people(spark, d), ["video", "person"], "segment", "frame", {"face": c("label") == "view", "pose": c("label") != "error"}, c("value") / 100)


@query(f"{PEOPLE}, m AS (SELECT video, person, label, avg(value) AS mean, count(value)::BIGINT AS n FROM x GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY video, person ORDER BY round(mean, 9) DESC, label) AS rank FROM m QUALIFY rank <= 2", "mean")
def top_means(spark, d):
    return P.top_means(people(spark, d), ["video", "person"], "label", "value", 2)


WHOLE = f"{WITH}, s AS (SELECT video, segment, (max(frame) - min(frame) + 60) / 24 AS seconds, count(*) AS n FROM e GROUP BY ALL), tot AS (SELECT video, sum(seconds) AS seconds FROM s GROUP BY 1)"


@query(f"{WHOLE}, w AS (SELECT e.video, label, sum(s.seconds / s.n) AS w FROM e JOIN s USING (video, segment) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY round(w, 9) DESC, label) AS rank FROM w) SELECT video, label, w / seconds AS share, rank FROM r JOIN tot USING (video) WHERE rank <= 3", "share")
def whole_item(spark, d):
    e = events(spark, d)
    s = e.groupBy("video", "segment").agg(((F.max("frame") - F.min("frame") + 60) / 24).alias("seconds"), F.count(F.lit(1)).alias("n"))
    rows = e.join(s, ["video", "segment"]).select("video", F.concat(F.lit(" "), c("label")).alias("label"), (c("seconds") / c("n")).alias("w"))
    return P.whole_item(rows, s.groupBy("video").agg(F.sum("seconds").alias("seconds")), "video", "label", "w", 3)


@query(
    f"{WITH}, s AS (SELECT video, segment, count(*) AS n, sum(value) AS w FROM e GROUP BY ALL), l AS (SELECT video, segment, label, count(*) AS cn FROM e GROUP BY ALL), m AS (SELECT video, label, sum(cn / n * w) AS s0 FROM l JOIN s USING (video, segment) GROUP BY ALL), t AS (SELECT video, sum(w) AS t FROM s GROUP BY 1), a AS (SELECT m.video, label, s0 / t AS mean FROM m JOIN t USING (video)) SELECT *, row_number() OVER (PARTITION BY video ORDER BY round(mean, 9) DESC, label) = 1 AS leads FROM a",
    "mean",
)
def weighted_distribution(spark, d):
    e = events(spark, d)
    s = e.groupBy("video", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("w"))
    shares = e.groupBy("video", "segment", "label").agg(F.count(F.lit(1)).alias("cn")).join(s, ["video", "segment"]).withColumn("share", c("cn") / c("n"))
    return P.weighted_distribution(shares, ["video"], "segment", "label", "share", "w")


@query(f"{WITH}, h AS (SELECT video, segment, frame // 3600 AS hour, label FROM e), l AS (SELECT video, segment, count(DISTINCT hour) AS detected FROM h WHERE hour % 2 = 0 GROUP BY ALL), f AS (SELECT video, segment, label, count(DISTINCT hour)::BIGINT AS frames FROM h WHERE hour % 2 = 0 AND label IN ('view', 'click') GROUP BY ALL) SELECT *, frames / detected AS share FROM f JOIN l USING (video, segment)", "share")
def objects_found(spark, d):
    h = events(spark, d).withColumn("hour", F.floor(c("frame") / 3600))
    return P.objects_found(h.where("label in ('view', 'click')"), h.where("hour % 2 = 0"), ["video", "segment"], "hour", "label")


@query(f"{WITH}, s AS (SELECT DISTINCT video, segment FROM e), m AS (SELECT video, segment, max(n) AS most FROM (SELECT video, segment, frame // 21600 AS f, count(*) AS n FROM e WHERE label <> 'error' GROUP BY ALL) GROUP BY ALL) SELECT video, segment, coalesce(most, 0)::BIGINT AS most FROM s LEFT JOIN m USING (video, segment)")
def most_at_once(spark, d):
    e = events(spark, d).withColumn("f", F.floor(c("frame") / 21600))
    return P.most_at_once(e, e, ["video", "segment"], "f", c("label") != "error")


RELATION = f"""{WITH}, l AS (SELECT video, label, segment, count(*) FILTER (value > 50) AS hits, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT video, label, sum(hits) / sum(n) AS share, sum(n)::BIGINT AS n FROM l GROUP BY ALL),
pk AS (SELECT video, label, segment AS peak, hits / n AS best FROM l WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY video, label ORDER BY hits / n DESC, n DESC, segment) = 1), sd AS (SELECT t.*, peak, best FROM t LEFT JOIN pk USING (video, label)),
r AS (SELECT v.video, a.share AS ab, a.peak AS ab_peak, a.best AS ab_best, b.share AS ba, b.best AS ba_best, v.n > 60 AS sync FROM (SELECT video, count(*) AS n FROM e GROUP BY 1) v LEFT JOIN sd a ON a.video = v.video AND a.label = 'view' LEFT JOIN sd b ON b.video = v.video AND b.label = 'click')"""


@query(f"{RELATION} SELECT video, ab, ab_peak, ba, ba_best, sync OR coalesce(ab_best >= 0.8, false) OR coalesce(ba_best >= 0.8, false) AS listed, ab IS NULL AND ba IS NULL AS unmeasured FROM r", "ab ba ba_best")
def relation_records(spark, d):
    e = events(spark, d)
    looks = e.groupBy("video", "label", "segment").agg(F.count_if(c("value") > 50).alias("hits"), F.count(F.lit(1)).alias("n"))
    sides = looks.groupBy("video").pivot("label", ["view", "click"]).agg(F.array_sort(F.collect_list(F.struct("segment", "hits", "n"))))
    ab, ba = P.side(c("view"), 2), P.side(c("click"), 2)
    total = e.groupBy("video").agg(F.count(F.lit(1)).alias("n"))
    r = sides.join(total, "video").select("video", P.relation(F.lit("a"), F.lit("b"), c("n"), ab, ba, F.when(c("n") > 60, c("n"))).alias("r"), P.evidenced(c("n") > 60, [ab, ba], 0.8).alias("listed"))
    return r.select("video", c("r.looks_at.a_to_b.share").alias("ab"), c("r.looks_at.a_to_b.peak.segment").alias("ab_peak"), c("r.looks_at.b_to_a.share").alias("ba"), c("r.looks_at.b_to_a.peak.share").alias("ba_best"), "listed", c("r.looks_at").isNull().alias("unmeasured"))


@query(
    f"""{PEOPLE}, r AS (SELECT video, label AS text, row_number() OVER (PARTITION BY video ORDER BY count(*) DESC, label) AS rank FROM x GROUP BY video, label), b AS (SELECT DISTINCT video, label AS text, person FROM x WHERE value > 150)
SELECT r.video, r.text, r.rank, coalesce(string_agg(DISTINCT person::VARCHAR, ',' ORDER BY person::VARCHAR), '') AS persons FROM r LEFT JOIN b ON b.video = r.video AND (b.text = r.text OR (b.text = 'error' AND r.text = 'view')) WHERE rank <= 3 GROUP BY ALL"""
)
def texts_with_people(spark, d):
    x = people(spark, d)
    r = x.groupBy("video", c("label").alias("text")).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("video").orderBy(c("n").desc(), "text")))
    r = r.withColumn("variants", F.when(c("text") == "view", F.array("text", F.lit("error"))).otherwise(F.array("text")))
    found = P.texts_with_people(r, x.where("value > 150").select("video", c("label").alias("text"), "person").distinct(), ["video"], 3)
    return found.select("video", "text", "rank", F.array_join(F.array_sort(F.transform("persons", lambda p: p.cast("string"))), ",").alias("persons"))


@query(f"{WITH}, b AS (SELECT video, count(DISTINCT segment) AS n FROM e GROUP BY 1) SELECT video, CASE WHEN video % 3 = 1 THEN 'about ' || video END AS caption, CASE WHEN video % 3 = 0 THEN 'none' WHEN video % 3 = 2 THEN 'segments changed' END AS gap FROM b")
def matching_captions(spark, d):
    s = events(spark, d).groupBy("video", "segment").agg(F.min("frame").alias("start"), F.max("frame").alias("end"))
    items = s.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("bounds"))
    old = F.when(c("video") % 3 == 2, F.transform("bounds", lambda b: F.struct(b["start"].alias("start"), (b["end"] + 1).alias("end")))).otherwise(c("bounds"))
    captions = items.where("video % 3 <> 0").select("video", F.concat(F.lit("about "), c("video")).alias("caption"), old.alias("bounds"))
    return P.matching_captions(items, captions, "video")


@query(f"{WITH}, s AS (SELECT video, 'day ' || (segment % 3) AS line, label, sum(value) AS w FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY video, line ORDER BY round(w, 9) DESC, label) AS r FROM s), l AS (SELECT video, line, string_agg(label, ', ' ORDER BY r) AS ls FROM r WHERE r <= 3 GROUP BY ALL) SELECT video, string_agg(line || ': ' || ls, chr(10) ORDER BY line) AS hints FROM l GROUP BY 1")
def caption_hints(spark, d):
    e = events(spark, d).withColumn("line", F.concat(F.lit("day "), c("segment") % 3))
    return P.hints(e, "video", "line", "label", "value", 3)


DOT = "list_dot_product(u, m.v)"
UNIT = "WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings), n0 AS (SELECT label, i, avg(u[i]) AS x FROM u, range(1, 65) r(i) WHERE i <= len(u) GROUP BY ALL), n1 AS (SELECT label, list(x ORDER BY i) AS v FROM n0 GROUP BY 1), m AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM n1)"


@query(f"{UNIT} SELECT u.label, vec_id FROM u JOIN m USING (label) QUALIFY row_number() OVER (PARTITION BY u.label ORDER BY round({DOT}, 9) DESC, vec_id) = 1")
def typical_row(spark, d):
    return P.typical_row(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query(f"{UNIT}, p AS (SELECT vec_id AS number, u FROM u WHERE vec_id < 5) SELECT m.label, number FROM m, p QUALIFY row_number() OVER (PARTITION BY m.label ORDER BY round({DOT}, 9) DESC, number) = 1")
def nearest_prototype(spark, d):
    v = table(spark, d, "embeddings")
    return P.nearest_prototype(v, ["label"], "embedding", v.where("vec_id < 5").select(c("vec_id").alias("number"), c("embedding").alias("prototype")))


@query("WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) AS chance FROM n", "chance")
def chance_share(spark, d):
    return P.chance_share(table(spark, d, "documents"), "lang")
