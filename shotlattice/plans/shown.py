"""Queries of what a record shows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shown as S
from .adapters import events
from .catalogue import WITH, query

c = F.col


@query(
    f"""{WITH}, p AS (SELECT event_id, k * 8 - 100 AS x1, 50 AS y1, k * 8 + 200 AS x2, 400 AS y2, (event_id % 11) / 10 AS v, value / 100 AS px FROM e), b AS (SELECT *, greatest(0, x1) AS bx, least(640, x2) - greatest(0, x1) AS w FROM p),
s AS (SELECT *, bx + px * w >= 0 AND bx + px * w < 640 AS first_in, bx + (1 - px) * w >= 0 AND bx + (1 - px) * w < 640 AS second_in FROM b)
SELECT event_id, round(greatest(0, CASE WHEN first_in THEN v ELSE 0 END), 3) AS head, round(greatest(0, CASE WHEN second_in THEN 1.0 - v ELSE 0 END), 3) AS shoulders, round(greatest(0, CASE WHEN first_in THEN v ELSE 0 END, CASE WHEN second_in THEN 1.0 - v ELSE 0 END), 3) AS both, 0.0::DOUBLE AS feet FROM s"""
)
def body_parts(spark, d):
    v = c("event_id") % 11 / 10
    at = lambda x, v: F.struct(x.alias("x"), F.lit(0.5).alias("y"), v.alias("v"))
    box = F.struct((c("k") * 8 - 100).alias("x1"), F.lit(50).alias("y1"), (c("k") * 8 + 200).alias("x2"), F.lit(400).alias("y2"))
    found = S.parts_seen(F.array(at(c("value") / 100, v), at(1 - c("value") / 100, 1 - v)), box, F.lit(640), F.lit(480), ((0,), (1,), (0, 1), (7,)))
    return events(spark, d).withColumn("seen", found).select("event_id", *[c("seen")[i].alias(n) for i, n in enumerate(("head", "shoulders", "both", "feet"))])


@query(
    f"""{WITH}, g AS (SELECT video, count(*) FILTER (label = 'view') AS v, count(*) FILTER (label = 'click') AS cl, count(*) FILTER (label = 'error') AS er, count(*) FILTER (label = 'signup') AS sg, count(*) FILTER (label = 'purchase') AS pu FROM e GROUP BY 1),
l AS (SELECT video, list_sort(list_filter([nullif(v % 3, 0), nullif(cl % 4, 0), CASE WHEN er > 12 THEN er END, greatest(sg, pu), CASE WHEN sg % 2 = 0 THEN sg END], lambda x: x IS NOT NULL)) AS n FROM g)
SELECT video, array_to_string(n, ',') AS counts FROM l"""
)
def sample_counts(spark, d):
    n = lambda x: F.count_if(c("label") == x)
    g = events(spark, d).groupBy("video").agg(*[n(x).alias(x) for x in ("view", "click", "error", "signup", "purchase")])
    counts = S.sample_counts([F.nullif(c("view") % 3, F.lit(0)), F.nullif(c("click") % 4, F.lit(0))], F.array(F.struct(c("signup").alias("n")), F.struct(c("purchase").alias("n"))), F.when(c("error") > 12, c("error")), F.when(c("signup") % 2 == 0, c("signup")))
    return g.select("video", F.array_join(F.array_sort(counts), ",").alias("counts"))


@query(
    f"""{WITH}, g AS (SELECT video, count(*) AS n, count(*) FILTER (label = 'view') AS m, avg(value) FILTER (label = 'view') AS mean FROM e WHERE label <> 'error' GROUP BY 1) SELECT video, CASE WHEN video % 4 > 0 THEN m / n END AS share, CASE WHEN video % 4 > 0 AND m > 10 THEN mean END AS mean, CASE WHEN video % 4 > 0 THEN n END AS n FROM g""",
    "share mean",
)
def shown_gaze(spark, d):
    n, m = F.count(F.lit(1)), F.count_if(c("label") == "view")
    g = events(spark, d).where("label <> 'error'").groupBy("video").agg(n.alias("n"), m.alias("m"), F.avg(F.when(c("label") == "view", c("value"))).alias("mean"))
    none = F.lit(None).cast("double")
    found = F.when(c("video") % 4 > 0, F.struct((c("m") / c("n")).alias("in_frame_share"), F.struct(c("mean"), none.alias("sd"), none.alias("median"), F.greatest(c("m") - 10, F.lit(0)).alias("n")).alias("in_frame"), c("n").alias("n")))
    return g.withColumn("gaze", S.gaze(found)).select("video", c("gaze.in_frame_share").alias("share"), c("gaze.in_frame.mean").alias("mean"), c("gaze.n").alias("n"))


@query(f"""{WITH} SELECT video, event_id, frame AS start, frame + 60 AS "end", CASE WHEN k < 60 THEN label WHEN segment % 2 = 0 THEN 'view' END AS size FROM e""")
def keyframe_sizes(spark, d):
    e = events(spark, d).withColumns({"start": c("frame"), "end": c("frame") + 60, "other": c("value")})
    e = e.withColumn("size", S.keyframe_size(F.when(c("k") < 60, c("label")), F.when(c("segment") % 2 == 0, F.lit("view"))))
    s = e.groupBy("video", "segment").agg(F.array_sort(F.collect_list(F.struct("event_id", "start", "end", "size", "other"))).alias("keyframes"))
    return s.select("video", F.explode(S.keyframe_fields(c("keyframes"), ["size", "event_id"])).alias("r")).select("video", "r.*")


@query(f"{WITH} SELECT video, CASE WHEN value * 2 < 60 THEN 'under 60 px' WHEN value * 2 < 120 THEN '60-120 px' WHEN value * 2 < 240 THEN '120-240 px' ELSE '240 px and up' END AS size, count(*)::BIGINT AS n FROM e GROUP BY ALL")
def head_sizes(spark, d):
    return events(spark, d).groupBy("video", S.head_size(c("k"), c("k") + c("value") * 2).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT event_id, 'person' AS kind, value / 97.3::DOUBLE AS score FROM e WHERE label = 'view' UNION ALL SELECT event_id, 'object', round(value / 97.3::DOUBLE, 3) FROM e WHERE label <> 'view' AND value / 97.3::DOUBLE >= 0.25", "score")
def detections_split(spark, d):
    e = events(spark, d).select("event_id", "label", (c("value") / 97.3).alias("score"))
    persons, objects = S.split_detections(e, c("label") == "view", "score")
    return persons.select("event_id", F.lit("person").alias("kind"), "score").unionByName(objects.select("event_id", F.lit("object").alias("kind"), "score"))


@query(f"{WITH} SELECT event_id, CASE WHEN label <> 'error' THEN round(sqrt(value), 4) END AS d FROM e")
def rounded_matrix(spark, d):
    return events(spark, d).select("event_id", S.rounded(F.when(c("label") == "error", F.lit(float("nan"))).otherwise(F.sqrt("value"))).alias("d"))


@query(
    f"""{WITH}, m AS (SELECT DISTINCT video, segment FROM e WHERE label <> 'error'), a AS (SELECT video, segment, avg(k / 100) AS outdoor FROM e WHERE label = 'view' GROUP BY ALL), b AS (SELECT video, segment, max(value) AS height FROM e WHERE label = 'click' GROUP BY ALL), an AS (SELECT DISTINCT video, segment FROM e WHERE label = 'signup')
SELECT m.video, m.segment, outdoor, height, (an.video IS NOT NULL)::INT::DOUBLE AS animal FROM m LEFT JOIN a USING (video, segment) LEFT JOIN b USING (video, segment) LEFT JOIN an ON an.video = m.video AND an.segment = m.segment""",
    "outdoor height",
)
def labelled_values(spark, d):
    e = events(spark, d)
    outdoor = e.where("label = 'view'").groupBy("video", "segment").agg(F.avg(c("k") / 100).alias("o"))
    height = e.where("label = 'click'").groupBy("video", "segment").agg(F.max("value").alias("h"))
    matched = e.where("label <> 'error'").select("video", "segment").distinct()
    return S.labelled_values(matched, "video", "segment", {"figurative": (outdoor, {"outdoor": c("o")}), "enunciative": (height, {"height": c("h")})}, {"animal": e.where("label = 'signup'")})


HINTS = f"""{WITH}, s AS (SELECT video, segment, count(*) * 1.5 AS seconds, count(*) FILTER (label = 'purchase') AS most FROM e GROUP BY ALL), wh AS (SELECT video, sum(seconds) AS duration, max(most) AS most, sum(CASE WHEN most > 0 THEN seconds ELSE 0 END) AS peopled FROM s GROUP BY 1),
lb AS (SELECT video, 'tags' AS line, 'tag ' || (k % 8) AS label, count(*)::DOUBLE AS w FROM e GROUP BY ALL UNION ALL SELECT video, 'regions', label, sum(value) FROM e GROUP BY ALL UNION ALL SELECT video, 'objects', 'thing ' || (k % 5), count(*) FROM e WHERE label = 'error' GROUP BY ALL
  UNION ALL SELECT video, 'animals', 'animal ' || (k % 3), count(*) FROM e WHERE label = 'signup' AND video % 2 = 0 GROUP BY ALL UNION ALL SELECT video, 'medium', 'medium ' || (k % 4), sum(value) FROM e GROUP BY ALL UNION ALL SELECT video, 'moves', label, count(*) FROM e WHERE label NOT IN ('view', 'error') GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY video, line ORDER BY round(w, 9) DESC, label) AS r FROM lb), ls AS (SELECT video, line, string_agg(label, ', ' ORDER BY r) AS t FROM rk WHERE r <= CASE WHEN line = 'medium' THEN 1 ELSE 5 END GROUP BY ALL), pv AS (SELECT video, {', '.join(f"max(t) FILTER (line = '{x}') AS {x}" for x in ('tags', 'regions', 'objects', 'animals', 'medium', 'moves'))} FROM ls GROUP BY 1),
g AS (SELECT video, k // 25 AS pair, segment, count(*) FILTER (label = 'view') AS va, count(*) FILTER (label = 'click') AS vb, count(*) AS n FROM e GROUP BY ALL), bs AS (SELECT video, pair, coalesce(max(va / n) FILTER (n >= 2), 0) AS ab, coalesce(max(vb / n) FILTER (n >= 2), 0) AS ba FROM g GROUP BY ALL), lk AS (SELECT video, bool_or(least(ab, ba) >= 0.6) AS mutual, bool_or(greatest(ab, ba) >= 0.6) AS one_way FROM bs GROUP BY 1),
ad AS (SELECT video, count(*) FILTER (n >= 2 AND sh >= 0.8) AS addressing FROM (SELECT video, k // 10 AS p, count(*) AS n, avg((label = 'view')::INT) AS sh FROM e GROUP BY ALL) GROUP BY 1)"""


@query(
    f"""{HINTS} SELECT video, 'Medium: ' || coalesce(medium, 'unknown') || chr(10) || 'Scene tags: ' || coalesce(tags, 'none') || chr(10) || 'Main regions: ' || coalesce(regions, 'none') || chr(10) || 'Objects detected: ' || coalesce(objects, 'none') || chr(10) || 'Animals: ' || coalesce(animals, 'none') || chr(10) || 'People: ' ||
CASE WHEN most = 0 THEN 'none' ELSE CASE WHEN most > 1 THEN 'up to ' || most || ' visible at once' ELSE 'one at a time' END || ', on screen for ' || CASE WHEN peopled >= duration / 2 THEN 'most of the video' ELSE 'part of the video' END || CASE WHEN mutual THEN '; some look at each other' WHEN one_way THEN '; some look at others' ELSE '' END || CASE WHEN addressing = 1 THEN '; one looks into the camera' WHEN addressing > 1 THEN '; some look into the camera' ELSE '' END END
|| chr(10) || 'Camera movement: ' || coalesce(moves, 'unknown') AS hints FROM wh LEFT JOIN pv USING (video) LEFT JOIN lk USING (video) LEFT JOIN ad USING (video)"""
)
def hint_lines(spark, d):
    e = events(spark, d)
    n = F.count(F.lit(1))
    count = lambda label: F.count_if(c("label") == label)
    weigh = lambda df, label, w: df.groupBy("video", label.alias("label")).agg(w.cast("double").alias("w"))
    named = lambda text, by: F.concat(F.lit(text), c("k") % by)
    segments = e.groupBy("video", "segment").agg((n * 1.5).alias("seconds"), count("purchase").alias("most")).withColumn("peopled", c("most") > 0)
    lists = {
        "tags": weigh(e, named("tag ", 8), n), "regions": weigh(e, c("label"), F.sum("value")), "objects": weigh(e.where("label = 'error'"), named("thing ", 5), n), "animals": weigh(e.where("label = 'signup' and video % 2 = 0"), named("animal ", 3), n),
    }
    moves = weigh(e, F.when(c("label") == "view", "unknown").when(c("label") != "error", c("label")), n)
    by = e.groupBy("video", F.floor(c("k") / 25).alias("pair"), "segment").agg(count("view").alias("va"), count("click").alias("vb"), n.alias("n"))
    side = lambda hits: F.collect_list(F.struct("segment", c(hits).alias("hits"), "n"))
    looking = S.looks(by.groupBy("video", "pair").agg(side("va").alias("a_to_b"), side("vb").alias("b_to_a")), "video", 0.6, 2)
    persons = e.groupBy("video", F.floor(c("k") / 10).alias("p")).agg(n.alias("n"), F.avg((c("label") == "view").cast("int")).alias("share"))
    return S.hint_lines(segments, "video", lists, looking, S.addressing(persons, "video", "share", "n", 0.8), moves, weigh(e, named("medium ", 4), F.sum("value")))
