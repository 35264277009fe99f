"""Queries of segment records, picks, label maps and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chance import uniform_sql
from ..operators import episodes as P
from .adapters import events
from .catalogue import WITH, poisson_sql, query

c = F.col

SHOTS = f"""{WITH}, s AS (SELECT video, segment, min(frame) AS a, max(frame) - CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS b FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY a, b) - 1 AS idx FROM s WHERE b >= a)"""


def _segments(spark, d):
    e = events(spark, d)
    shots = e.groupBy("video", "segment").agg(F.min("frame").alias("start"), (F.max("frame") - F.when(F.count(F.lit(1)) == 1, 1).otherwise(0)).alias("end")).drop("segment")
    labels = e.groupBy("video", "segment").agg(F.min("label").alias("intra"), F.max("label").alias("inter")).where("segment < 9").withColumn("index", c("segment").cast("int")).drop("segment")
    return P.segment_records(shots, e.select("video", "frame", c("value").alias("sharpness")), "video", F.lit(24.0) + c("video") % 3, labels)


@query(
    f"""{SHOTS}, n AS (SELECT video, count(*) AS shot_count FROM k GROUP BY 1), f AS (SELECT k.video, count(*) AS keyframe_count FROM k JOIN e ON e.video = k.video AND e.frame BETWEEN k.a AND k.b GROUP BY 1), dr AS (SELECT video, nullif(count(*) FILTER (b < a), 0) AS dropped FROM s GROUP BY 1)
SELECT video, coalesce(shot_count, 0)::INT AS shot_count, coalesce(keyframe_count, 0)::INT AS keyframe_count, dropped AS dropped_ranges, 24.0 + video % 3 AS fps FROM dr LEFT JOIN n USING (video) LEFT JOIN f USING (video)"""
)
def segment_counts(spark, d):
    return _segments(spark, d).drop("shots")


@query(
    f"""{SHOTS}, l AS (SELECT video, segment AS idx, min(label) AS intra, max(label) AS inter FROM e WHERE segment < 9 GROUP BY ALL), f AS (SELECT k.video, k.idx, count(*) AS n, min(e.frame) AS first FROM k JOIN e ON e.video = k.video AND e.frame BETWEEN k.a AND k.b GROUP BY ALL)
SELECT k.video, k.idx::INT AS "index", a AS start_frame, b AS end_frame, round(a / (24.0::DOUBLE + k.video % 3), 3) AS start_time, round((b + 1) / (24.0::DOUBLE + k.video % 3), 3) AS end_time, intra AS intra_label, inter AS inter_label, coalesce(n, 0)::INT AS frames, first FROM k LEFT JOIN l ON l.video = k.video AND l.idx = k.idx LEFT JOIN f ON f.video = k.video AND f.idx = k.idx"""
)
def segment_times(spark, d):
    s = _segments(spark, d).select("video", F.explode("shots").alias("s"))
    return s.select("video", *[c(f"s.{x}") for x in ("index", "start_frame", "end_frame", "start_time", "end_time", "intra_label", "inter_label")], F.size("s.keyframes").alias("frames"), F.array_min(F.transform("s.keyframes", lambda k: k["frame"])).alias("first"))


@query(f"{WITH}, t AS (SELECT DISTINCT video, k // 10 AS person, segment, k % 4 AS track FROM e WHERE label <> 'error') SELECT video, person::INT AS person, string_agg(segment || ':' || track, ',' ORDER BY segment, track) AS tracks FROM t GROUP BY ALL")
def person_tracks(spark, d):
    e = events(spark, d).withColumns({"person": F.when(c("label") != "error", (c("k") / 10).cast("int")), "track": c("k") % 4})
    found = P.person_tracks(e, "video", "person", "segment", "track")
    return found.select("video", "person", F.array_join(F.transform("tracks", lambda t: F.concat_ws(":", t["segment"], t["track"])), ",").alias("tracks"))


@query(
    f"""{WITH}, o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame, event_id) - 1 AS pos, count(*) OVER (PARTITION BY video) AS n FROM e), p AS (SELECT * FROM o WHERE list_contains(list_transform(range(0, least(n, 5)), lambda i: round_even(i * (n - 1) / greatest(least(n, 5) - 1, 1), 0)::BIGINT), pos))
SELECT video, arg_min(480 + video, (frame, event_id)) / least(arg_min(480 + video, (frame, event_id)), arg_min(300 + k * 9, (frame, event_id))) AS tall, quantile_cont(value, 0.5) AS bars FROM p GROUP BY 1""",
    "tall bars",
)
def item_shapes(spark, d):
    e = events(spark, d).withColumns({"width": 300 + c("k") * 9, "height": 480 + c("video")})
    return P.item_shape(P.even_picks(e, "video", ["frame", "event_id"], 5), "video", "value", "width", "height", ["frame", "event_id"])


@query(f"{WITH}, g AS (SELECT video, min(frame) AS f, arg_min(k, (frame, event_id)) AS k FROM e GROUP BY 1) SELECT video, CASE WHEN video % 3 > 0 THEN 1280 ELSE 300 + k * 9 END AS width FROM g")
def frame_sizes(spark, d):
    g = events(spark, d).groupBy("video").agg(F.min_by("k", F.struct("frame", "event_id")).alias("k"))
    size = P.frame_size(F.when(c("video") % 3 > 0, F.struct(F.lit(1280).alias("width"))), F.struct((300 + c("k") * 9).alias("width")))
    return g.select("video", size["width"].alias("width"))


@query(f"{WITH}, n AS (SELECT video, segment, k % 5 AS id, count(*) AS n FROM e GROUP BY ALL) SELECT video || '-' || segment AS item, CASE WHEN id < 4 THEN 'class ' || id END AS name, n / sum(n) OVER (PARTITION BY video, segment) AS share FROM n", "share")
def map_shares(spark, d):
    """A day's events as the pixels of a map of five classes, one of them without a name."""
    maps = events(spark, d).groupBy(F.concat_ws("-", "video", "segment").alias("item")).agg(F.collect_list(c("k") % 5).alias("pixels"))
    names = spark.range(4).select(c("id").cast("int").alias("id"), F.concat(F.lit("class "), "id").alias("name"))
    return P.map_shares(maps, "item", "pixels", names)


@query(
    f"""{WITH}, p AS (SELECT event_id, greatest(8, round_even((k * 40 + 5) * 32 / (20 + event_id % 30), 0)::INT) AS wide FROM e), n AS (SELECT *, greatest(1, round_even(wide / 100, 0)::INT) AS n FROM p), x AS (SELECT event_id, list_filter(list_transform(range(0, n), lambda i: [round_even(i * wide / n, 0)::INT, round_even((i + 1) * wide / n, 0)::INT]), lambda y: y[2] - y[1] >= 8) AS xs FROM n) SELECT event_id, len(xs)::INT AS parts, xs[1][2] AS first_end, xs[-1][2] AS last_end FROM x"""
)
def reading_chunks(spark, d):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = events(spark, d).select("event_id", "k").repartition(parts, "event_id")  # a file of narrow rows is few tasks, and a row is much work
    x = e.withColumn("xs", P.reading_chunks(c("k") * 40 + 5, 20 + c("event_id") % 30))
    return x.select("event_id", F.size("xs").alias("parts"), c("xs")[0]["end"].alias("first_end"), F.element_at("xs", -1)["end"].alias("last_end"))


@query(f"{WITH}, l AS (SELECT video, segment, list(label || CASE WHEN k < 50 THEN ' ' ELSE '' END ORDER BY event_id) AS parts, list(label ORDER BY event_id) AS labels FROM e GROUP BY ALL) SELECT video, segment, array_to_string(list_filter(list_transform(parts, lambda x: trim(CASE WHEN trim(x) = 'error' THEN ' ' ELSE x END)), lambda x: x <> ''), ' ') AS text, len(list_filter(labels, lambda x: x <> 'view'))::INT AS kept FROM l")
def joined_readings(spark, d):
    e = events(spark, d).withColumn("part", F.when(c("label") == "error", " ").otherwise(F.concat("label", F.when(c("k") < 50, " ").otherwise(""))))
    g = e.groupBy("video", "segment").agg(F.array_sort(F.collect_list(F.struct("event_id", "part", "label"))).alias("x"))
    return g.select("video", "segment", P.joined_readings(c("x.part")).alias("text"), F.size(P.labels_but(c("x.label"), "view")).alias("kept"))


@query(f"{WITH} SELECT count(*) AS n, sum(value) AS total FROM e", "total")
def joined_groups(spark, d):
    arrays = events(spark, d).groupBy("video").agg(F.collect_list("value").alias("values"))
    return P.joined_groups(arrays, "values").agg(F.count(F.lit(1)).alias("n"), F.sum("values").alias("total"))


@query(
    f"""{WITH}, s AS (SELECT video % 7 AS series, video AS episode, label AS metric, avg(value) AS value FROM e GROUP BY ALL), w AS (SELECT metric, avg(m) AS average, count(*) AS series FROM (SELECT metric, series, avg(value) AS m FROM s GROUP BY ALL) GROUP BY 1),
dr AS (SELECT s.*, draw, {poisson_sql(uniform_sql(0, 'draw', 'episode'))} AS w FROM s, range(1, 101) r(draw)), ms AS (SELECT metric, draw, avg(m) AS m FROM (SELECT metric, series, draw, sum(value * w) / sum(w) AS m FROM dr WHERE w > 0 GROUP BY ALL) GROUP BY ALL)
SELECT metric, average, low, high, series FROM w JOIN (SELECT metric, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM ms GROUP BY 1) USING (metric)""",
    "average low high",
)
def series_report(spark, d):
    s = events(spark, d).groupBy((c("video") % 7).alias("series"), c("video").alias("episode"), c("label").alias("metric")).agg(F.avg("value").alias("value"))
    return P.series_report(s, "series", "episode", "metric", "value", 100)
