"""Queries of camera motion, tracking and cuts, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cuts as U, motion as Y
from .adapters import events
from .catalogue import WITH, query

c = F.col


# ---------------------------------------------------------------- cameras

CAM = f"""{WITH}, s AS (SELECT video, CASE WHEN label <> 'error' THEN (value - 50) / (20000 * (1 + video % 4 * 10)) + CASE WHEN video % 3 = 0 THEN (video % 7 - 3) / 5000 ELSE 0 END END AS tx,
  CASE WHEN label <> 'error' THEN (k - 50) / (20000 * (1 + video % 4 * 10)) + CASE WHEN video % 3 = 1 THEN (video % 7 - 3) / 5000 ELSE 0 END END AS ty,
  CASE WHEN label <> 'error' THEN (event_id % 17 - 8) / 200000 + CASE WHEN video % 3 = 2 THEN (video % 7 - 3) / 5000 ELSE 0 END END AS scale, (k - 50) / 1000 AS roll FROM e),
a AS (SELECT video, count(*) AS n, sum(tx) * 24 / count(*) AS pan, sum(ty) * 24 / count(*) AS tilt, sum(scale) * 24 / count(*) AS zoom, sum(roll) * 24 / count(*) AS roll, 1.4826 * (mad(tx) + mad(ty)) * sqrt(24) AS jitter,
  abs(avg(tx)) AS mx, abs(avg(ty)) AS my, abs(avg(scale)) AS mz, stddev_pop(tx) AS sx, stddev_pop(ty) AS sy, stddev_pop(scale) AS sz FROM s WHERE tx IS NOT NULL GROUP BY 1),
m AS (SELECT *, CASE WHEN greatest(abs(pan), abs(tilt), abs(zoom)) < 0.00923 THEN 'none' WHEN abs(zoom) >= greatest(abs(pan), abs(tilt)) THEN 'zoom' WHEN abs(pan) >= abs(tilt) THEN 'pan' ELSE 'tilt' END AS move,
  CASE WHEN jitter > 0.00309 THEN 'handheld' ELSE 'steady' END AS rig FROM a WHERE n >= 2),
w AS (SELECT *, CASE move WHEN 'pan' THEN sx = 0 OR mx / sx >= 0.605 WHEN 'tilt' THEN sy = 0 OR my / sy >= 0.605 WHEN 'zoom' THEN sz = 0 OR mz / sz >= 0.605 ELSE false END AS named FROM m),
cam AS (SELECT v.video, coalesce(a.n, 0)::BIGINT AS n, w.pan, w.tilt, w.zoom, w.roll, w.jitter, rig, move,
  CASE move WHEN 'zoom' THEN CASE WHEN w.zoom > 0 THEN 'in' ELSE 'out' END WHEN 'pan' THEN CASE WHEN w.pan < 0 THEN 'right' ELSE 'left' END WHEN 'tilt' THEN CASE WHEN w.tilt < 0 THEN 'down' ELSE 'up' END END AS direction,
  CASE WHEN w.video IS NULL THEN 'unknown' WHEN rig = 'handheld' AND NOT named THEN 'handheld' WHEN move = 'none' THEN 'static' ELSE move END AS movement,
  -greatest(abs(w.pan) / 0.00923, abs(w.tilt) / 0.00923, abs(w.zoom) / 0.00923, w.jitter / 0.00309) AS static
  FROM (SELECT DISTINCT video FROM e) v LEFT JOIN a USING (video) LEFT JOIN w USING (video))"""


def cameras(spark, d):
    x = 20000 * (1 + c("video") % 4 * 10)
    step = lambda value, third: F.when(c("label") != "error", value + F.when(c("video") % 3 == third, (c("video") % 7 - 3) / 5000).otherwise(0))
    steps = events(spark, d).select("video", step((c("value") - 50) / x, 0).alias("tx"), step((c("k") - 50) / x, 1).alias("ty"), step((c("event_id") % 17 - 8) / 200000, 2).alias("scale"), ((c("k") - 50) / 1000).alias("roll"))
    return Y.camera(steps, ["video"], 24.0, roll="roll")


@query(f"{CAM} SELECT * FROM cam", "pan tilt zoom roll jitter static")
def camera_moves(spark, d):
    return cameras(spark, d)


@query(f"{CAM}, h AS (SELECT video, CASE WHEN video % 5 > 0 THEN static END AS static, CASE WHEN video % 7 > 0 THEN jitter END AS jitter FROM cam) SELECT video, coalesce(static, (SELECT median(static) FROM h)) AS static, coalesce(jitter, (SELECT median(jitter) FROM h)) AS jitter FROM h", "static jitter")
def camera_scores(spark, d):
    return Y.at_median(cameras(spark, d).select("video", F.when(c("video") % 5 > 0, c("static")).alias("static"), F.when(c("video") % 7 > 0, c("jitter")).alias("jitter")), ["static", "jitter"])


@query(f"{CAM} SELECT video % 5 AS level, count(*) AS items, avg((rig = 'handheld')::INT) AS handheld FROM cam WHERE rig IS NOT NULL AND video % 5 < 4 GROUP BY 1", "handheld")
def shake_levels(spark, d):
    return Y.shake_shares(cameras(spark, d).withColumn("level", F.when(c("video") % 5 < 4, c("video") % 5)), "level", "rig")


@query(
    f"""{CAM}, l AS (SELECT *, video % 4 < 2 AS shaky, CASE WHEN video % 10 < 8 THEN [['pan'], ['tilt'], ['zoom'], ['none'], ['pan', 'zoom']][1 + video % 5] ELSE [] END AS truth, CASE WHEN video % 2 = 0 THEN direction IN ('left', 'up', 'in') END AS good, video % 7 = 3 AS still FROM cam),
j AS (SELECT *, len(truth) = 1 AND move IS NOT NULL AS one, len(truth) = 1 AND truth[1] = move AS named FROM l)
SELECT count(*) FILTER (rig IS NOT NULL) AS rigs, avg(shaky::INT) FILTER (rig = 'handheld') AS handheld_precision, avg((rig = 'handheld')::INT) FILTER (shaky AND rig IS NOT NULL) AS handheld_recall, count(*) FILTER (len(truth) = 1) AS moves, count(*) FILTER (one) AS answered,
avg(named::INT) FILTER (one) AS move_accuracy, count(*) FILTER (named AND move <> 'none' AND good IS NOT NULL) AS directions, avg(good::INT) FILTER (named AND move <> 'none') AS direction_accuracy,
count(*) AS stills, avg(still::INT) FILTER (movement = 'static') AS static_precision, avg((movement = 'static')::INT) FILTER (still) AS static_recall FROM j""",
    "handheld_precision handheld_recall move_accuracy direction_accuracy static_precision static_recall",
)
def camera_decisions(spark, d):
    labels = F.array(*[F.array(*map(F.lit, x)) for x in (["pan"], ["tilt"], ["zoom"], ["none"], ["pan", "zoom"])])
    truth = F.when(c("video") % 10 < 8, F.get(labels, (c("video") % 5).cast("int"))).otherwise(F.array().cast("array<string>"))
    good = F.when(c("video") % 2 == 0, c("direction").isin("left", "up", "in"))
    return Y.decisions(cameras(spark, d), [], c("video") % 4 < 2, c("rig"), truth, c("move"), good, c("video") % 7 == 3, c("movement"))


# ---------------------------------------------------------------- fits

#: Points of each video, moved by a similarity of its own about the frame's centre; those of two labels, 40 % of all, go elsewhere, half of them on people.
@query(f"{WITH} SELECT DISTINCT video, (video % 11 - 5) * 2 / 640 AS tx, (video % 3 - 1) * 4 / 640 AS ty, ln(1 + (video % 7 - 3) / 100) AS scale, (video % 5 - 2) / 50 AS roll, 1 AS source FROM e", "tx ty scale roll")
def fitted_motions(spark, d):
    e = events(spark, d)
    x, y = F.pmod(c("value") * 7.3, F.lit(640.0)), F.pmod(c("k") * 4.8 + c("event_id") % 13, F.lit(480.0))
    size, turn = 1 + (c("video") % 7 - 3) / 100, (c("video") % 5 - 2) / 50
    u, v = x - 320, y - 240
    x1 = 320 + size * (F.cos(turn) * u - F.sin(turn) * v) + (c("video") % 11 - 5) * 2
    y1 = 240 + size * (F.sin(turn) * u + F.cos(turn) * v) + (c("video") % 3 - 1) * 4
    away = c("label").isin("error", "signup")
    point = F.struct(x.alias("x0"), y.alias("y0"), (x1 + F.when(away, 50 + c("k") * 3).otherwise(0)).alias("x1"), (y1 - F.when(away, 40 + c("value")).otherwise(0)).alias("y1"), (c("label") == "signup").alias("person"))
    pairs = e.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("event_id", point.alias("p")))).alias("points")).select("video", F.transform("points", lambda p: p["p"]).alias("points"))
    return Y.fitted_motions(pairs, "points", 640.0, 480.0).select("video", "motion.*")


# ---------------------------------------------------------------- tracking


@query()
def two_stage_tracks(spark, d):
    e = events(spark, d)
    at = c("k") * 8.0
    boxes = e.select("video", c("event_id").alias("id"), F.floor(c("frame") / 7200).alias("frame"), F.least(c("value") / 100, F.lit(1.0)).alias("score"), at.alias("x1"), (at * 0).alias("y1"), (at + 200).alias("x2"), (at * 0 + 300).alias("y2"))
    return Y.two_stage_tracks(boxes, ["video"], high=0.4, low=0.05, new=0.4)


# ---------------------------------------------------------------- cuts

SPANS = f"""{WITH}, t AS (SELECT video, segment, min(frame) AS "start", max(frame) AS "end" FROM e GROUP BY ALL), n AS (SELECT *, lead("start") OVER w AS follows, row_number() OVER w AS place FROM t WINDOW w AS (PARTITION BY video ORDER BY "start")),
cut AS (SELECT video, "start" AS at FROM n WHERE place > 1 UNION ALL SELECT video, "end" + 1 FROM n WHERE follows - "end" > 1),
f AS (SELECT DISTINCT video, frame + k // 10 * 600 AS at FROM e WHERE label <> 'view'),
hull AS (SELECT video, min("start") AS first, max("end") AS last FROM t GROUP BY 1),
kept AS (SELECT f.video, f.at FROM f JOIN hull h ON h.video = f.video AND f.at > h.first AND f.at <= h.last WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.video = f.video AND follows - "end" > 1 AND f.at > "end" + 1 + 900 AND f.at < follows - 900))"""


def _spans(spark, d):
    e = events(spark, d)
    truth = e.groupBy("video", "segment").agg(F.min("frame").alias("start"), F.max("frame").alias("end"))
    return truth, e.where("label <> 'view'").select("video", (c("frame") + F.floor(c("k") / 10) * 600).alias("at")).distinct()


@query(f"{SPANS} SELECT * FROM kept")
def cuts_outside_gaps(spark, d):
    truth, found = _spans(spark, d)
    return U.outside_gaps(truth, found, "video", "at", 900)


@query(
    f"""{SPANS.replace('WITH ', 'WITH RECURSIVE ', 1)}, o AS (SELECT h.video, coalesce(list(c.at ORDER BY c.at) FILTER (c.at IS NOT NULL), []) AS cuts FROM hull h LEFT JOIN cut c USING (video) GROUP BY 1), fr AS (SELECT h.video, coalesce(list(k.at ORDER BY k.at) FILTER (k.at IS NOT NULL), []) AS free FROM hull h LEFT JOIN kept k USING (video) GROUP BY 1),
g AS (SELECT video, cuts, 0 AS i, free, NULL::BIGINT AS took, 0 AS hits FROM o JOIN fr USING (video)
  UNION ALL SELECT video, cuts, i + 1, list_filter(free, lambda x: took2 IS NULL OR x <> took2), took2, hits + (took2 IS NOT NULL)::INT FROM (SELECT *, list_sort(list_transform(list_filter(free, lambda x: abs(x - cuts[i + 1]) <= 900), lambda x: {{'d': abs(x - cuts[i + 1]), 'x': x}}))[1].x AS took2 FROM g WHERE i < len(cuts)))
SELECT video, len(cuts) AS truth, (SELECT count(*) FROM kept k WHERE k.video = g.video) AS found, hits::BIGINT AS hits FROM g WHERE i = len(cuts)"""
)
def gap_aware_cuts(spark, d):
    truth, found = _spans(spark, d)
    return U.gap_aware_matches(truth, found, "video", "at", 900)
