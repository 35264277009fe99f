"""Queries of the record readers: events become one nested record a user; SQL reads the same from the flat rows.

A day is a segment, an event a keyframe, the tens of k a person, so every list has some and none of its parts. The SQL knows nothing of records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import bands as B
from ..operators import kits as K
from .adapters import events
from .catalogue import WITH, query

c = F.col
BRACKETS = [str(i) for i in range(7)]


def records(spark, d) -> DataFrame:
    """One row a user: video, tall, timeline, plastic, figurative, enunciative, summary."""
    e = events(spark, d).withColumn("person", (c("k") / 10).cast("int"))
    o = ["frame", "event_id"]
    keyframe = F.struct(
        *o, c("frame").alias("start"), (c("frame") + 60).alias("end"), F.when(c("label") != "error", c("value")).alias("brightness"), (c("k") % 9).alias("people"), c("label").alias("camera"), F.when(c("k") < 80, c("label")).alias("shot_size")
    )
    first, last = (F.min_by("label", F.struct(*o)), F.max_by("label", F.struct(*o)))
    s = e.groupBy("video", "segment").agg(
        (F.count(F.lit(1)) * 1.5).alias("seconds"), F.min("frame").alias("start"), (F.max("frame") + 60).alias("end"), F.array_sort(F.collect_set(F.when(c("label") == "purchase", c("person")))).alias("person_ids"),
        F.sort_array(F.collect_list(keyframe)).alias("keyframes"), F.avg("value").alias("brightness"), F.count(F.lit(1)).alias("n"),
        F.avg(F.when(c("label") == "error", c("k").cast("double"))).alias("background"), first.alias("first"), last.alias("last"), F.avg(F.when(c("label") == "click", c("k") / 100)).alias("face"),
        F.sort_array(F.collect_list(F.struct(*o, F.when(c("label") == "view", "person").otherwise("thing").alias("label"), (c("k") / 100).alias("x"), c("value").alias("disparity")))).alias("parts"),
        F.count_if(c("label") == "view").alias("views"), F.count_if(c("label") == "click").alias("clicks"), F.count_if(c("label") == "purchase").alias("bought"),
    )
    share = F.create_map(F.lit(" view "), c("views") / c("n"), F.lit("click"), c("clicks") / c("n"))
    parts = lambda **x: F.struct(*[v.alias(k) for k, v in {"segment": c("segment"), **x}.items()])
    ordered = lambda x: F.sort_array(F.collect_list(x))
    segments = s.groupBy("video").agg(
        ordered(parts(start=c("start"), end=c("end"), seconds=c("seconds"), person_ids=c("person_ids"))).alias("timeline"),
        F.array_sort(F.collect_list(parts(brightness=c("brightness"), coverage=share, centralities=F.when(c("n") > 1, c("parts")), depth=F.when(c("background").isNotNull(), F.struct("background", c("parts").alias("objects"))), keyframes=c("keyframes"))), lambda a, b: (a["segment"] - b["segment"]).cast("int")).alias("plastic"),
        ordered(parts(crowdedness=B.crowd(c("bought")), keyframes=c("keyframes"))).alias("figurative"),
        ordered(
            parts(
                portrait_scene=F.when(c("last") == "view", "portrait").when(c("last") == "click", "landscape"),
                camera_distance=F.when(c("first") != "error", F.struct(c("first").alias("scale"), c("face").alias("face_height"))),
                face_background_ratio=F.when(c("clicks") > 0, c("clicks") - 1),
                keyframes=c("keyframes"),
            )
        ).alias("enunciative"),
        F.sum("seconds").alias("duration_s"),
    )
    p = e.groupBy("video", "person").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("seconds"), F.avg("value").alias("mean"), F.avg(c("k").cast("double")).alias("k"), F.count_if(c("label") == "view").alias("views"), F.count_if(c("label") == "click").alias("clicks"), F.count_if(c("label") == "error").alias("errors"),
    )
    status = F.when(c("n") >= 3, "described").when(c("n") == 1, "withheld")  # two samples: no status
    felt = F.create_map(F.lit("calm"), c("views") / c("n"), F.lit("glad"), c("clicks") / c("n"))
    fig = F.struct(
        c("person").alias("person_id"), status.alias("status"), "seconds",
        F.when(c("errors") == 0, F.struct(((c("person") + 1) / 12).alias("female"), F.when(c("person") > 5, "female").otherwise("male").alias("modal"))).alias("gender"),
        F.when(c("views") + c("clicks") > 0, F.struct(F.when(c("views") >= c("clicks"), "calm").otherwise("glad").alias("modal"), felt.alias("distribution"))).alias("emotion"),
        F.when(c("views") > 0, F.struct(c("mean").alias("mean"))).alias("valence"), F.struct((c("k") / 50).alias("mean")).alias("arousal"),
        F.when(c("clicks") > 0, F.struct(F.create_map((c("person") % 7).cast("string"), F.lit(1.0)).alias("distribution"))).alias("age"),
    )
    enu = F.struct(
        c("person").alias("person_id"), F.when(c("n") > 1, F.struct((c("views") / c("n")).alias("share"), c("n"))).alias("address"), F.struct((c("clicks") / c("n")).alias("in_frame_share"), c("n")).alias("gaze"),
        F.struct(F.struct((c("mean") - 50).alias("mean"), c("errors").alias("n")).alias("yaw")).alias("head_pose"),
    )
    by_id = lambda a, b: (a["person_id"] - b["person_id"]).cast("int")
    persons = p.groupBy("video").agg(F.array_sort(F.collect_list(fig), by_id).alias("fig"), F.array_sort(F.collect_list(enu), by_id).alias("enu"))
    v = e.groupBy("video").agg(
        F.avg("value").alias("brightness"), F.avg(c("k").cast("double")).alias("warmth"), *[F.count_if(c("label") == x).alias(x) for x in ("view", "click", "error", "signup")], *[F.array(*[F.count_if((c("k") % 4 == i) & (c("label") == x)) for i in range(4)]).alias(f"h_{x}") for x in ("view", "click", "error")],
        F.max("k").alias("most"),
    )
    all_ = segments.join(persons, "video").join(v, "video")
    return all_.select(
        "video",
        F.lit(1.5).alias("tall"),
        F.struct(c("timeline").alias("segments")).alias("timeline"),
        F.struct(
            c("plastic").alias("segments"),
            F.struct(
                F.struct(c("brightness").alias("mean")).alias("brightness"), F.when(c("error") > 12, F.struct(c("warmth").alias("mean"))).alias("warmth"),
                F.struct(F.create_map(F.lit("film"), c("view"), F.lit("drawn"), c("click")).alias("distribution")).alias("medium"), F.struct(c("h_view").alias("r"), c("h_click").alias("g"), c("h_error").alias("b")).alias("colour_histogram"),
            ).alias("video"),
        ).alias("plastic"),
        F.struct(
            c("figurative").alias("segments"), c("fig").alias("persons"), F.array(F.struct(F.lit("cat").alias("label"), c("view").cast("double").alias("seconds")), F.struct(F.lit("dog").alias("label"), c("click").cast("double").alias("seconds"))).alias("subjects"),
            F.struct(
                F.array(F.struct(F.lit("sea").alias("label"), (c("view") / 10).alias("share")), F.struct(F.lit("sun").alias("label"), (c("signup") / 10).alias("share"))).alias("tags"), F.when(c("click") > 12, F.filter(F.array(F.struct(F.lit("bar").alias("label"), (c("click") / 20).alias("score"))), lambda x: x["score"] > 0.8)).alias("place"),
                F.when(c("error") > 10, F.struct((c("most") / 100).alias("outdoor"))).alias("indoor_outdoor"),
            ).alias("video"),
        ).alias("figurative"),
        F.struct(c("enunciative").alias("segments"), c("enu").alias("persons"), F.create_map(F.lit("pan"), c("view").cast("double"), F.lit("unknown"), c("error").cast("double"), F.lit("static"), c("click").cast("double")).alias("camera")).alias("enunciative"),
        F.struct(c("duration_s"), F.struct(c("signup").alias("co_present"), F.least("view", "signup").alias("with_evidence")).alias("relations")).alias("summary"),
    )


#: The same from flat rows: segments (s), persons (p), users (v).
FLAT = f"""{WITH}, x AS (SELECT *, k // 10 AS person FROM e),
s AS (SELECT video, segment, count(*) * 1.5 AS seconds, min(frame) AS start, max(frame) + 60 AS "end", count(*) FILTER (label = 'purchase') AS bought, avg(value) AS brightness, count(*) AS n, avg(k) FILTER (label = 'error') AS background,
  arg_min(label, (frame, event_id)) AS first, arg_max(label, (frame, event_id)) AS last, avg(k / 100) FILTER (label = 'click') AS face, count(*) FILTER (label = 'view') AS views, count(*) FILTER (label = 'click') AS clicks FROM x GROUP BY ALL),
pa AS (SELECT video, person, count(*) AS n, sum(value) AS seconds, avg(value) AS mean, avg(k) AS k, count(*) FILTER (label = 'view') AS views, count(*) FILTER (label = 'click') AS clicks, count(*) FILTER (label = 'error') AS errors FROM x GROUP BY ALL),
p AS (SELECT * FROM pa WHERE n >= 2), w AS (SELECT * FROM pa WHERE n >= 3),
v AS (SELECT video, avg(value) AS brightness, avg(k) AS warmth, count(*) FILTER (label = 'view') AS view, count(*) FILTER (label = 'click') AS click, count(*) FILTER (label = 'error') AS error, count(*) FILTER (label = 'signup') AS signup, max(k) AS most FROM x GROUP BY 1),
tm AS (SELECT video, sum(seconds) AS duration FROM s GROUP BY 1)"""
CROWD = "CASE WHEN bought = 0 THEN 'none' WHEN bought = 1 THEN 'single' WHEN bought = 2 THEN 'couple' WHEN bought <= 5 THEN 'group' ELSE 'crowd' END"


def long(kits: DataFrame, named: dict, extra=lambda x: [x.alias("value")]) -> DataFrame:
    """(video, field, value) of readers by name."""
    rows = F.array(*[F.struct(F.lit(n).alias("field"), *extra(v)) for n, v in named.items()])
    return kits.select("video", F.explode(rows).alias("r")).select("video", "r.*")


def numbers(kits):
    return {
        "brightness": K.plastic_mean("brightness"), "warmth": K.plastic_mean("warmth"), "outdoor": K.outdoor(), "people time": K.people_time(), "women": K.women(), "women mean": K.ratio(K.women_time()), "valence": K.affect("valence"), "arousal": K.affect("arousal"), "portrait": K.portrait(), "single": K.single(),
        "address": K.per_sample("address", lambda x: x["share"]), "gaze": K.per_sample("gaze", lambda x: x["in_frame_share"]), "turn": K.per_sample("head_pose", lambda x: F.abs(x["yaw"]["mean"]), lambda x: x["yaw"]["n"]),
        "address of watchers": K.per_sample("address", lambda x: x["share"], who=K.watchers), "gaze of watchers": K.per_sample("gaze", lambda x: x["in_frame_share"], who=K.watchers), "looks": K.looks(), "off centre": K.off_centre(),
    }


NUMBERS_SQL = f"""{FLAT}, f AS (
SELECT video, 'brightness' AS field, brightness AS value FROM v UNION ALL SELECT video, 'warmth', CASE WHEN error > 12 THEN warmth END FROM v UNION ALL SELECT video, 'outdoor', CASE WHEN error > 10 THEN most / 100 END FROM v
UNION ALL SELECT video, 'people time', sum(CASE WHEN bought > 0 THEN seconds ELSE 0 END) / sum(seconds) FROM s GROUP BY 1
UNION ALL SELECT video, 'women', sum(CASE WHEN person > 5 THEN seconds ELSE 0 END) / sum(seconds) FROM p WHERE errors = 0 GROUP BY 1
UNION ALL SELECT video, 'women mean', sum((person + 1) / 12 * seconds) / sum(seconds) FROM w WHERE errors = 0 GROUP BY 1
UNION ALL SELECT video, 'valence', sum(mean * seconds) / sum(seconds) FROM p WHERE views > 0 GROUP BY 1
UNION ALL SELECT video, 'arousal', sum(k / 50 * seconds) / sum(seconds) FROM p GROUP BY 1
UNION ALL SELECT video, 'portrait', sum(CASE WHEN last = 'view' THEN seconds ELSE 0 END) / sum(seconds) FROM s WHERE last IN ('view', 'click') GROUP BY 1
UNION ALL SELECT video, 'single', sum(CASE WHEN bought = 1 THEN seconds ELSE 0 END) / sum(seconds) FROM s WHERE bought > 0 GROUP BY 1
UNION ALL SELECT video, 'address', sum(views) / sum(n) FROM pa WHERE n > 1 GROUP BY 1 UNION ALL SELECT video, 'gaze', sum(clicks) / sum(n) FROM pa GROUP BY 1
UNION ALL SELECT video, 'turn', CASE WHEN sum(errors) > 0 THEN sum(abs(mean - 50) * errors) / sum(errors) END FROM pa GROUP BY 1
UNION ALL SELECT video, 'address of watchers', sum(views) / sum(n) FROM w GROUP BY 1 UNION ALL SELECT video, 'gaze of watchers', sum(clicks) / sum(n) FROM w GROUP BY 1
UNION ALL SELECT video, 'looks', CASE WHEN signup > 0 THEN least(view, signup) / signup END FROM v
UNION ALL SELECT video, 'off centre', avg(abs(x.k / 100 - 0.5)) FROM x JOIN s USING (video, segment) WHERE label = 'view' AND s.n > 1 GROUP BY 1)
SELECT * FROM f WHERE value IS NOT NULL"""


@query(NUMBERS_SQL, "value")
def record_numbers(spark, d):
    k = records(spark, d)
    return long(k, numbers(k)).where("value is not null")


def yaws():
    return K.watcher(lambda p: p["head_pose"]["yaw"]["mean"], lambda p: p["head_pose"]["yaw"]["n"])


@query(
    f"""{FLAT}, y AS (SELECT video, mean - 50 AS y FROM w WHERE errors >= 1), xs AS (SELECT x.video, x.k / 100 AS x FROM x JOIN s USING (video, segment) WHERE label = 'view' AND s.n > 1)
SELECT video, 'yaw' AS field, sum(y) AS sum, count(*)::DOUBLE AS total FROM y GROUP BY 1 UNION ALL SELECT video, 'yaw side', sum((y > 0)::INT)::DOUBLE, count(*) FROM y GROUP BY 1 UNION ALL SELECT video, 'centre', sum(x), count(*) FROM xs GROUP BY 1
UNION ALL SELECT video, 'women', sum((person + 1) / 12 * seconds), sum(seconds) FROM w WHERE errors = 0 GROUP BY 1""",
    "sum total",
)
def record_pooled(spark, d):
    k = records(spark, d)
    once = lambda xs, f=lambda x: x: K.pooled(F.transform(xs, lambda x: K.pair(f(x), F.lit(1))))
    named = {"yaw": once(yaws()), "yaw side": once(yaws(), lambda x: (x > 0).cast("int")), "centre": once(K.things("x")), "women": K.pooled(K.women_time())}
    return long(k, named, lambda x: [x["sum"].alias("sum"), x["total"].alias("total")]).where("total is not null")


def mixes():
    return {
        "medium": K.medium(), "red": K.histogram("r"), "green": K.histogram("g"), "blue": K.histogram("b"), "coverage": K.coverage(), "tags": K.video_set("tags", "share"), "place": K.video_set("place", "score"), "animals": K.animals(), "crowd": K.crowd(), "emotion": K.emotion(), "emotions": K.persons_mix("emotion"),
        "modal emotions": K.modal_emotions(), "scale": K.shot_scale(), "scale seconds": K.time_mix("enunciative", lambda s: s["camera_distance"]["scale"], "signup"), "camera": K.camera(),
    }


MIXES_SQL = f"""{FLAT}, f AS (
SELECT video, 'medium' AS field, unnest(['film', 'drawn']) AS label, unnest([view, click]) / (view + click) AS w FROM v WHERE view + click > 0
UNION ALL SELECT video, CASE label WHEN 'view' THEN 'red' WHEN 'click' THEN 'green' ELSE 'blue' END, i::VARCHAR, count(*) FILTER (k % 4 = i) / count(*) FROM x, range(4) r(i) WHERE label IN ('view', 'click', 'error') GROUP BY video, label, i
UNION ALL SELECT video, 'coverage', unnest(['view', 'click']), unnest([sum(views / n * seconds), sum(clicks / n * seconds)]) / sum(seconds) FROM s GROUP BY 1
UNION ALL SELECT video, 'tags', unnest(['sea', 'sun']), unnest([view / 10, signup / 10]) FROM v UNION ALL SELECT video, 'place', 'bar', click / 20 FROM v WHERE click > 16
UNION ALL SELECT video, 'animals', unnest(['cat', 'dog']), unnest([view, click]) / duration FROM v JOIN tm USING (video)
UNION ALL SELECT video, 'crowd', {CROWD}, sum(seconds) / any_value(duration) FROM s JOIN tm USING (video) GROUP BY 1, 2, 3
UNION ALL SELECT video, 'emotion', unnest(['calm', 'glad']), unnest([sum(views / n * seconds), sum(clicks / n * seconds)]) / sum((views + clicks) / n * seconds) FROM p WHERE views + clicks > 0 GROUP BY 1
UNION ALL SELECT video, 'emotions', unnest(['calm', 'glad']), unnest([sum(views / n), sum(clicks / n)]) FROM w WHERE views + clicks > 0 GROUP BY 1
UNION ALL SELECT video, 'modal emotions', CASE WHEN views >= clicks THEN 'calm' ELSE 'glad' END, count(*) FROM w WHERE views + clicks > 0 GROUP BY 1, 2, 3
UNION ALL SELECT video, 'scale', first, sum(seconds) / sum(sum(seconds)) OVER (PARTITION BY video) FROM s WHERE first <> 'error' GROUP BY 1, 2, 3
UNION ALL SELECT video, 'scale seconds', first, sum(seconds) FROM s WHERE first NOT IN ('error', 'signup') GROUP BY 1, 2, 3
UNION ALL SELECT video, 'camera', unnest(['pan', 'static']), unnest([view, click]) / (view + click) FROM v WHERE view + click > 0)
SELECT * FROM f"""


@query(MIXES_SQL, "w")
def record_mixes(spark, d):
    rows = long(records(spark, d), mixes(), lambda x: [x.cast("map<string,double>").alias("m")])
    return rows.select("video", "field", F.explode("m").alias("label", "w"))


@query(f"{MIXES_SQL} QUALIFY row_number() OVER (PARTITION BY video, field ORDER BY round(w, 9) DESC, label) = 1".replace("SELECT * FROM f QUALIFY", "SELECT video, field, label AS dominant FROM f WHERE w IS NOT NULL QUALIFY"))
def record_dominant(spark, d):
    to_nine = lambda x: F.transform_values(x.cast("map<string,double>"), lambda _, v: F.round(v, 9))
    return long(records(spark, d), mixes(), lambda x: [K.dominant(to_nine(x)).alias("dominant")]).where("dominant is not null")


def lists(k):
    return {
        "brightness": K.each("plastic", lambda s: s["brightness"]), "person seconds": K.person(lambda p: p["seconds"]), "valence": K.person(lambda p: p["valence"]["mean"]), "yaw": yaws(), "yaw of three": K.watcher(lambda p: p["head_pose"]["yaw"]["mean"], lambda p: p["head_pose"]["yaw"]["n"], 3), "things": K.things("x"),
        "person depth": K.person_depth(), "background": K.background_depth(), "face height": K.face_height(c("tall")), "face ratio": K.face_ratio(), "lengths": K.shot_lengths(F.log10), "log lengths": K.shot_lengths(), "people time": K.one(K.people_time()), "warmth": K.one(K.plastic_mean("warmth")),
        "ages": F.transform(K.ages(BRACKETS), lambda a: a["x"] * 1000 + a["w"]),
    }


LISTS_SQL = f"""{FLAT}, f AS (
SELECT video, 'brightness' AS field, brightness AS x FROM s UNION ALL SELECT video, 'person seconds', seconds FROM w UNION ALL SELECT video, 'valence', mean FROM w WHERE views > 0 UNION ALL SELECT video, 'yaw', mean - 50 FROM w WHERE errors >= 1 UNION ALL SELECT video, 'yaw of three', mean - 50 FROM w WHERE errors >= 3
UNION ALL SELECT x.video, 'things', k / 100 FROM x JOIN s USING (video, segment) WHERE label = 'view' AND s.n > 1 UNION ALL SELECT x.video, 'person depth', value FROM x JOIN s USING (video, segment) WHERE label = 'view' AND s.background IS NOT NULL
UNION ALL SELECT video, 'background', background FROM s WHERE background IS NOT NULL UNION ALL SELECT video, 'face height', face * 1.5 FROM s WHERE first <> 'error' AND face > 0 UNION ALL SELECT video, 'face ratio', clicks - 1 FROM s WHERE clicks > 1
UNION ALL SELECT video, 'lengths', log10(seconds) FROM s UNION ALL SELECT video, 'log lengths', ln(seconds) FROM s UNION ALL SELECT video, 'people time', sum(CASE WHEN bought > 0 THEN seconds ELSE 0 END) / sum(seconds) FROM s GROUP BY 1 UNION ALL SELECT video, 'warmth', warmth FROM v WHERE error > 12
UNION ALL SELECT video, 'ages', person % 7 * 1000 + sum(seconds) FROM p WHERE clicks > 0 GROUP BY video, person % 7)"""


def listed(spark, d):
    k = records(spark, d)
    return long(k, lists(k), lambda x: [x.cast("array<double>").alias("xs")]).select("video", "field", F.explode("xs").alias("x"))


@query(f"{LISTS_SQL} SELECT video, field, count(*)::BIGINT AS n, sum(x) AS sum, min(x) AS low, max(x) AS high FROM f GROUP BY ALL", "sum low high")
def record_lists(spark, d):
    return listed(spark, d).groupBy("video", "field").agg(F.count("x").alias("n"), F.sum("x").alias("sum"), F.min("x").alias("low"), F.max("x").alias("high"))


@query(f"{LISTS_SQL}, q AS (SELECT field, quantile_cont(x, 0.005) AS low, quantile_cont(x, 0.995) AS high FROM f GROUP BY 1) SELECT field, low, CASE WHEN high > low THEN high ELSE low + 1 END AS high FROM q", "low high")
def record_spans(spark, d):
    return K.pooled_span(listed(spark, d), ["field"], "x")


@query(
    f"""{LISTS_SQL}, i AS (SELECT DISTINCT video % 4 AS collection, video FROM v), g AS (SELECT DISTINCT field FROM f)
SELECT field, collection, count(x)::BIGINT AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, (count(DISTINCT i.video) - count(DISTINCT f.video))::BIGINT AS lacking FROM g CROSS JOIN i LEFT JOIN f USING (field, video) GROUP BY ALL""",
    "q1 median q3",
)
def record_numeric_report(spark, d):
    k = records(spark, d)
    rows = long(k, lists(k), lambda x: [x.cast("array<double>").alias("xs")]).withColumn("collection", c("video") % 4)
    each = rows.select("field", "collection", "video", F.explode_outer("xs").alias("x"))
    q = F.percentile("x", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    lacking = F.countDistinct(F.when(c("x").isNull(), c("video")))
    return each.groupBy("field", "collection").agg(F.count("x").alias("n"), q.alias("q"), lacking.alias("lacking")).select("field", "collection", "n", c("q")[0].alias("q1"), c("q")[1].alias("median"), c("q")[2].alias("q3"), "lacking")


ARCS_SQL = f"""{FLAT}, b AS (SELECT video, min(start) AS t0, max("end") - min(start) AS len FROM s GROUP BY 1), k AS (SELECT x.*, (frame - t0) / len AS start, (frame + 60 - t0) / len AS "end", s.seconds FROM x JOIN b USING (video) JOIN s USING (video, segment)),
f AS (SELECT video, event_id, start, "end", 'brightness' AS arc, round(value, 6)::VARCHAR AS v FROM k WHERE label <> 'error' UNION ALL SELECT video, event_id, start, "end", 'pace', round(ln(seconds), 6)::VARCHAR FROM k
UNION ALL SELECT video, event_id, start, "end", 'people', least(k % 9, 5)::VARCHAR FROM k UNION ALL SELECT video, event_id, start, "end", 'camera', label FROM k WHERE label <> 'signup' UNION ALL SELECT video, event_id, start, "end", 'size', label FROM k WHERE k < 80)"""


def sequences():
    text = lambda x: F.transform(x, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.round(r["value"], 6).alias("number"), F.lit(None).cast("string").alias("label")))
    named = lambda x: F.transform(x, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(None).cast("double").alias("number"), r["value"].alias("label")))
    return {"brightness": text(K.value_arc("plastic", "brightness")), "pace": text(K.pace_arc()), "people": named(K.people_arc()), "camera": named(K.label_arc("enunciative", "camera", "signup")), "size": named(K.label_arc("enunciative", "shot_size"))}


@query(
    f"""{ARCS_SQL} SELECT video, arc AS field, count(*)::BIGINT AS n, sum(start) AS start, sum("end") AS "end", sum(CASE WHEN arc IN ('brightness', 'pace') THEN v::DOUBLE END) AS number, count(DISTINCT CASE WHEN arc NOT IN ('brightness', 'pace') THEN v END)::BIGINT AS labels FROM f GROUP BY ALL""",
    'start "end" number',
)
def record_arcs(spark, d):
    rows = long(records(spark, d), sequences(), lambda x: [x.alias("seq")]).select("video", "field", F.explode("seq").alias("r")).select("video", "field", "r.*")
    return rows.groupBy("video", "field").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("start"), F.sum("end").alias("end"), F.sum("number").alias("number"), F.countDistinct("label").alias("labels"))


@query(
    f"""{WITH} SELECT video, array_to_string(list_sort(list_distinct(list(CASE label WHEN 'view' THEN 'seen' WHEN 'click' THEN 'seen' WHEN 'error' THEN 'lost' END) FILTER (label IN ('view', 'click', 'error')))), ',') AS mapped, bool_or(label = 'view' AND segment = 3) AND NOT bool_or(label = 'error' AND segment = 3) AS member FROM e GROUP BY 1"""
)
def record_members(spark, d):
    k = events(spark, d).groupBy("video").agg(F.collect_list("label").alias("all"), F.collect_list(F.when(c("segment") == 3, c("label"))).alias("third"))
    return k.select("video", F.array_join(K.mapped(c("all"), {"view": "seen", "click": "seen", "error": "lost"}), ",").alias("mapped"), K.member(c("third"), "view", "error").alias("member"))


@query(f"{WITH} SELECT DISTINCT label FROM e WHERE k < 80 OR label <> 'signup'")
def record_vocabulary(spark, d):
    labels = lambda key: F.transform(F.flatten(F.transform(c("enunciative.segments"), lambda s: s["keyframes"])), lambda x: F.concat(F.lit(" "), F.upper(x[key])))
    return K.vocabulary(records(spark, d), [K.known(labels("shot_size")), F.filter(labels("camera"), lambda x: x != " SIGNUP")])


ODD_SQL = f"{WITH}, o AS (SELECT video, frame AS start FROM e WHERE label = 'view' AND k % 9 = 0)"


@query(f"{ODD_SQL} SELECT * FROM o ORDER BY video, start LIMIT 30")
def record_misses(spark, d):
    frames = F.flatten(F.transform(c("figurative.segments"), lambda s: s["keyframes"]))
    return K.seen_without(records(spark, d), "video", frames, lambda x: (x["camera"] == "view") & (x["people"] == 0))[0]


@query(f"{ODD_SQL} SELECT count(*)::BIGINT AS keyframes, count(DISTINCT video)::BIGINT AS records FROM o")
def record_miss_totals(spark, d):
    frames = F.flatten(F.transform(c("figurative.segments"), lambda s: s["keyframes"]))
    return K.seen_without(records(spark, d), "video", frames, lambda x: (x["camera"] == "view") & (x["people"] == 0))[1]
