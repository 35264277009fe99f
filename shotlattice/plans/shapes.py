"""Queries of boxes, bands, joins of labels and text inputs, each with its SQL over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B, geometry as G, vectors as X
from ..operators import media as M, scoring as C
from ..sources import readers
from .adapters import events, table
from .catalogue import WITH, query

c = F.col

#: A face (x1 = k, y1 = 40, 30 wide, 40 high) and a body (120 wide, value high) of every event.
BOXES = f"{WITH}, b AS (SELECT event_id, label, k AS fx1, 40 AS fy1, k + 30 AS fx2, 80 AS fy2, segment AS bx1, 20 AS by1, segment + 120 AS bx2, 20 + value AS by2, value, k FROM e)"


def boxes(spark, d):
    e = events(spark, d)
    return e.select("event_id", "label", "value", "k", "segment", G.box(c("k"), F.lit(40), c("k") + 30, F.lit(80)).alias("face"), G.box(c("segment"), F.lit(20), c("segment") + 120, c("value") + 20).alias("body"))


@query(
    f"""{BOXES} SELECT event_id, (fx1 + fx2) / 2 AS x, (fy1 + fy2) / 2 AS y, (fy1 + fy2) / 2 - 0.15 * 40 AS head_y, fx1 < bx2 AND bx1 < fx2 AND fy1 < by2 AND by1 < fy2 AS overlap, (by1 + by2) / 2 AS middle,
abs((fx1 + fx2) / 2 - (bx1 + bx2) / 2) <= 30 AND 60 >= by1 AND 60 <= (by1 + by2) / 2 AS seated, CASE WHEN label = 'error' THEN (bx1 + bx2) / 2 ELSE (fx1 + fx2) / 2 END AS span_x, CASE WHEN label = 'error' THEN by1 ELSE 54 END AS span_top, CASE WHEN label = 'error' THEN least(by2, by1 + 0.58 * 120) ELSE 54 END AS span_bottom FROM b""",
    "x y head_y middle span_x span_top span_bottom",
)
def box_places(spark, d):
    b = boxes(spark, d)
    x, y = G.centre(c("face"))
    span = G.head_span(F.when(c("label") != "error", c("face")), c("body"))
    return b.select("event_id", x.alias("x"), y.alias("y"), G.head_centre(c("face"))[1].alias("head_y"), G.overlaps(c("face"), c("body")).alias("overlap"), G.upper_half(c("body"))["y2"].alias("middle"), G.seated(c("face"), c("body")).alias("seated"), span["x"].alias("span_x"), span["top"].alias("span_top"), span["bottom"].alias("span_bottom"))


@query(
    f"""{BOXES}, p AS (SELECT *, round_even(0.1 * greatest(120, value), 0) AS pad FROM b) SELECT event_id, greatest(bx1 - pad, 0) AS x1, greatest(by1 - pad, 0) AS y1, least(bx2 + pad, 140) AS x2, least(by2 + pad, 150) AS y2,
least(fx2, 100) - greatest(fx1, 0) >= 24 AND least(fy2, 70) - 40 >= 24 AS kept, round_even((k + 3) / 100 * 32, 0) > round_even(k / 100 * 32, 0) AND round_even(value / 100 * 32, 0) > round_even(0.016 * 32, 0) AS cells FROM p""",
    "x1 y1 x2 y2",
)
def box_crops(spark, d):
    b = boxes(spark, d)
    p = G.padded(c("body"), 0.1, F.lit(140), F.lit(150))
    unit = G.box(c("k") / 100, F.lit(0.016), (c("k") + 3) / 100, c("value") / 100)
    return b.select("event_id", *[p[n].alias(n) for n in ("x1", "y1", "x2", "y2")], G.clipped(c("face"), F.lit(100), F.lit(70)).isNotNull().alias("kept"), G.spans_cells(unit).alias("cells"))


@query(
    f"""{WITH}, g AS (SELECT video, segment, arg_max(struct_pack(x := k, w := value), (value, k)) AS m, max(value) AS score FROM e WHERE label <> 'error' GROUP BY ALL), r AS (SELECT video, segment, score, round_even(m.x / 0.5, 0) AS x, round_even(m.w / 0.5, 0) AS w FROM g)
SELECT video, segment, CASE WHEN score >= 20 THEN least(greatest(10 + x, 10), 150) END AS x1, CASE WHEN score >= 20 THEN least(greatest(10 + x + w, 10), 150) END AS x2 FROM r""",
    "x1 x2",
)
def best_face(spark, d):
    e = events(spark, d).where("label <> 'error'")
    found = F.collect_list(F.struct(c("value").alias("score"), c("k").cast("double").alias("x"), F.lit(3.0).alias("y"), c("value").alias("w"), F.lit(5.0).alias("h")))
    b = e.groupBy("video", "segment").agg(found.alias("found"))
    box = G.best_face(c("found"), G.box(F.lit(10.0), F.lit(10.0), F.lit(150.0), F.lit(150.0)), F.lit(0.5), 20.0)
    return b.select("video", "segment", box["x1"].alias("x1"), box["x2"].alias("x2"))


@query(
    f"""{BOXES} SELECT event_id, CASE WHEN k > 0 THEN greatest(0, 1 - 2 * abs(value - k / 2) / k) END AS front, degrees(atan2(sin(radians(k)), abs(cos(radians(k))))) AS yaw, round_even(1920 * least(1, 512 / 1920), 0)::INT AS width, round_even((300 + k) * least(1, 512 / 1920), 0)::INT AS height, chr(65 + k % 26) || chr(66) || 'Z' AS codec FROM b""",
    "front yaw",
)
def head_angles(spark, d):
    b = boxes(spark, d)
    a = F.radians(c("k"))
    turn = F.array(F.cos(a), F.lit(0.0), F.sin(a), F.lit(0.0), F.lit(1.0), F.lit(0.0), -F.sin(a), F.lit(0.0), F.cos(a))
    fit = G.fitted(F.lit(1920), 300 + c("k"), 512)
    number = (65 + c("k") % 26) + F.lit(66 * 256 + 90 * 65536)
    return b.select("event_id", G.frontality(c("value"), F.lit(0.0), c("k").cast("double")).alias("front"), G.euler(turn)["yaw"].alias("yaw"), fit["width"].alias("width"), fit["height"].alias("height"), F.rtrim(F.replace(M.codec(number), F.lit("\0"), F.lit(""))).alias("codec"))


@query(
    f"""{WITH}, s AS (SELECT video, segment, CASE WHEN bool_or(label = 'view') THEN quantile_cont(value / 200, 0.5) FILTER (label = 'view') END AS face, CASE WHEN bool_or(label = 'click') THEN quantile_cont(k / 80, 0.5) FILTER (label = 'click') END AS body, avg(value) / 500 AS ratio, CASE WHEN segment % 2 = 0 THEN 'medium' END AS proto FROM e GROUP BY ALL),
f AS (SELECT *, coalesce(face, 0) AS f, coalesce(body, 0) AS b, face IS NOT NULL OR body IS NOT NULL AS seen FROM s)
SELECT video, segment, CASE WHEN NOT seen THEN proto WHEN f >= 0.75 THEN 'extreme close-up' WHEN f >= 0.33 THEN 'close-up' WHEN f >= 0.125 THEN 'medium' WHEN b >= 1 THEN 'medium long' WHEN b >= 0.25 THEN 'long' ELSE 'extreme long' END AS scale, CASE WHEN seen THEN 'measured' WHEN proto IS NOT NULL THEN 'prototype' END AS source, CASE WHEN seen THEN CASE WHEN ratio >= 0.05 THEN 'portrait' ELSE 'scene' END END AS scene FROM f"""
)
def segment_framing(spark, d):
    median = lambda x, label: F.percentile(F.when(c("label") == label, x), F.lit(0.5))
    s = events(spark, d).groupBy("video", "segment").agg(median(c("value") / 200, "view").alias("face"), median(c("k") / 80, "click").alias("body"), (F.avg("value") / 500).alias("ratio"))
    return s.select("video", "segment", B.framing(c("face"), c("body"), c("ratio"), F.when(c("segment") % 2 == 0, "medium")).alias("f")).select("video", "segment", "f.*")


@query(
    f"""{WITH}, o AS (SELECT event_id, k % 9 AS here, value >= 50 AS tight, unnest([{{'name': 'A', 'places': [1]}}, {{'name': 'B', 'places': [3, 4]}}, {{'name': 'C', 'places': [6]}}, {{'name': 'D', 'places': [8]}}]) AS o FROM e), g AS (SELECT event_id, tight, o.name AS name, list_min(o.places) AS least, list_min(list_transform(o.places, lambda p: abs(p - here))) AS gap FROM o)
SELECT event_id, name AS chosen FROM g QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap, CASE WHEN tight THEN least ELSE -least END, name) = 1"""
)
def chosen_option(spark, d):
    options = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, p)).alias("places")) for n, p in (("A", [1]), ("B", [3, 4]), ("C", [6]), ("D", [8]))])
    return events(spark, d).select("event_id", B.chosen(options, c("k") % 9, B.tight_half(c("value"), 0, 100)).alias("chosen"))


@query(f"{WITH} SELECT CASE WHEN label = 'view' THEN 1 WHEN label = 'error' THEN -1 WHEN k < 50 THEN 0 ELSE 2 END AS step, count(*)::BIGINT AS n FROM e GROUP BY 1")
def measured_steps(spark, d):
    e = events(spark, d).select(B.measured_step(F.when(c("label") == "view", c("value")), F.when(c("label") != "error", c("value")), c("k") >= 50).alias("step"))
    return e.groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{WITH}, l AS (SELECT video, list((value >= 20) ORDER BY event_id) AS lit FROM e GROUP BY 1) SELECT video, CASE WHEN NOT list_contains(lit, true) THEN 1.0 ELSE (list_position(lit, true) - 1 + list_position(list_reverse(lit), true) - 1) / len(lit) END AS bars FROM l",
    "bars",
)
def black_bars(spark, d):
    rows = events(spark, d).groupBy("video").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("rows"))
    return rows.select("video", G.black_edges(F.transform("rows", lambda r: r["value"]), 20.0).alias("bars"))


# ---------------------------------------------------------------- joins of labels and tables


@query(
    f"""{BOXES}, h AS (SELECT event_id // 50 AS g, event_id AS id, (fx1 + fx2) / 2 AS x, k / 2 AS y FROM b WHERE label = 'view'), p AS (SELECT event_id // 50 AS g, event_id AS id, bx1, by1, bx2, by2 FROM b WHERE label = 'click')
SELECT p.id, h.id AS head FROM p JOIN h ON p.g = h.g AND x BETWEEN bx1 AND bx2 AND y BETWEEN by1 AND (by1 + by2) / 2 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY round(sqrt((x - (bx1 + bx2) / 2) ** 2 + (y - by1) ** 2), 6), h.id) = 1"""
)
def own_heads(spark, d):
    from ..operators.shapes import own_head

    b = boxes(spark, d).withColumn("g", F.floor(c("event_id") / 50))
    heads = b.where("label = 'view'").select("g", c("event_id").alias("id"), G.centre(c("face"))[0].alias("x"), (c("k") / 2).alias("y"))
    return own_head(b.where("label = 'click'").select("g", c("event_id").alias("id"), "body"), heads, ["g"])


@query(f"{WITH}, g AS (SELECT video, segment, list(DISTINCT k % 7) AS ls, min(value) AS s, max(value) + 1 AS t FROM e GROUP BY ALL) SELECT video, segment, round_even(s * 24, 0)::BIGINT AS start, round_even(t * 24, 0)::BIGINT AS \"end\", CASE WHEN ls[1] = 5 THEN '5+' ELSE ls[1]::VARCHAR END AS label FROM g WHERE len(ls) = 1 AND ls[1] <= 5")
def single_label_spans(spark, d):
    from ..operators.shapes import single_label

    g = events(spark, d).groupBy("video", "segment").agg(F.collect_set((c("k") % 7).cast("string")).alias("labels"), F.min("value").alias("start"), (F.max("value") + 1).alias("end"))
    return single_label(g, ["video", "segment"], "labels", "start", "end", 24.0, [str(i) for i in range(6)], "5")


@query(f"{WITH}, r AS (SELECT video, segment, min(frame) // 3600 AS a, max(frame) // 3600 AS b FROM e GROUP BY ALL), x AS (SELECT video, segment, unnest(range(a, b + 1)) AS hour FROM r) SELECT video, segment, count(*)::BIGINT AS hours, sum(hour)::BIGINT AS total FROM x GROUP BY ALL")
def frame_map(spark, d):
    from ..operators.shapes import frames_of

    r = events(spark, d).groupBy("video", "segment").agg(F.floor(F.min("frame") / 3600).alias("a"), F.floor(F.max("frame") / 3600).alias("b"))
    return frames_of(r, ["video", "segment"], "a", "b").groupBy("video", "segment").agg(F.count(F.lit(1)).alias("hours"), F.sum("frame").alias("total"))


@query(f"{WITH}, n AS (SELECT video, label, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT video, label, n / sum(n) OVER (PARTITION BY video) AS share, row_number() OVER (PARTITION BY video ORDER BY n DESC, label) AS rank FROM n) SELECT video, label, share, rank FROM r WHERE rank <= 2", "share")
def region_coverage(spark, d):
    from ..operators.shapes import region_shares

    return region_shares(events(spark, d), ["video"], "label", 2)


@query(f"{WITH}, n AS (SELECT video, label, count(*) AS n, count(*) FILTER (k > 50) AS p FROM e GROUP BY ALL) SELECT video, coalesce(max(p) FILTER (label = 'view') / nullif(max(n) FILTER (label = 'view'), 0), 0) AS view, coalesce(max(p) FILTER (label = 'click') / nullif(max(n) FILTER (label = 'click'), 0), 0) AS click FROM n GROUP BY 1", "view click")
def counter_matrix(spark, d):
    from ..operators.shapes import counters

    m = counters(events(spark, d), "video", "label", {"n": F.lit(1), "present": (c("k") > 50).cast("int")}, ["click", "view"])
    return m.select("video", *[F.coalesce(F.try_divide(f"{x}_present", f"{x}_n"), F.lit(0.0)).alias(x) for x in ("view", "click")])


@query(
    f"""{WITH}, p AS (SELECT video, segment, count(*) FILTER (label = 'view' AND value > 30) AS ah, count(*) FILTER (label = 'view') AS an, count(*) FILTER (label = 'click' AND value > 30) AS bh, count(*) FILTER (label = 'click') AS bn, avg((k > 50)::INT) >= 0.5 AS truth FROM e GROUP BY ALL),
g AS (SELECT share / 10 AS share, least, p.*, an >= least AND bn >= least AND ah >= share / 10 * an AND bh >= share / 10 * bn AS said FROM p, unnest([3, 5, 7]) s(share), unnest([1, 2]) l(least))
SELECT share, least, count(*) FILTER (said AND truth)::BIGINT AS hits, count(*) FILTER (said)::BIGINT AS said, count(*) FILTER (truth)::BIGINT AS truth FROM g GROUP BY ALL""",
    "share",
)
def listing_grid(spark, d):
    from ..operators.shapes import swept_listing

    e = events(spark, d)
    on = lambda label: F.count_if((c("label") == label) & (c("value") > 30))
    of = lambda label: F.count_if(c("label") == label)
    p = e.groupBy("video", "segment").agg(on("view").alias("a_hits"), of("view").alias("a_n"), on("click").alias("b_hits"), of("click").alias("b_n"), (F.avg((c("k") > 50).cast("int")) >= 0.5).alias("truth"))
    return swept_listing(p, [0.3, 0.5, 0.7], [1, 2])


# ---------------------------------------------------------------- text inputs


@query(
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE text IS NOT NULL), w AS (SELECT list_filter(regexp_split_to_array(line, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS words FROM l) SELECT len(words) AS words, count(*)::BIGINT AS lines FROM w WHERE len(words) > 0 GROUP BY 1""",
)
def text_lines(spark, d):
    line = F.explode(F.split("text", "\n"))
    rows = table(spark, d, "conversations").where("text is not null").select(line.alias("line"))
    return readers.line_words(rows, "line").groupBy(F.size("words").alias("words")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    f"""{WITH}, n AS (SELECT video, event_id, label, k, value, row_number() OVER (PARTITION BY video ORDER BY event_id) AS r FROM e), h AS (SELECT *, CASE WHEN k % 5 = 0 THEN k END AS head FROM n), f AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY video ORDER BY r) AS block FROM h)
SELECT video, block AS head, count(*)::BIGINT AS rows, sum(k)::BIGINT AS total, min(label) AS first FROM f WHERE head IS NULL GROUP BY ALL"""
)
def text_blocks(spark, d):
    e = events(spark, d).select("video", "event_id", F.when(c("k") % 5 == 0, c("k").cast("string")).otherwise(F.concat_ws("  ", c("k").cast("string"), c("label"))).alias("text"))
    b = readers.blocks(e, "video", "event_id", "text")
    return b.groupBy("video", "head").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.element_at("values", 1)).cast("long").alias("total"), F.min(F.coalesce(F.try_element_at("names", F.lit(1)), F.lit("unknown"))).alias("first"))


@query(
    f"""{WITH}, n AS (SELECT video, event_id, value, label, row_number() OVER (PARTITION BY video ORDER BY event_id) - 1 AS r FROM e) SELECT video, label AS name, count(*)::BIGINT AS rows, count(*) FILTER (value - 30 >= 0)::BIGINT AS inside FROM n WHERE r % 3 = 0 GROUP BY ALL"""
)
def strided_labels(spark, d):
    e = events(spark, d).select("video", "event_id", F.concat_ws(",", c("label"), F.lit("1,2,3,4"), c("value") - 30).alias("line"))
    return readers.strided_csv(e, "video", "event_id", "line", 3).groupBy("video", "name").agg(F.count(F.lit(1)).alias("rows"), F.count_if("inside").alias("inside"))


@query("SELECT p.p_partkey AS id, replace(replace(substr('/a/' || p.p_brand || '/' || replace(p.p_name, ' ', '_'), 4), '/', ' '), '_', ' ') AS name, s.ps = 2 AS outdoor FROM part p JOIN (SELECT p_partkey AS id, p_size % 2 + 1 AS ps FROM part) s ON s.id = p.p_partkey")
def place_names(spark, d):
    p = table(spark, d, "part")
    path = F.concat(F.lit("/a/"), c("p_brand"), F.lit("/"), F.replace(c("p_name"), F.lit(" "), F.lit("_")))
    names = p.select(c("p_partkey").alias("id"), path.alias("path"))
    kinds = p.select(c("p_partkey").alias("id"), (c("p_size") % 2 + 1).cast("string").alias("kind"))
    return readers.places(names.join(kinds, "id"), "path", "kind").select("id", "name", "outdoor")


@query(f"{WITH}, b AS (SELECT video, segment, frame // 3600 AS at, count(*) AS n, max(label) AS label FROM e GROUP BY ALL), v AS (SELECT video, count(DISTINCT segment) AS files FROM e WHERE label <> 'view' GROUP BY 1), w AS (SELECT video, count(DISTINCT segment) AS blocks FROM e GROUP BY 1) SELECT b.video, count(*)::BIGINT AS frames, sum(n)::BIGINT AS boxes FROM b JOIN v USING (video) JOIN w USING (video) WHERE abs(files - blocks) <= 1 AND n >= 2 AND label <> 'view' GROUP BY 1")
def labelled_heads(spark, d):
    e = events(spark, d).withColumn("at", F.floor(c("frame") / 3600))
    b = e.groupBy("video", "segment", "at").agg(F.collect_list("event_id").alias("boxes"), F.max("label").alias("label"))
    files = e.where("label <> 'view'").groupBy("video").agg(F.countDistinct("segment").alias("files"))
    blocks = e.groupBy("video").agg(F.countDistinct("segment").alias("blocks"))
    found = readers.usable_blocks(b, files, blocks, "video", "boxes", c("label") != "view")
    return found.groupBy("video").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.size("boxes")).cast("long").alias("boxes"))
