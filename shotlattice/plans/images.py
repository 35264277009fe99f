"""Queries of image measures: a user's events, in order, are the pixels of an image six wide."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images as M
from .adapters import events
from .catalogue import WITH, query

c = F.col

PIXELS = f"""{WITH}, n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY video) // 6 AS h FROM e), px AS (SELECT video, h, i // 6 AS y, i % 6 AS x, k * 2 AS r, floor(least(value, 255))::INT AS g, segment * 8 AS b FROM n WHERE i < h * 6),
gr AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS gray FROM px)"""


def images(spark, d):
    e = events(spark, d)
    pixel = F.struct("event_id", (c("k") * 2).cast("double").alias("r"), F.floor(F.least("value", F.lit(255.0))).cast("double").alias("g"), (c("segment") * 8).cast("double").alias("b"))
    rows = e.groupBy("video").agg(F.array_sort(F.collect_list(pixel)).alias("p")).withColumn("n", F.floor(F.size("p") / 6) * 6)
    flat = F.flatten(F.transform(F.slice("p", F.lit(1), c("n").cast("int")), lambda x: F.array(x["r"], x["g"], x["b"])))
    return rows.select("video", flat.alias("rgb"), F.lit(6).alias("width"), F.array(F.array(F.lit(1), F.lit(1), F.lit(3), (c("n") / 12).cast("int")), F.array(F.lit(2), F.lit(0), F.lit(9), F.lit(2))).alias("boxes"))


@query(
    f"""{PIXELS}, u AS (SELECT *, gray / 255 AS v, greatest(r, g, b) AS hi, least(r, g, b) AS lo, (r - g) / 255 AS rg, ((r + g) / 2 - b) / 255 AS yb FROM gr),
a AS (SELECT video, avg(v) AS brightness, stddev_pop(v) AS contrast_rms, coalesce((max(v) - min(v)) / nullif(max(v) + min(v), 0), 0) AS contrast_michelson, avg(coalesce((hi - lo) / nullif(hi, 0), 0)) AS saturation, sqrt(var_pop(rg) + var_pop(yb)) + 0.3 * sqrt(avg(rg) ** 2 + avg(yb) ** 2) AS colourfulness FROM u GROUP BY 1),
s AS (SELECT p.video, 1 - avg(abs(p.gray - q.gray)) / 255 AS symmetry FROM gr p JOIN gr q ON p.video = q.video AND p.y = q.y AND q.x = 5 - p.x GROUP BY 1),
nb AS (SELECT *, lag(gray) OVER cx AS l, lead(gray) OVER cx AS rr, lag(gray) OVER cy AS up, lead(gray) OVER cy AS dn FROM gr WINDOW cx AS (PARTITION BY video, y ORDER BY x), cy AS (PARTITION BY video, x ORDER BY y)),
lp AS (SELECT video, var_pop(l + rr + up + dn - 4 * gray) AS sharpness FROM nb WHERE l IS NOT NULL AND rr IS NOT NULL AND up IS NOT NULL AND dn IS NOT NULL GROUP BY 1),
nz AS (SELECT video, avg(1 / sqrt(1 + dx * dx + dy * dy)) AS level FROM (SELECT video, CASE WHEN l IS NULL THEN rr - gray WHEN rr IS NULL THEN gray - l ELSE (rr - l) / 2 END AS dx, CASE WHEN up IS NULL THEN dn - gray WHEN dn IS NULL THEN gray - up ELSE (dn - up) / 2 END AS dy FROM nb) GROUP BY 1),
ln AS (SELECT video, 'y' AS w, y AS pos, any_value(h) AS n, avg(gray) AS m FROM gr GROUP BY video, y UNION ALL SELECT video, 'x', x, 6, avg(gray) FROM gr GROUP BY video, x), ed AS (SELECT video, w, coalesce((min(pos) FILTER (m >= 50) + any_value(n) - 1 - max(pos) FILTER (m >= 50)) / any_value(n), 1) AS bar FROM ln GROUP BY ALL), br AS (SELECT video, max(bar) AS bars FROM ed GROUP BY 1)
SELECT * FROM a JOIN s USING (video) JOIN lp USING (video) JOIN nz USING (video) JOIN br USING (video)""",
    " ".join(M.MEASURES),
)
def image_measures(spark, d):
    return M.measures(images(spark, d), "video", "rgb", "width", 50)


@query(f"{PIXELS}, cl AS (SELECT video, ((r // 32) * 64 + (g // 32) * 8 + b // 32)::INT AS cell, count(*) AS n, avg(r) AS red, avg(g) AS green, avg(b) AS blue FROM px GROUP BY ALL) SELECT video, cell, n / sum(n) OVER (PARTITION BY video) AS share, red, green, blue, row_number() OVER (PARTITION BY video ORDER BY n DESC, cell)::INT AS rank FROM cl QUALIFY rank <= 8", "share red green blue")
def image_palettes(spark, d):
    return M.palettes(images(spark, d), "video", "rgb", "width")


@query(f"{PIXELS}, ch AS (SELECT video, unnest([0, 1, 2]) AS channel, unnest([r, g, b]) AS v FROM px) SELECT video, channel, (v * 16 // 256)::INT AS bin, count(*) / any_value(t) AS share FROM ch JOIN (SELECT video, count(*) AS t FROM px GROUP BY 1) USING (video) GROUP BY video, channel, bin", "share")
def image_histograms(spark, d):
    return M.histograms(images(spark, d), "video", "rgb", "width")


@query(f"{PIXELS} SELECT video, avg((NOT (x BETWEEN 1 AND 2 AND y >= 1 AND y < h * 6 // 12) AND NOT (x >= 2 AND y < 2))::INT) AS share FROM px GROUP BY 1", "share")
def image_uncovered(spark, d):
    return M.uncovered(images(spark, d), "video", "rgb", "width", "boxes")
