"""The order of a collection by ranks in tiles against the joins of pairs, with items that lack an arc and blocks so small that pairs lie in all of them."""

import random

from pyspark.sql import functions as F

from shotlattice.operators import distance as D, similarity
from shotlattice.plans import catalogue


def test_order_in_tiles_is_that_of_all_pairs(spark):
    rng = random.Random(12)
    rows = []
    for i in range(17):
        for p in range(rng.choice([0, 1, 6, 9])):
            if i % 5:
                rows.append((i, "brightness arc", p, rng.choice([None, rng.random() * 10]), None, float(rng.randint(1, 4))))
            if i % 4:
                rows.append((i, "emotion arc", p, None, rng.choice([None, "calm", "glad", "sad"]), float(rng.randint(1, 4))))
    arcs = spark.createDataFrame(rows, "item long, field string, place long, x double, state string, w double").cache()
    readings = similarity.Readings(spark.range(18).withColumnRenamed("id", "item"), arcs=arcs, fields=(), arc_fields=tuple(f for f in similarity.ARCS if f[0] in ("brightness arc", "emotion arc")))
    raw = lacks = None
    for name, level, group, kind in readings.arc_fields:
        pairs, having = similarity.arc_distance(readings, name, kind)
        each = D.item_pairs(readings.items).join(pairs, ["a", "b"], "left").select(F.lit(name).alias("field"), F.lit(level).alias("level"), F.lit(group).alias("grp"), "a", "b", F.round("raw", 6).alias("raw"))
        without = readings.items.join(having, "item", "left_anti").select(F.lit(name).alias("field"), "item")
        raw, lacks = (each, without) if raw is None else (raw.unionByName(each), lacks.unionByName(without))
    tree = D.score_tree(D.impute(D.calibrate_rank(raw), lacks)).where("grp = 'arc'")
    want = {(r.a, r.b): r.score for r in tree.groupBy("a", "b").agg(F.avg("score").alias("score")).collect()}
    assert {x is None for x in want.values()} == {True, False}
    for size in (4, 1024):
        got = {(r.a, r.b): r.score for r in similarity.order_by_rank(readings, size, 6).collect()}
        assert got.keys() == want.keys() and len(got) == 18 * 17 // 2
        for k, v in want.items():
            assert v == got[k] or abs(v - got[k]) < 1e-9, k


def test_order_joins_no_pairs(spark):
    plan = catalogue.queries()["similarity_rank_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan
