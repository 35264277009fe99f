"""The stability of neighbours in tiles against the joins of pairs, with blocks so small that pairs lie in all of them."""

import random

from pyspark.sql import functions as F

from shotlattice.operators import assess, blocks, distance as D
from shotlattice.plans import catalogue


def test_stability_in_tiles_is_that_of_all_pairs(spark):
    rng = random.Random(8)
    rows = [(i, None if i % 7 == 0 else rng.choice([0.5, 2.0, rng.random()]), None if i % 4 == 0 else float(rng.randint(0, 9))) for i in range(41)]
    rows += [(50, None, None)]  # no neighbour at all but the means
    items = spark.createDataFrame(rows, "item long, x double, y double").cache()
    raw = None
    for f in "xy":
        r = D.difference(items, f).select(F.lit(f).alias("field"), F.lit("l").alias("level"), F.lit("g").alias("grp"), "a", "b", "raw")
        raw = r if raw is None else raw.unionByName(r)
    lacks = items.where("x is null").select(F.lit("x").alias("field"), "item").union(items.where("y is null").select(F.lit("y"), "item"))
    want = {r.item: r.overlap for r in assess.stability(D.impute(D.calibrate_scale(raw), lacks), "imputed", 6, 3).collect()}
    specs = [("x", "l", "g", "scalar"), ("y", "l", "g", "scalar")]
    for size in (5, 256):
        got = blocks.Collection(items, specs, size).stability(6, 3)
        assert {r.item: r.overlap for r in got.collect()} == want
    few = blocks.Collection(items.where("item < 3"), specs, 2).stability(6, 3)  # fewer others than neighbours: all of them stay
    assert {r.overlap for r in few.collect()} == {1.0}


def test_stability_joins_no_pairs(spark):
    plan = catalogue.queries()["neighbour_stability"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LessThan" not in plan and "Generate" in plan
