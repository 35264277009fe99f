"""Pairs that are no doubles, counted without making them, against the pairs."""

import random

from pyspark.sql import functions as F

from shotlattice.operators import frames as R
from shotlattice.plans import catalogue


def test_marks_are_those_of_the_pairs(spark):
    rng = random.Random(3)
    rows = [(i, v) for i in range(7) for v in rng.sample(range(-40, 60), i * 7)] + [(7, 5), (None, 3), (2, None), (8, 3), (8, 7), (None, 9)]
    t = spark.createDataFrame(rows, "item long, v long").cache()
    items = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6, 6, 7, 8, 99, None)], "item long")
    p = t.selectExpr("item", "v AS a").join(t.selectExpr("item", "v AS b"), "item").where("a < b")
    want = R.pairs_without(p, p.where("(a + b) % 10 = 0"), items, "item").groupBy("item").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("a") * 7 + F.col("b")).alias("marks"))
    got = R.marks_without(t, items, "item", "v", 10, 7, 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_distinct_pairs_makes_no_pair(spark):
    plan = catalogue.queries()["distinct_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "video#" in plan and " < " not in plan and "LeftAnti" not in plan
