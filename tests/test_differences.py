"""Differences of all pairs in tiles, against the join of pairs."""

import random

import pytest

from shotlattice.operators import blocks, distance as D
from shotlattice.plans import catalogue


@pytest.mark.parametrize("size", [3, 1024])
def test_differences_in_tiles(spark, size):
    rng = random.Random(4)
    rows = [(i, None if i % 9 == 0 else rng.choice([0.5, 2.0, float("nan"), rng.random()])) for i in range(70)] + [(None, 1.0)]
    items = spark.createDataFrame(rows, "item long, x double")
    key = lambda df: sorted((r.a, r.b, str(r.raw)) for r in df.collect())
    assert key(blocks.differences(items, "x", size=size)) == key(D.difference(items, "x"))
    names = items.where("item is not null").selectExpr("concat('n', item) AS item", "x")
    assert key(blocks.differences(names, "x", size=size)) == key(D.difference(names, "x"))
    assert blocks.differences(items.where("item < 0"), "x").count() == 0


def test_no_side_is_broadcast(spark):
    plan = catalogue.queries()["difference_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
