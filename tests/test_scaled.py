"""Scaled and imputed distances in blocks against the joins of pairs, with missing values and blocks so small that pairs lie in all of them."""

import random

import pytest
from pyspark.sql import functions as F

from shotlattice.operators import assess, blocks, distance as D
from shotlattice.plans import catalogue

SF = "/root/testdata/sf0.001"


def same(got, want):
    key = lambda r: tuple("~" if x is None else round(x, 9) + 0.0 if isinstance(x, float) else x for x in r)
    assert sorted(map(key, got.select(*want.columns).collect()), key=repr) == sorted(map(key, want.collect()), key=repr)


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 7 == 0 else rng.choice([0.5, 2.0, rng.random()]), None if i % 4 == 0 else float(rng.randint(0, 3))) for i in range(23)]
    items = spark.createDataFrame(rows, "item long, x double, y double").cache()
    raw = None
    for f in "xy":
        r = D.difference(items, f).select(F.lit(f).alias("field"), F.lit("l").alias("level"), F.lit(f"g{f}").alias("grp"), "a", "b", "raw")
        raw = r if raw is None else raw.unionByName(r)
    lacks = items.where("x is null").select(F.lit("x").alias("field"), "item").union(items.where("y is null").select(F.lit("y"), "item"))
    return blocks.Collection(items, [("x", "l", "gx", "scalar"), ("y", "l", "gy", "scalar")], 5), D.impute(D.calibrate_scale(raw), lacks).cache(), items


def test_pairs_in_blocks(both):
    made, want, _ = both
    same(made.pairs(), want)
    same(made.pairs([1, 22]), want.where("a = 1 and b = 22"))
    same(made.whole(), D.score_tree(want).where("level is null").select("a", "b", "score"))


def test_clusters_in_blocks(both):
    made, want, items = both
    members = items.select("item", (F.col("item") % 3).cast("int").alias("cluster"))
    same(made.held_by(members, 2), D.held_by(want, members, "imputed", 2))
    same(assess.silhouettes_of(made.to_clusters(members, "y")), assess.silhouettes(want.where("field = 'y'"), members, "imputed"))


def test_ranks_of_a_field_are_no_single_task(both):
    rows = both[1].select("field", "a", "b", F.round("raw", 3).alias("raw"))
    got = D.calibrate_rank(rows)
    assert "windowspecdefinition(field" not in got._jdf.queryExecution().analyzed().toString()
    known = [(r.field, r.raw) for r in rows.collect() if r.raw is not None]
    for r in got.collect():
        own = [x for f, x in known if f == r.field]
        assert r.calibrated == (None if r.raw is None else sum(x < r.raw for x in own) / len(own))


@pytest.mark.parametrize("name", ["calibrate_scale", "impute_mean", "explain_pair", "held_by", "cluster_silhouettes"])
def test_no_pairs_are_joined(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LessThan" not in plan and "percentile(" not in plan
