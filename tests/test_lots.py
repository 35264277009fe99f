"""Pairs of items in lots of blocks: an item is sent to every lot, not to every block, and every pair comes once."""

import random

import numpy as np
from pyspark.sql import functions as F

from shotlattice.operators import blocks


def test_pairs_come_once_from_lots(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LOTS", 2)
    monkeypatch.setattr(blocks, "TOGETHER", 3)
    rng = random.Random(2)
    labels = spark.createDataFrame([(i, x, rng.random()) for i in range(50) for x in rng.sample("abcd", rng.randint(1, 4))], "item long, label string, w double").cache()
    for kind in ("mix", "set"):
        want, got = ({(r.a, r.b): round(r.raw, 9) for r in blocks.pairwise(labels, "w", kind, size=size).collect()} for size in (256, 4))
        assert got == want and len(got) == 50 * 49 // 2


def test_items_are_sent_to_lots(spark):
    items = spark.range(100).withColumnRenamed("id", "item").withColumn("v", F.array(F.lit(1.0)))
    dealt = blocks._lots(items, (F.col("item") % 64).cast("int"), 64)  # 16 lots of 4 blocks
    assert dealt.count() == 100 * 16
    made = blocks.pairwise(items.select("item", F.lit("x").alias("label"), F.lit(1.0).alias("w")), "w", "mix", size=1)
    assert "block" in made._jdf.queryExecution().optimizedPlan().toString()


def test_least_of_each_row():
    rng = np.random.default_rng(3)
    for shape in ((7, 3), (9, 40), (1, 1), (0, 4)):
        d = rng.integers(0, 6, shape).astype(float)
        d[rng.random(shape) < 0.3] = np.inf
        for k in (1, 4, 50):
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            want = [(i, int(j)) for i, js in enumerate(order) for j in js if d[i, j] < np.inf]
            assert list(zip(*(x.tolist() for x in blocks._least(d, k)))) == want
