"""Points in boxes, near texts and fits of motions: what a task holds, and results against plain Python."""

import difflib
import random

import pandas as pd
import pytest

from shotlattice.operators import entity as E, media as M
from shotlattice.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [9, 10_000])
def test_smallest_boxes_in_tiles(spark, size):
    rng = random.Random(3)
    points = [(i % 3 or None, i, float(rng.randint(0, 20)), float(rng.randint(0, 20))) for i in range(80)]
    boxes = [(i % 3 or None, 500 - i, (float(x := rng.randint(0, 15)), float(y := rng.randint(0, 15)), float(x + rng.randint(-1, 6)), float(y + rng.randint(0, 6)))) for i in range(120)]
    want = {}
    for g, i, x, y in points:
        held = [((max(b[2] - b[0], 0) * max(b[3] - b[1], 0)), o) for h, o, b in boxes if g is not None and g == h and b[0] <= x <= b[2] and b[1] <= y <= b[3]]
        if held:
            want[i] = min(held)[1]
    p = spark.createDataFrame(points, "g int, id long, x double, y double")
    b = spark.createDataFrame(boxes, "g int, id long, box struct<x1: double, y1: double, x2: double, y2: double>")
    assert {r.id: r.holder for r in M.smallest_holder(p, b, ["g"], "x", "y", size).collect()} == want


def test_points_and_boxes_are_not_joined(spark):
    plan = catalogue.queries()["smallest_holder"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner" in line and " <= " in line]


def test_likeness_is_measured_where_it_can_matter(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd ") for _ in range(40)) for _ in range(6)]
    rows = [(i % 2, t if rng.random() < 0.5 else t[:20] + "zz" + t[22 + rng.randint(0, 12) :], i) for i, t in enumerate(rng.choice(texts) for _ in range(60))]
    want = []
    for k in (0, 1):
        counts = pd.Series([t for g, t, _ in rows if g == k]).value_counts()
        groups = []
        for t, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            likes = [(difflib.SequenceMatcher(None, g[0], t).ratio(), -i) for i, g in enumerate(groups)]
            best = max(likes, default=(0, 0))
            if best[0] >= 0.8:
                groups[-best[1]][1] += n
            else:
                groups.append([t, n])
        want += [(k, t, n) for t, n in groups]
    found = E.group_texts(spark.createDataFrame(rows, "k long, t string, a long"), ["k"], "t", "a")
    assert sorted((r.k, r.text, r.n) for r in found.collect()) == sorted(want)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_points_cross_as_numbers(spark):
    plan = catalogue.queries()["fitted_motions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "motions(points" not in plan
