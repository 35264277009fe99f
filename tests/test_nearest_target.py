"""The nearest other point within a limit against all pairs, with ties, equal points, missing values and dense heaps."""

import math
import random

import pytest

from shotlattice.operators import joins as J
from shotlattice.plans import catalogue


def plain(rows, limit):
    out = {}
    for g, e, x, y in rows:
        for h, f, u, v in rows:
            if None not in (g, e, x, y, h, f, u, v) and g == h and e != f:
                d = math.sqrt((x - u) ** 2 + (y - v) ** 2)
                if d <= limit:
                    out[g, e] = min(out.get((g, e), (math.inf, f)), (d, f))
    return {(g, e, f, d) for (g, e), (d, f) in out.items()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest_target_is_that_of_all_pairs(spark, kind):
    rng = random.Random(6)
    name = str if kind == "string" else int
    rows = [(g, name(e), rng.choice([None, 0.0, rng.uniform(-30, 30)]), float(rng.randint(-9, 9))) for g in (1, 2, None) for e in range(60)]
    rows += [(3, name(e), 5.0 + e * 1e-7, 5.0 + (e % 7) * 1e-7) for e in range(150)]  # a heap, with equal steps between points
    rows += [(3, name(200 + e), 15.0 * e, 40.0) for e in range(6)] + [(3, name(300 + e), 100.0 + 10 * e, 0.0) for e in range(4)]  # too far, and at the limit
    rows += [(4, name(e % 5), float(e % 3), 1.0) for e in range(12)] + [(4, None, 1.0, 1.0)]  # several points of one name, many names at one point
    for limit in (10.0, 0.5):
        got = J.nearest_target(spark.createDataFrame(rows, f"g long, e {kind}, x double, y double"), ["g"], "e", "x", "y", limit)
        assert {tuple(r) for r in got.collect()} == plain(rows, limit)
        assert got.count() == len(plain(rows, limit))


def test_no_pairs_of_points_are_joined(spark):
    plan = catalogue.queries()["nearest_target"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "POWER" not in plan
