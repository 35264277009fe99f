"""Nearest vectors in tiles against all pairs, with ties, missing vectors and blocks so small that a group lies in many."""

import random

import numpy as np

from shotlattice.operators import entity as E
from shotlattice.plans import catalogue


def test_nearest_of_every_row(spark):
    rng = random.Random(8)
    rows = [(i, i % 3 if i % 11 else None, None if i % 13 == 0 else [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    unit = {i: None if v is None or not np.linalg.norm(v) else np.array(v) / np.linalg.norm(v) for i, _, v in rows}

    def best(i, others, top):
        dots = [(None if unit[i] is None or unit[o] is None else round(float(unit[i] @ unit[o]), 9), o) for o in others]
        return [o for _, o in sorted(dots, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:top]]

    got = {}
    for r in E.nearest_cosine(df, ["g"], "id", "v", 4, size=6).orderBy("a", "rank").collect():
        got.setdefault(r.a, []).append(r.b)
    assert got == {i: best(i, [o for o, h, _ in rows if h == g and o != i], 4) for i, g, _ in rows if g is not None}
    far = {r.a: r.b for r in E.nearest_cosine(df, [], "id", "v", 1, 1, 6).collect()}
    assert far == {i: best(i, [o for o, *_ in rows if abs(o - i) > 1], 1)[0] for i, *_ in rows}


def test_queries_write_no_pairs(spark):
    for name in ("cosine_topk", "scene_consistency"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "zip_with" not in plan
