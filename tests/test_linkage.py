"""Groupings by order of merges against matrices of whole groups, with blocks so small that a group lies in many."""

import numpy as np
import pytest

from shotlattice.operators import entity as E, identity as I, linkage as L

rng = np.random.default_rng(11)
CENTRES = rng.normal(size=(12, 6))
VECTORS = [CENTRES[i % 12] + rng.normal(size=6) * 0.45 for i in range(90)]
VECTORS[7] = VECTORS[31]


def units(vectors):
    m = np.array(vectors, float)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def linked(ids, floor):
    m = units([VECTORS[i] for i in ids])
    sim = m @ m.T
    i, j = np.triu_indices(len(ids), 1)
    of = np.arange(len(ids))
    for k in sorted(np.flatnonzero(sim[i, j] >= floor), key=lambda k: (-round(sim[i[k], j[k]], 12), i[k], j[k])):
        x, y = of[i[k]], of[j[k]]
        if x != y and (sim[np.ix_(of == x, of == y)] >= floor).all():
            of[(of == x) | (of == y)] = min(x, y)
    return {ids[k]: ids[of[k]] for k in range(len(ids))}


def neighbours(ids, tight):
    m, of = units([VECTORS[i] for i in ids]), np.arange(len(ids))
    while True:
        names = np.unique(of)
        means = units([m[of == c].mean(axis=0) for c in names])
        d = np.round(1 - means @ means.T, 12)
        np.fill_diagonal(d, np.inf)
        if len(names) < 2 or d.min() > tight:
            return {ids[k]: ids[of[k]] for k in range(len(ids))}
        to = {int(c): int(c) for c in names}
        for i, j in enumerate(d.argmin(axis=1)):
            if d[i, j] <= tight:
                x, y = to[int(names[i])], to[int(names[j])]
                to = {k: min(x, y) if v in (x, y) else v for k, v in to.items()}
        of = np.array([to[int(c)] for c in of])


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i % 2 if i % 9 else None, i, VECTORS[i].tolist()) for i in range(90)], "k long, i long, v array<double>").cache()


def groups(of):
    return {k: [i for i in range(90) if (i % 2 if i % 9 else None) == k] for k in of}


@pytest.mark.parametrize("size", [7, 1000])
def test_complete_linkage_in_tiles(spark, df, size):
    got = {r.i: r.cluster for r in E.complete_linkage(df, "k", "i", "v", 0.7, size).collect()}
    want = {}
    for ids in groups((0, 1, None)).values():
        want |= linked(ids, 0.7)
    assert got == want and len(set(want.values())) < 60


@pytest.mark.parametrize("size", [7, 1000])
def test_first_neighbours_in_tiles(spark, df, size):
    got = {r.i: r.cluster for r in E.first_neighbours(df, "k", "i", "v", 0.2, size=size).collect()}
    want = {}
    for ids in groups((0, 1, None)).values():
        want |= neighbours(ids, 0.2)
    assert got == want and len(set(want.values())) < 60


def test_identities_do_not_depend_on_blocks(spark):
    rows = [("v", i % 5, i, [i % 5 * 100 + i % 11], None if i % 4 == 0 else units([VECTORS[i][:4]])[0].tolist(), None if i % 8 == 0 else units([VECTORS[i]])[0].tolist()) for i in range(90)]
    t = spark.createDataFrame(rows, "video string, segment int, id int, frames array<int>, face array<double>, body array<double>")
    one, many = ({r.id: (r.person, r.abstained) for r in I.resolve(t, "video", "segment", "id", "frames", "face", "body", floors=(0.7, 0.7, 0.8, 0.8), size=s).collect()} for s in (1000, 6))
    assert one == many and len(one) == 90 and len({p for p, _ in one.values()}) < 80 and sum(a for _, a in one.values()) == 12


def test_no_task_holds_a_group(spark, df):
    """A tile holds two blocks, however large a group is."""
    sizes = [r["count"] for r in L.tiles(df.withColumnRenamed("i", "id"), None, ["k"], "id", 7).groupBy("k", "i", "j").count().collect()]
    assert max(sizes) < 30 and len(sizes) > 40


def test_pairs_and_two_nearest_in_tiles(spark, df):
    m = units(VECTORS)
    by = groups((0, 1))
    want = {(a, b): float(m[a] @ m[b]) for ids in by.values() for a in ids for b in ids if a < b}
    got = {(r.a, r.b): r.cosine for r in E.cosine_pairs(df, ["k"], "i", "v", 7).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    rows = spark.createDataFrame([(i % 2, i, m[i].tolist()) for i in range(90)], "k int, i int, v array<double>")
    two = {r.i: (r["first"], r["second"]) for r in I.two_nearest(rows, ["k"], "i", "v", 7).collect()}
    for i in range(90):
        assert two[i] == pytest.approx(sorted(1 - float(m[i] @ m[o]) for o in range(90) if o != i and (o - i) % 2 == 0)[:2], abs=1e-9)


@pytest.mark.parametrize("name", ["back_assigned", "link_threshold"])
def test_vectors_are_not_joined(spark, name):
    from shotlattice.plans import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner" in line and (" < " in line or "NOT (" in line)]
