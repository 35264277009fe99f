"""Meetings in tiles against plain joins, with blocks so small that pairs lie in all of them."""

import random

import pytest

from shotlattice.operators import joins as J, media as M, meetings


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = [(e, p, rng.choice([None, 1.5, float(rng.randint(-4, 9))]), float(rng.randint(0, 9))) for e in range(24) for p in rng.sample(range(12), rng.randint(0, 9))]
    out += [(30, p, 0.1, 2.0) for p in range(8)] + [(None, 1, 1.0, 1.0), (31, None, 1.0, 1.0)]  # one that never varies, one nobody, one nowhere
    return spark.createDataFrame(out, "e long, p long, v double, k double").cache()


def same(got, want):
    key = lambda r: tuple("~" if x is None else round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(key, got.select(*want.columns).collect()), key=repr) == sorted(map(key, want.collect()), key=repr)


def test_tiles_give_what_joins_by_place_give(spark, rows):
    pairs = J.pairs_at(rows, "e", ["p"], ["v", "k"])
    same(meetings.counts(rows, "e", "p", 5), J.co_presence(rows, "e", ["p"]))
    same(meetings.degrees(rows, "e", "p", 4, 5), M.degrees(J.co_presence(rows, "e", ["p"]), 4))
    same(meetings.placement(rows, "e", "p", "v", "k", "k", 5), J.placement(pairs, "v", "k", "k"))
    looks = pairs.selectExpr("a", "b", "p", "coalesce(abs(a_k - b_k) < 2, false) AS hit")
    want = J.looks_at(looks, "p", 1)
    same(meetings.looks(rows, "e", "p", "k", 2, size=5), want)
    same(meetings.looks(rows, "e", "p", "k", 2, 0.5, 5), want.where("peak_share >= 0.5").select("a", "b"))
    same(meetings.synchrony(rows, "e", "p", "v", 3, 5), J.synchrony(pairs, "v", 3))


def test_no_row_is_made_for_a_pair_and_place(spark):
    n, places = 300, 40
    everywhere = spark.range(n * places).selectExpr("id % 300 AS e", "id div 300 AS p")
    got = meetings.counts(everywhere, "e", "p")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.groupBy("n").count().collect() == [(places, n * (n - 1) // 2)]


def test_queries_of_pairs_join_no_places(spark):
    from shotlattice.plans import catalogue

    for name in ("co_presence", "synchrony", "placement", "looks_at", "relation_evidence", "graph_degrees"):
        assert "Join" not in catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
