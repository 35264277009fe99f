"""Operators on hand fixtures with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from shotlattice.functions import bands as B, geometry as G, strings as S, vectors as V
from shotlattice.operators import distance as D, entity as E, joins as J, routing as R, scoring as C, sequences as Q, stats as A
from shotlattice.sources import readers


def one(df):
    (row,) = df.collect()
    return row


def test_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 8.0), ("b", 5.0), ("c", None)], "k string, x double")
    got = {r.k: r for r in A.stats(df, ["k"], "x").collect()}
    assert (got["a"].n, got["a"].mean, got["a"].median, got["a"].mad) == (4, 3.75, 3.0, 1.5)
    assert got["a"].variance == pytest.approx(9.583333333)
    assert got["b"].variance is None and got["b"].mad is None and got["c"].n == 0
    assert A.spread(df.where("k = 'a'"), ["k"], "x").first().spread == pytest.approx(2.2239)


def test_distribution_tie(spark):
    df = spark.createDataFrame([(1, r, lab, 0.5) for r in (1, 2) for lab in "xy"], "k int, r int, l string, p double")
    rows = A.distribution(df, ["k"], "r", "l", "p").collect()
    assert {r.modal for r in rows} == {"x"} and {r.agreement for r in rows} == {1.0}


def test_labelled(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.2), ("b", 0.4), ("c", 0.9)], "l string, s double").withColumn("k", F.lit(1))
    got = [(r.l, r.n, round(r.score, 6)) for r in A.labelled(df, ["k"], "l", "s", 2).orderBy("rank").collect()]
    assert got == [("b", 2, 0.3), ("a", 1, 0.9)]


def test_weighted(spark):
    df = spark.createDataFrame([(1, 0.2, 5.0), (1, 0.8, 0.3), (2, 0.5, 1.0)], "k int, x double, w double")
    got = {r.k: r for r in A.weighted(df, ["k"], "x", "w").collect()}
    assert got[1].mean == pytest.approx(0.233962264) and got[1].sd == pytest.approx(0.138650363) and got[2].sd is None


def test_transitions(spark):
    df = spark.createDataFrame([(1, 0.0, "x", 0.2), (1, 0.2, "x", 0.3), (1, 0.5, "y", 0.5), (2, 0.0, "x", 1.0)], "v int, t double, s string, w double")
    got = {r.change: r.share for r in Q.transitions(df, ["v"], ["t"], "s", "w").collect()}
    assert got["x > x"] == pytest.approx(0.384615385) and got["x > y"] == pytest.approx(0.615384615) and len(got) == 2


def test_flat_step(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate((1.0, 1.0, 1.4, 0.4))], "v int, t int, x double")
    assert one(Q.flat_step(df, ["v"], ["t"], "x")).flat == pytest.approx(0.35)
    assert one(Q.flat_step(df.where("t < 2"), ["v"], ["t"], "x")).flat == 0


def test_islands_and_ranges(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 5, 9), (1, 11, 12)], "k int, s int, e int")
    assert [r.island for r in Q.islands(df, ["k"], "s", "e").orderBy("s").collect()] == [0, 0, 0, 1]
    df = spark.createDataFrame([(1, 0, 5, 8), (1, 4, 20, 8), (2, 30, 40, 8)], "k long, s long, e long, n long")
    assert sorted((r.k, r.s, r.e) for r in Q.normalise_ranges(df, ["k"], "s", "e", "n").collect()) == [(1, 0, 3), (1, 4, 7), (2, 0, 7)]


def test_interpolate(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 2, 4.0), (1, 10, 5.0)], "k int, f long, x double")
    got = [(r.f, r.x, r.interpolated) for r in Q.interpolate(df, ["k"], "f", ["x"], 3).orderBy("f").collect()]
    assert got == [(0, 0.0, False), (1, 2.0, True), (2, 4.0, False), (10, 5.0, False)]


def test_geometry(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 15, 15)], "a int, b int, c int, d int, e int, f int, g int, h int")
    x, y = G.box(*(F.col(c) for c in "abcd")), G.box(*(F.col(c) for c in "efgh"))
    r = one(df.select(G.iou(x, y).alias("iou"), G.area(x).alias("area"), G.overlaps(x, y).alias("over"), G.interval_iou(F.lit(0), F.lit(9), F.lit(5), F.lit(14)).alias("line"), G.euler(F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])).alias("e")))
    assert r.iou == pytest.approx(25 / 175) and r.area == 100 and r.over and r.line == pytest.approx(5 / 15)
    assert tuple(abs(v) for v in r.e) == (0.0, 0.0, 0.0)


def test_bands_and_strings(spark):
    df = spark.createDataFrame([(0, "Big men, and dogs! Then."), (1, ""), (4, None)], "n int, t string")
    rows = df.select(B.crowd(F.col("n")).alias("c"), S.first_sentence(F.col("t")).alias("s"), S.vocabulary_match(F.col("t"), ["dog", "big men", "men"]).alias("v"), S.names_any(F.col("t"), ["man"]).alias("p")).collect()
    assert [r.c for r in rows] == ["none", "single", "group"]
    assert rows[0].s == "Big men, and dogs!" and rows[0].v == ["big men", "dog"] and rows[0].p and not rows[1].p
    assert one(spark.range(1).select(S.shared_prefix(F.lit("ab-cd1"), F.lit("ab-cd2")).alias("x"))).x == "ab-"


def test_distances(spark):
    mixes = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.5), (2, "c", 0.5), (3, "a", 0.5), (3, "b", 0.5)], "item int, label string, share double")
    got = {(r.a, r.b): r.raw for r in D.hellinger(mixes).collect()}
    assert got[1, 2] == pytest.approx(math.sqrt(0.5)) and got[1, 3] == pytest.approx(0, abs=1e-8)
    sets = mixes.withColumnRenamed("share", "w")
    assert {(r.a, r.b): round(r.raw, 6) for r in D.weighted_jaccard(sets).collect()}[1, 2] == round(1 - 0.5 / 1.5, 6)
    samples = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 1.0), (2, 2.0, 1.0)], "item int, x double, w double")
    assert 1.4 < one(D.wasserstein(samples, "x", "w")).raw < 1.6
    pairs = spark.createDataFrame([("f", 1, 2, 1.0), ("f", 1, 3, 2.0), ("f", 2, 3, None)], "field string, a int, b int, raw double")
    scale = {(r.a, r.b): r.calibrated for r in D.calibrate_scale(pairs).collect()}
    assert scale[1, 2] == pytest.approx(1 / 1.9) and scale[1, 3] == 1.0 and scale[2, 3] is None
    rank = {(r.a, r.b): r.calibrated for r in D.calibrate_rank(pairs).collect()}
    assert (rank[1, 2], rank[1, 3], rank[2, 3]) == (0.0, 0.5, None)
    lacks = spark.createDataFrame([("f", 3)], "field string, item int")
    imp = {(r.a, r.b): r.imputed for r in D.impute(D.calibrate_scale(pairs), lacks).collect()}
    assert imp[2, 3] == pytest.approx((1 / 1.9 + 1) / 2)


def test_scoring(spark):
    df = spark.createDataFrame([(True, 3.0), (False, 1.0), (True, 1.0), (False, 0.0)], "p boolean, s double").withColumn("k", F.lit(1))
    assert one(C.auc(df, ["k"], "p", "s")).auc == pytest.approx(3.5 / 4)
    assert one(C.average_precision(df, ["k"], "p", "s")).ap == pytest.approx((1 + 2 / 3) / 2)
    same = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "t int, f int")
    r = one(C.cluster_scores(same, "t", "f"))
    assert r.wcp == 1.0 and r.nmi == pytest.approx(1.0)
    ranks = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 9.0)], "k int, x double, y double")
    assert one(C.spearman(ranks, ["k"], "x", "y")).rho == pytest.approx(1.0)


def test_entities(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (1, 3, [0.0, 1.0])], "k long, i long, v array<double>")
    assert [r.cluster for r in E.complete_linkage(v, "k", "i", "v", 0.9).orderBy("i").collect()] == [1, 1, 3]
    assert one(E.mean_unit(v.where("i <> 2"), ["k"], "v")).vector == pytest.approx([math.sqrt(0.5)] * 2)
    t = spark.createDataFrame([(1, "hello world", 1), (1, "hello world", 2), (1, "hello w0rld", 3), (1, "bye", 4)], "k long, t string, a long")
    assert sorted((r.text, r.n, r["first"], r["last"]) for r in E.group_texts(t, ["k"], "t", "a").collect()) == [("bye", 1, 4, 4), ("hello world", 3, 1, 3)]


def test_joins(spark):
    a = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 20, 30)], "k long, id long, start long, end long")
    b = spark.createDataFrame([(1, 7, 1, 10), (1, 8, 0, 9), (1, 9, 40, 50)], "k long, id long, start long, end long")
    assert [(r.a_id, r.b_id) for r in J.mutual_best(a, b, ["k"], 0.5, 4).collect()] == [(1, 7)]
    p = spark.createDataFrame([(1, 5), (1, 99)], "k long, x long")
    assert sorted((r.x, r.id) for r in J.first_span(p, b, ["k"], "x", 4).collect() if r.id) == [(5, 7)]
    t, f = (spark.createDataFrame([(1, x) for x in xs], "k long, x double") for xs in ((0.0, 1.0), (0.9,)))
    assert one(J.greedy_matches(t, f, "k", "x", 1.0)).hits == 1


def test_routing_and_readers(spark, tmp_path):
    seg = spark.createDataFrame([(1, True, 0.4)], "s int, face boolean, face_agreement double")
    got = {r.expert: r.fired for r in R.decisions(R.facts(seg, ["face"], 0.5), ["s"], ["face"]).collect()}
    assert not got["gaze"] and not got["pose"] and got["tags"]
    rows = spark.createDataFrame([("f", 1, "12"), ("f", 2, "1 2 3 4 left"), ("f", 3, "13"), ("f", 4, "5 6 7 8")], "file string, n int, line string")
    assert [(r["head"], r["values"], r["names"]) for r in readers.blocks(rows, "file", "n", "line").orderBy("n").collect()] == [(12, [1, 2, 3, 4], ["left"]), (13, [5, 6, 7, 8], [])]
    with pytest.raises(FileNotFoundError, match="run shots first"):
        readers.artifact(spark, str(tmp_path / "none.json"), "a int", "shots")
    m = readers.Models()
    m.register("double", lambda it: (p.assign(id=p.id * 2) for p in it), "id long")
    assert [r.id for r in m.apply("double", spark.range(3)).orderBy("id").collect()] == [0, 2, 4]


def test_suppression_and_choice(spark):
    df = spark.createDataFrame([(1, [(0.9, 0, 0, 10, 10), (0.8, 1, 1, 10, 10), (0.7, 50, 50, 60, 60)])], "k int, b array<struct<score:double,x1:int,y1:int,x2:int,y2:int>>")
    assert [x.score for x in one(df.select(A.suppressed(F.col("b"), 0.4).alias("b"))).b] == [0.9, 0.7]
    labels = spark.createDataFrame([(1, "day", 1), (1, "night", 2), (1, "city", 3), (1, "sea", 4)], "k int, l string, r int")
    got = one(A.exclusive_top(labels, ["k"], "l", ["r"], [("day", "night")], 2))
    assert got.kept == ["day", "city"] and got.dropped == ["night"]


def test_streaming_counts_match_batch(spark, tmp_path):
    from shotlattice.streaming import windows

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 20) AS ts, id % 2 AS k FROM range(30)")
    rows.write.parquet(str(tmp_path / "in"))
    aggs = {"n": F.count(F.lit(1))}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed(stream, "ts", ["k"], "1 hour", None, "10 minutes", aggs).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.windowed(rows, "ts", ["k"], "1 hour", None, "10 minutes", aggs)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
    assert windows.sessions(rows, "ts", ["k"], "30 minutes", "1 hour", aggs).count() == 30


def test_assignment_is_the_best_of_all():
    import itertools

    import numpy as np

    from shotlattice.operators import assess

    rng = np.random.default_rng(1)
    for n, m in ((3, 3), (2, 4), (4, 2), (5, 5), (1, 1)):
        for _ in range(10):
            g = rng.integers(0, 9, (n, m))
            small = g if n <= m else g.T
            best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
            pairs = assess.best_assignment(g)
            assert len(pairs) == min(n, m) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(n, m)
            assert sum(g[i, j] for i, j in pairs) == best


def test_pixels():
    import numpy as np

    from shotlattice.functions import pixels

    x = np.zeros((8, 8, 3), np.uint8)
    x[:, 4:] = 255
    assert pixels.palette(x)[0][1] == 0.5 and pixels.classical(x)["brightness"] == pytest.approx(0.5) and pixels.classical(x)["symmetry"] == pytest.approx(0.0)
    assert pixels.histograms(x)[0, [0, 15]].tolist() == [0.5, 0.5]
    gray = x[..., 0]
    assert pixels.bars(gray) == 0.5 and pixels.bars(gray * 0) == 1.0 and pixels.sharpness(gray * 0) == 0.0
    assert pixels.normals(np.ones((3, 3)))[1, 1].tolist() == [0.0, 0.0, 1.0]
    assert pixels.masked((2, 2), [(0, 0, 1, 1)]).tolist() == [[False, True], [True, True]]


def test_similarity_is_symmetric_and_zero_on_copies(spark):
    from shotlattice.operators import similarity

    items = spark.createDataFrame([(i,) for i in (1, 2, 3)], "item int")
    labels = spark.createDataFrame([(1, "tags", "a", 1.0), (2, "tags", "a", 1.0), (3, "tags", "b", 1.0)], "item int, field string, label string, w double")
    numbers = spark.createDataFrame([(1, "outdoor", 0.2), (2, "outdoor", 0.2)], "item int, field string, x double")
    s = similarity.Similarity(similarity.Readings(items, labels, numbers))
    d = {(r.a, r.b): r.score for r in s.overall().collect()}
    assert d[1, 2] == 0 and d[1, 3] == d[2, 3] > 0
    assert [(r.item, r.other) for r in s.nearest(1).orderBy("item").collect()] == [(1, 2), (2, 1), (3, 1)]


def test_modal_label_ties_to_twelve_places(spark):
    tenths = [("a", 0.1), ("b", 0.3), ("a", 0.2), ("b", 0.0)]
    rows = [(1, i, label, p) for i, (label, p) in enumerate(tenths)]  # 0.1 + 0.2 is more than 0.3 in the last bit
    flipped = [(2, i, {"a": "b", "b": "a"}[label], p) for i, (label, p) in enumerate(tenths)]
    got = A.distribution(spark.createDataFrame(rows + flipped, "k int, r int, l string, p double"), ["k"], "r", "l", "p")
    assert {(r.k, r.modal) for r in got.collect()} == {(1, "a"), (2, "a")}


def test_tracks_long_gone_cost_nothing(spark):
    import time

    n = 30_000  # each box is alone: as many tracks as boxes
    boxes = spark.range(0, n, 1, 1).selectExpr("1L AS v", "id", "id * 10 AS frame", "0.0 AS x1", "0.0 AS y1", "5.0 AS x2", "5.0 AS y2")
    J.link_tracks(boxes.limit(5), "v").collect()
    start = time.monotonic()
    got = J.link_tracks(boxes, "v").collect()
    assert [r.track for r in sorted(got, key=lambda r: r.id)] == list(range(n))
    assert time.monotonic() - start < 15
