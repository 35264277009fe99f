"""Archives of arrays and memos: what is read, what is computed, and what a run that ends half-way leaves."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlattice.operators import entity
from shotlattice.sources import archives, stored

ROWS = [("a", "one", [2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("a", "two", [0], []), ("b", "one", [1], [None]), ("c", "one", [2], [7.0, 8.0]), ("c", "two", [1], [9.0])]


def test_archives_round_trip(spark, tmp_path):
    at = str(tmp_path / "arrays")
    df = spark.createDataFrame(ROWS, archives.SCHEMA)
    archives.write_archives(df, at)
    assert sorted(os.listdir(at)) == ["a.npz", "b.npz", "c.npz"]
    with np.load(f"{at}/a.npz") as a:
        assert a["one"].tolist() == [[1, 2, 3], [4, 5, 6]] and a["two"].shape == (0,)
    got = {(r.item, r.array): (r["shape"], r["values"]) for r in archives.read_archives(spark, at).collect()}
    assert got.keys() == {r[:2] for r in ROWS} and got["a", "one"] == ROWS[0][2:] and got["a", "two"] == ([0], []) and np.isnan(got["b", "one"][1][0])
    assert archives.read_archives(spark, at, taskBytes="1").rdd.getNumPartitions() == 3
    archives.write_archives(df.where("item = 'c'").withColumn("item", F.lit("d")), at)
    assert archives.read_archives(spark, at).select("item").distinct().count() == 4
    archives.write_archives(df.where("item = 'c'"), at, "overwrite")
    assert sorted(os.listdir(at)) == ["c.npz"]


def test_archives_that_are_not_asked_for_are_not_opened(spark, tmp_path):
    at = str(tmp_path / "arrays")
    archives.write_archives(spark.createDataFrame(ROWS, archives.SCHEMA), at)
    (tmp_path / "arrays" / "broken.npz").write_bytes(b"no archive")
    asked = archives.read_archives(spark, at).where("item in ('a', 'c') and array = 'two'")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")  # the source has taken both filters
    assert sorted((r.item, r.array) for r in asked.collect()) == [("a", "two"), ("c", "two")]
    with pytest.raises(Exception):
        archives.read_archives(spark, at).collect()
    assert archives.read_archives(spark, at).where("item = 'a' and item = 'c'").count() == 0
    assert archives.read_archives(spark, str(tmp_path / "nothing")).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "arrays")
    bad = spark.createDataFrame([("a", "one", [2], [1.0, 2.0]), ("b", "one", [3], [1.0])], archives.SCHEMA)  # the second has no such shape
    with pytest.raises(Exception):
        archives.write_archives(bad, at)
    assert [n for n in os.listdir(at) if n.endswith(".npz")] == []


def test_memos_compute_what_is_missing_and_drop_what_is_not_wanted(spark, tmp_path):
    asked = []

    def compute(keys):
        rows = keys.collect()
        asked.extend(r.k for r in rows)
        return spark.createDataFrame([(r.k, (r.k or 0) * 10) for r in rows if r.k != 5], "k long, v long")

    wanted = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    memo = stored.Memo(spark, str(tmp_path / "memo"), ["k"], "k long, v long")
    assert memo.read().count() == 0 and memo.version() == 0
    values = lambda df: sorted(((r.k is None, r.k or 0), r.v) for r in df.collect())
    assert [v for _, v in values(memo.refresh(wanted(1, 2, 2, None, 5), compute, lots=3))] == [10, 20, 0]
    assert len(asked) == 4
    old = memo.read()
    asked.clear()
    assert [v for _, v in values(memo.refresh(wanted(2, 3, 5), compute, lots=3))] == [20, 30]
    assert sorted(asked) == [3, 5] and memo.version() == 2 and old.count() == 3  # who reads the old version still can


def test_a_refresh_that_is_killed_goes_on(spark, tmp_path):
    asked, fail = [], [True]

    def compute(keys):
        rows = [r.k for r in keys.collect()]
        if fail[0] and len(asked) > 8:
            raise KeyboardInterrupt
        asked.extend(rows)
        return spark.createDataFrame([(k, k * k) for k in rows], "k long, v long")

    wanted = spark.range(40).withColumnRenamed("id", "k")
    at = str(tmp_path / "memo")
    with pytest.raises(KeyboardInterrupt):
        stored.Memo(spark, at, ["k"], "k long, v long").refresh(wanted, compute, lots=8)
    begun = len(asked)
    assert 0 < begun < 40 and stored.Memo(spark, at, ["k"], "k long, v long").version() == 0  # nothing counts before all is there
    fail[0] = False
    got = stored.Memo(spark, at, ["k"], "k long, v long").refresh(wanted, compute, lots=8)
    assert sorted((r.k, r.v) for r in got.collect()) == [(k, k * k) for k in range(40)] and sorted(asked) == list(range(40))


def plain_keyframes(rows, spans, same):
    """Chosen places of one item's (vector, sharpness) rows."""
    n = len(rows)
    edges = np.linspace(0, n, min(spans, n) + 1).astype(int)
    chosen = []
    for a, b in zip(edges[:-1], edges[1:]):
        mean = np.mean([rows[i][0] for i in range(a, b)], axis=0)
        order = sorted(range(a, b), key=lambda i: -float(rows[i][0] @ mean))
        pool = sorted(order[: max(1, round((b - a) * 0.25))], key=lambda i: -rows[i][1])
        chosen += next(([i] for i in [*pool, *order] if all(float(rows[i][0] @ rows[c][0]) < same for c in chosen)), [])
    return chosen or [0]


@pytest.mark.parametrize("length, spans", [(5, 1), (10, 2), (6, 1), (13, 3), (1, 4), (20, 2)])
def test_keyframes_of_spans_of_any_size(spark, length, spans):
    rng = np.random.default_rng(length)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [(unit(np.array([1.0, 0, 0]) + rng.normal(size=3) * 0.15), float(rng.random())) for _ in range(length)]
    df = spark.createDataFrame([(1, i, v.tolist(), s) for i, (v, s) in enumerate(rows)], "video long, at long, v array<double>, sharp double")
    got = [r.at for r in entity.pick_keyframes(df, "video", "at", "v", "sharp", spans).orderBy("place").collect()]
    assert got == plain_keyframes(rows, spans, 0.98)


def test_a_span_whose_pool_repeats_goes_on_through_the_rest(spark):
    """The second span's typical frames are all the like of the first keyframe; its odd frame is taken."""
    alike, odd = [1.0, 0.0], [0.6, 0.8]
    rows = [(1, i, alike, 1.0) for i in range(4)] + [(1, 4 + i, alike, 1.0) for i in range(7)] + [(1, 11, odd, 0.1)]
    df = spark.createDataFrame(rows, "video long, at long, v array<double>, sharp double")
    assert [r.at for r in entity.pick_keyframes(df, "video", "at", "v", "sharp", 2).orderBy("place").collect()] == [0, 11]
    assert [r.at for r in entity.pick_keyframes(df.where("at < 11"), "video", "at", "v", "sharp", 2).collect()] == [0]


@pytest.mark.parametrize("parts", [1, 4, 211])
def test_places_equal_a_sequential_count(spark, parts):
    import random

    from shotlattice.operators import numbering

    rng = random.Random(parts)
    rows = [(i, rng.randint(0, 40), rng.choice([True, False, None]), rng.random() < 0.1) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, frame long, face boolean, body boolean").repartition(7)
    got = {r.id: (r.face_place, r.body_place) for r in numbering.reserved(df, ["frame", "id"], {"face": F.col("face"), "body": F.col("body")}, parts).collect()}
    want, n = {}, [0, 0]
    for i, _, *asks in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = tuple(n[k] if a else None for k, a in enumerate(asks))
        n = [x + bool(a) for x, a in zip(n, asks)]
    assert got == want


def test_places_of_nothing(spark):
    from shotlattice.operators import numbering

    none = spark.createDataFrame([], "id long, face boolean")
    assert numbering.reserved(none, ["id"], {"face": F.col("face")}).columns == ["id", "face", "face_place"]
