"""Segment records, picks, label maps and reports on small cases."""

import numpy as np
from pyspark.sql import functions as F

from shotlattice.operators import episodes


def test_segment_records(spark):
    shots = spark.createDataFrame([("v", 25, 49), ("v", 0, 24), ("v", 60, 59), ("w", 5, 4)], "video string, start long, end long")
    frames = spark.createDataFrame([("v", 24, 1.26), ("v", 3, 2.0), ("v", 30, None), ("v", 55, 9.0), ("u", 1, 1.0)], "video string, frame long, sharpness double")
    labels = spark.createDataFrame([("v", 0, "cut", "pan")], "video string, index int, intra string, inter string")
    got = {r.video: r for r in episodes.segment_records(shots, frames, "video", F.lit(24.0), labels).collect()}
    v, w = got["v"], got["w"]
    assert (v.shot_count, v.keyframe_count, v.dropped_ranges, v.fps) == (2, 3, 1, 24.0) and (w.shot_count, w.keyframe_count, w.dropped_ranges, w.shots) == (0, 0, 1, [])
    first, second = v.shots
    assert (first["index"], first.start_time, first.end_time, first.intra_label) == (0, 0.0, 1.042, "cut") and (second["index"], second.start_time, second.end_time, second.intra_label) == (1, 1.042, 2.083, None)
    assert [(k.frame, k.time, k.sharpness) for k in first.keyframes] == [(3, 0.125, 2.0), (24, 1.0, 1.3)] and [(k.frame, k.sharpness) for k in second.keyframes] == [(30, None)]
    plain = episodes.segment_records(shots.where("video = 'v'"), frames, "video", F.lit(24.0)).first()
    assert plain.shots[0].intra_label is None


def test_picks_are_spaced_like_numpy(spark):
    rows = [(n, i) for n in range(1, 14) for i in range(n)]
    got = {}
    for r in episodes.even_picks(spark.createDataFrame(rows, "n int, i int"), "n", ["i"], 5).collect():
        got.setdefault(r.n, []).append(r.i)
    assert {n: sorted(v) for n, v in got.items()} == {n: sorted(set(np.linspace(0, n - 1, min(5, n)).round().astype(int).tolist())) for n in range(1, 14)}
    one = episodes.even_picks(spark.createDataFrame(rows, "n int, i int"), "n", ["i"], 1).collect()
    assert {r.i for r in one} == {0}


def test_maps_and_readings(spark):
    names = spark.createDataFrame([(0, "sky"), (2, "sea")], "id int, name string")
    maps = spark.createDataFrame([("a", [0, 0, 2, 0]), ("b", [2]), ("c", []), ("d", None)], "item string, pixels array<int>")
    assert sorted((r.item, r.name, r.share) for r in episodes.map_shares(maps, "item", "pixels", names).collect()) == [("a", "sea", 0.25), ("a", "sky", 0.75), ("b", "sea", 1.0)]

    def plain(w, h):
        width = max(8, round(w * 32 / h))
        n = max(1, round(width / 100))
        cuts = [(round(i * width / n), round((i + 1) * width / n)) for i in range(n)]
        return [c for c in cuts if c[1] - c[0] >= 8]

    sizes = [(5, 40), (100, 32), (250, 32), (150, 32), (1999, 37), (31, 7)]
    got = spark.createDataFrame(sizes, "w int, h int").select("w", "h", episodes.reading_chunks(F.col("w"), F.col("h")).alias("x")).collect()
    assert all([tuple(c) for c in r.x] == plain(r.w, r.h) for r in got)
    r = spark.createDataFrame([([" exit ", "", "  ", "now"], ["a", "other", "b"])], "p array<string>, l array<string>").select(episodes.joined_readings(F.col("p")).alias("p"), episodes.labels_but(F.col("l")).alias("l")).first()
    assert r.p == "exit now" and r.l == ["a", "b"]


def test_persons_and_sizes(spark):
    rows = [("v", 1, 4, 2), ("v", 1, 0, 7), ("v", 1, 0, 7), ("v", None, 0, 1), ("v", 2, 3, 0)]
    got = {r.person: [tuple(t) for t in r.tracks] for r in episodes.person_tracks(spark.createDataFrame(rows, "video string, person int, segment int, track int"), "video", "person", "segment", "track").collect()}
    assert got == {1: [(0, 7), (4, 2)], 2: [(3, 0)]}
    frames = spark.createDataFrame([("v", 0, 100, 400, 0.1), ("v", 1, 50, 50, 0.5), ("v", 2, 1, 1, 0.2)], "video string, at int, w int, h int, bars double")
    assert tuple(episodes.item_shape(frames, "video", "bars", "w", "h", ["at"]).first()) == ("v", 4.0, 0.2)


def test_reports_average_series_not_episodes(spark):
    rows = [("a", "a1", "m", 1.0), ("a", "a2", "m", 3.0), ("b", "b1", "m", 10.0), ("b", "b1", "k", 5.0)]
    got = {r.metric: r for r in episodes.series_report(spark.createDataFrame(rows, "series string, episode string, metric string, value double"), "series", "episode", "metric", "value").collect()}
    assert got["m"].average == 6.0 and got["m"].series == 2 and 1.0 <= got["m"].low <= 6.0 <= got["m"].high <= 10.0 and (got["k"].average, got["k"].low, got["k"].high) == (5.0, 5.0, 5.0)
