"""What a record shows, on small cases."""

from pyspark.sql import functions as F

from shotlattice.operators import shown


def test_parts_in_frame(spark):
    box = F.struct(F.lit(-50).alias("x1"), F.lit(400).alias("y1"), F.lit(100).alias("x2"), F.lit(600).alias("y2"))
    at = lambda x, y, v: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(v).alias("v"))
    points = F.array(at(0.0, 0.0, 0.91236), at(1.0, 0.5, 0.4), at(0.5, 1.0, 0.8), at(-0.1, 0.5, 0.7), F.lit(None).cast("struct<x:double,y:double,v:double>"))
    got = spark.range(1).select(shown.parts_seen(points, box, F.lit(640), F.lit(480), ((0, 1), (1,), (2,), (3, 4), (9,))).alias("p")).first().p
    assert got == [0.912, 0.4, 0.0, 0.0, 0.0]  # cut at the frame: the box ends at x 100 and y 480, where nothing is in the frame any more


def test_samples_gaze_and_sizes(spark):
    n = lambda x: F.lit(x).cast("long")
    none = F.lit(None).cast("long")
    attributes = F.array(F.struct(n(3).alias("n")), F.struct(n(8).alias("n")))
    r = spark.range(1).select(
        shown.sample_counts([n(4), none], attributes, none, n(2)).alias("all"), shown.sample_counts([none], F.array().cast("array<struct<n:long>>"), none, none).alias("no"),
        F.array(*[shown.head_size(F.lit(10), F.lit(10 + h)) for h in (0, 59, 60, 239, 240, 900)]).alias("heads"), shown.head_size(F.lit(1), F.lit(None).cast("int")).alias("head"), F.array(*[shown.rounded(F.lit(x)) for x in (0.123456, float("nan"))]).alias("d"),
    ).first()
    assert r["all"] == [4, 8, 2] and r.no == [] and r["heads"] == ["under 60 px", "under 60 px", "60-120 px", "120-240 px", "240 px and up", "240 px and up"] and r["head"] is None and r.d == [0.1235, None]
    gaze = "struct<in_frame_share:double,in_frame:struct<mean:double,sd:double,median:double,n:long>,n:long>"
    rows = spark.createDataFrame([(1, (0.5, (0.7, 0.1, 0.6, 3), 6)), (2, (0.0, (None, None, None, 0), 4)), (3, None)], f"id int, g {gaze}")
    got = {x.id: x.g for x in rows.select("id", shown.gaze(F.col("g")).alias("g")).collect()}
    assert got[1].in_frame.mean == 0.7 and got[2].in_frame is None and got[2].n == 4 and got[3] is None


def test_labels_stay_whole(spark):
    labels = spark.createDataFrame([("v", 1, "a"), ("v", 1, "b"), ("v", 2, "c")], "video string, segment int, label string")
    values = spark.createDataFrame([("v", 1, 0.5), ("w", 2, 0.7)], "video string, segment int, x double")
    animals = spark.createDataFrame([("v", 2), ("v", 2)], "video string, segment int")
    got = sorted((r.label, r.outdoor, r.animal) for r in shown.labelled_values(labels, "video", "segment", {"f": (values, {"outdoor": F.col("x")})}, {"animal": animals}).collect())
    assert got == [("a", 0.5, 0.0), ("b", 0.5, 0.0), ("c", None, 1.0)]


def phrase(spark, *values):
    names = "most int, peopled double, duration double, mutual boolean, some boolean, addressing int"
    return spark.createDataFrame([values], names).select(shown.people_phrase(*[F.col(n.split()[0]) for n in names.split(", ")])).first()[0]


def test_people_phrases(spark):
    assert phrase(spark, 0, 0.0, 9.0, True, True, 3) == "none" and phrase(spark, None, None, None, None, None, None) == "none"
    assert phrase(spark, 1, 4.0, 9.0, False, False, 0) == "one at a time, on screen for part of the video"
    assert phrase(spark, 3, 4.5, 9.0, True, True, 1) == "up to 3 visible at once, on screen for most of the video; some look at each other; one looks into the camera"
    assert phrase(spark, 2, 9.0, 9.0, False, True, 2) == "up to 2 visible at once, on screen for most of the video; some look at others; some look into the camera"


def test_lines_of_an_item_without_anything(spark):
    segments = spark.createDataFrame([("v", 2.0, 0, False)], "video string, seconds double, most int, peopled boolean")
    none = spark.createDataFrame([], "video string, label string, w double")
    looking = spark.createDataFrame([], "video string, mutual boolean, some boolean")
    cameras = spark.createDataFrame([], "video string, addressing int")
    lines = shown.hint_lines(segments, "video", {k: none for k in ("tags", "regions", "objects", "animals")}, looking, cameras, none, none).first().hints
    assert lines.split("\n") == ["Medium: unknown", "Scene tags: none", "Main regions: none", "Objects detected: none", "Animals: none", "People: none", "Camera movement: unknown"]
    side = "array<struct<segment:int,hits:long,n:long>>"
    relations = spark.createDataFrame([("v", [(0, 3, 3), (1, 0, 9)], [(0, 1, 2)]), ("v", [(0, 1, 5)], []), ("w", [(0, 3, 3)], [(1, 4, 5)])], f"video string, a_to_b {side}, b_to_a {side}")
    assert {r.video: (r.mutual, r.some) for r in shown.looks(relations, "video", 0.5, 3).collect()} == {"v": (False, True), "w": (True, True)}
