"""The terminal record on a small item: every section, empty tables, and one exchange a table."""

import json

from pyspark.sql import functions as F

from shotlattice.operators import kits, terminal
from shotlattice.plans import catalogue

COLUMNS = {
    "segments": "segment int, start long, end long, seconds double, frames long, visible int, followed int, tracked boolean, medium string, movement string, person_ids array<int>", "keyframes": "segment int, start long, end long", "visuals": "segment int, field string, mean double, sd double, n long",
    "objects": "segment int, label string, share double", "texts": "segment int, text string, n long", "persons": "person_id int, first_frame long, last_frame long, seconds double, series long, samples long, abstained boolean", "by_segment": "person_id int, segment int, seconds double",
    "traits": "person_id int, trait string, label string, share double, n long", "measures": "person_id int, measure string, mean double, sd double, median double, n long", "relations": "a int, b int, ab_share double, ba_share double, synchrony long, mutual boolean", "subjects": "label string, seconds double, segments array<int>", "tags": "label string, share double",
}
ROWS = {
    "segments": [("v", 1, 48, 95, 2.0, 48, 3, 1, True, None, "pan", [7]), ("v", 0, 0, 47, 4.0, 48, 1, 1, True, "film", "static", [7]), ("w", 0, 0, 23, 1.0, 24, 0, 0, False, None, None, [])],
    "keyframes": [("v", 0, 24, 47), ("v", 0, 0, 23), ("v", 1, 48, 95)], "visuals": [("v", 0, "warmth", 2.0, 0.1, 3), ("v", 1, "warmth", 5.0, None, 1), ("v", 1, "chroma", None, None, 0)],
    "objects": [("v", 0, "chair", 0.5)], "texts": [("v", 0, "exit", 2), ("v", 1, "exit", 1)], "persons": [("v", 7, 0, 95, 6.0, 9, 4, False), ("v", 8, 0, 9, 0.5, 1, 1, False), ("v", 9, 0, 1, 0.1, 0, 0, True)],
    "by_segment": [("v", 7, 0, 4.0), ("v", 7, 1, 2.0)], "traits": [("v", 7, "emotion", "calm", 0.5, 4), ("v", 7, "emotion", "angry", 0.5, 4), ("v", 8, "gender", "female", 0.9, 1)],
    "measures": [("v", 7, "valence", 0.25, 0.1, 0.2, 4)], "relations": [("v", 7, 8, 0.9, None, None, False), ("v", 7, 9, 0.1, 0.2, 3, True), ("v", 8, 9, 0.4, 0.4, 2, False)], "subjects": [("v", "cat", 3.0, [0])], "tags": [("v", "sea", 0.4)],
}


def tables_of(spark, rows):
    return terminal.Tables(**{n: spark.createDataFrame(rows.get(n, []), f"video string, {s}") for n, s in COLUMNS.items()})


def test_every_section(spark):
    got = {r.video: r.asDict(True) for r in terminal.terminal(tables_of(spark, ROWS), "video").collect()}
    v, w = got["v"], got["w"]
    assert v["summary"] == {
        "duration_s": 6.0, "frames": 96, "fps": 16.0, "segments": 2, "subjects": 1, "persons": {"resolved": 3, "described": 1, "glimpsed": 1, "tracked_only": 1, "abstained": 1, "thin": 2}, "relations": {"co_present": 3, "with_evidence": 2, "mutual": 1}, "text": {"readings": 3, "distinct": 2},
    }
    assert [s["segment"] for s in v["timeline"]["segments"]] == [0, 1] and v["timeline"]["rhythm"] == {"shots": 2, "mean_s": 3.0, "min_s": 2.0, "max_s": 4.0, "shots_per_minute": 20.0}
    assert v["plastic"]["video"]["visuals"] == {"warmth": {"mean": 3.0, "n": 2}, "chroma": {"mean": None, "n": 0}} and v["plastic"]["video"]["medium"] == {"film": 1.0}
    assert [(k["start"], k["end"]) for k in v["plastic"]["segments"][0]["keyframes"]] == [(0, 23), (24, 47)]
    seven, eight = v["figurative"]["persons"]
    assert (seven["person_id"], seven["status"], seven["emotion"]["modal"], seven["emotion"]["distribution"], seven["gender"]) == (7, "described", "angry", {"angry": 0.5, "calm": 0.5}, None)
    assert seven["valence"] == {"mean": 0.25, "sd": 0.1, "median": 0.2, "n": 4} and seven["arousal"] is None and [s["segment"] for s in seven["by_segment"]] == [0, 1]
    assert (eight["status"], eight["gender"]["modal"], eight["by_segment"]) == ("glimpsed", "female", []) and v["figurative"]["tracked_only"] == [9]
    assert [s["crowdedness"] for s in v["figurative"]["segments"]] == ["single", "group"] and [s["assessment"] for s in v["enunciative"]["segments"]] == ["consistent", "under_tracked"]
    assert [(r["a"], r["b"]) for r in v["enunciative"]["relations"]] == [(7, 8), (7, 9)] and v["enunciative"]["camera"] == {"pan": 2 / 6, "static": 4 / 6}
    assert v["gaps"] == {"abstained": [9], "thin": [8, 9], "glimpsed": [8], "segments_without_tracks": [], "under_tracked_segments": [1]} and w["gaps"]["segments_without_tracks"] == [0]
    assert w["summary"]["persons"]["resolved"] == 0 and w["figurative"]["persons"] == [] and w["enunciative"]["camera"] == {} and w["plastic"]["segments"][0]["keyframes"] == []


def test_readers_and_budget(spark):
    df = terminal.terminal(tables_of(spark, ROWS), "video").where("video = 'v'")
    r = df.select("budget", F.to_json(F.struct(*[x for x in df.columns if x != "budget"])).alias("json"), kits.people_time().alias("people"), kits.affect("valence").alias("valence"), kits.camera().alias("camera"), kits.single().alias("single")).first()
    assert (r.people, r.valence, r.single) == (1.0, 0.25, 4 / 6) and r.camera == {"pan": 2 / 6, "static": 4 / 6}
    assert r.budget.record_bytes == len(r.json.encode()) and json.loads(r.json)["video"] == "v"
    strip = lambda n: [x.strip().split()[0] for x in COLUMNS[n].replace("array<int>", "a").split(",")]
    size = sum(len(json.dumps({k: x for k, x in zip(strip(n), row[1:]) if x is not None}, separators=(",", ":"))) for n, rows in ROWS.items() for row in rows if row[0] == "v")
    assert r.budget.inputs_bytes == size and abs(r.budget.reduction - (1 - len(r.json) / size)) < 1e-12


def test_one_exchange_a_table_and_empty_tables(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = terminal.terminal(tables_of(spark, ROWS), "video")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == len(COLUMNS)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert terminal.terminal(tables_of(spark, {}), "video").count() == 0
    alone = terminal.terminal(tables_of(spark, {"segments": ROWS["segments"][:1]}), "video").first()
    assert alone.summary.segments == 1 and alone.enunciative.relations == [] and alone.plastic.video.visuals == {}


def test_events_and_persons_are_taken_apart_once(spark):
    plan = catalogue.queries()["terminal_readback"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan  # in the stored events, not in each table
    assert plan.count("THEN glimpsed") == 1  # the status of a person, which several readers need
