"""The terminal record: all that is known of an item as one nested row, assembled from flat tables.

Every table is dealt by item once, into the same number of parts; its rows become ordered lists where they lie, inner lists (keyframes of a segment, traits of a person) first. The joins of the lists, on
the item too, then move nothing. Lists are those of one item. The readers of ``kits`` read the record.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT
from ..functions import bands as B

c = F.col


@dataclass
class Tables:
    """Flat tables; all have the item's column. Columns beside those named pass into the list's structs.

    segments: segment, start, end, seconds, frames, visible (most people at once), followed, tracked, medium, movement, person_ids. keyframes: segment, start, end. visuals: segment, field, mean, sd, n. objects:
    segment, label, share. texts: segment, text, n. persons: person_id, first_frame, last_frame, seconds, series, samples (the most of any one measure), abstained. by_segment: person_id, segment, seconds. traits: person_id, trait, label, share,
    n. measures: person_id, measure, mean, sd, median, n. relations: a, b, ab_share, ba_share, synchrony (null: none was measured), mutual. subjects: label, seconds, segments. tags: label, share.
    """

    segments: DataFrame
    keyframes: DataFrame
    visuals: DataFrame
    objects: DataFrame
    texts: DataFrame
    persons: DataFrame
    by_segment: DataFrame
    traits: DataFrame
    measures: DataFrame
    relations: DataFrame
    subjects: DataFrame
    tags: DataFrame


#: The list that a table's rows are inner lists of, and the order in a list.
_INNER = {"keyframes": "segment", "visuals": "segment", "objects": "segment", "texts": "segment", "by_segment": "person_id", "traits": "person_id", "measures": "person_id"}
_ORDER = {"segments": ["segment"], "keyframes": ["start", "end"], "visuals": ["field"], "objects": ["label"], "texts": ["text"], "persons": ["person_id"], "by_segment": ["segment"], "traits": ["trait", "label"], "measures": ["measure"], "relations": ["a", "b"], "subjects": ["label"], "tags": ["label"]}


def assembled(t: Tables, item: str, parts: int | None = None) -> DataFrame:
    """One row per item with segments: item, a list for each table (inner ones as lists of (key, rows)), ``inputs_bytes``. Items without segments have no record; a table without rows of an item gives an empty list."""
    spark = t.segments.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for f in fields(t):
        name, df = f.name, getattr(t, f.name)
        rest = [x for x in df.columns if x not in (item, *_ORDER[name])]
        row = F.struct(*[x for x in _ORDER[name] if x != _INNER.get(name)], *[x for x in rest if x != _INNER.get(name)])
        dealt = df.repartition(parts, item)
        size = F.sum(F.octet_length(F.to_json(F.struct(*[x for x in df.columns if x != item])))).alias("bytes")
        if name in _INNER:
            key = _INNER[name]
            inner = dealt.groupBy(item, key).agg(F.array_sort(F.collect_list(row)).alias("rows"), size)
            found = inner.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct(key, "rows"))).alias(name), F.sum("bytes").alias(f"bytes_{name}"))
        else:
            found = dealt.groupBy(item).agg(F.array_sort(F.collect_list(row)).alias(name), size.alias(f"bytes_{name}"))
        out = found if out is None else out.join(found, item, "left")
    total = sum((F.coalesce(c(f"bytes_{f.name}"), F.lit(0).cast("long")) for f in fields(t)), F.lit(0).cast("long"))
    kinds = {f.name: out.schema[f.name].dataType.simpleString() for f in fields(t)}
    lists = [c(n) if n in _INNER else F.coalesce(c(n), F.array().cast(k)).alias(n) for n, k in kinds.items()]
    return out.select(item, *lists, total.alias("inputs_bytes"))


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` with columns that are computed once a row however often later expressions use them; a projection would be merged into those, and its columns computed at each use."""
    rest = [x for x in df.columns if x not in made]
    return df.select(*rest, F.explode(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))).alias("made_")).select(*rest, "made_.*")


def _inside(table: str, key: Column) -> Column:
    """The inner rows of a list's element; an empty list if it has none."""
    found = F.try_element_at(c(table), key)
    return F.coalesce(found, F.filter(F.flatten(F.map_values(c(table))), lambda _: F.lit(False)), F.array())


def _sum(xs: Column, value) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + value(x).cast("double"))


def _shares(rows: Column, label, weight, whole: Column) -> Column:
    """label -> its weight over ``whole``; rows without a label are left out."""
    known = F.filter(rows, lambda r: label(r).isNotNull())
    names = F.array_sort(F.array_distinct(F.transform(known, label)))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.try_divide(_sum(F.filter(known, lambda r: label(r) == n), weight), whole))))


def _ids(rows: Column, key: str, holds) -> Column:
    return F.transform(F.filter(rows, lambda r: F.coalesce(holds(r), F.lit(False))), lambda r: r[key])


def terminal(t: Tables, item: str, relation_share: float = DEFAULT.relation_share, relation_minimum: int = DEFAULT.relation_minimum, parts: int | None = None) -> DataFrame:
    """One record an item: summary, timeline, plastic, figurative, enunciative, gaps, budget.

    Persons are described if any measure has two samples or more, glimpsed with one, and only tracked with none; only the first two are listed among the figures. Relations with evidence are those with a look of at least
    ``relation_share`` or ``relation_minimum`` synchronous measures. The budget compares the bytes of the record with those of the tables' rows, both as JSON.
    """
    wide = assembled(t, item, parts)
    duration = _sum(c("segments"), lambda s: s["seconds"])
    size = lambda xs: F.size(xs).cast("long")
    traits = lambda p, name: F.filter(p["traits"], lambda x: x["trait"] == name)
    measured = lambda p, name: F.try_element_at(F.map_from_entries(F.transform(p["measures"], lambda m: F.struct(m["measure"], m.dropFields("measure")))), F.lit(name))

    def trait(p: Column, name: str) -> Column:
        found = traits(p, name)
        modal = F.element_at(F.array_sort(found, lambda a, b: F.when(a["share"] > b["share"], -1).when(a["share"] < b["share"], 1).when(a["label"] < b["label"], -1).otherwise(1)), 1)["label"]
        return F.when(F.size(found) > 0, F.struct(modal.alias("modal"), F.map_from_entries(F.transform(found, lambda x: F.struct(x["label"], x["share"]))).alias("distribution"), F.array_max(F.transform(found, lambda x: x["n"])).alias("n")))

    persons = F.transform("persons", lambda p: p.withField("traits", _inside("traits", p["person_id"])).withField("measures", _inside("measures", p["person_id"])).withField("by_segment", _inside("by_segment", p["person_id"])).withField("status", F.when(p["samples"] > 1, "described").when(p["samples"] == 1, "glimpsed").otherwise("tracked")))
    segments = F.transform("segments", lambda s: s.withField("keyframes", _inside("keyframes", s["segment"])).withField("assessment", B.assess(s["visible"], s["followed"])))
    wide = _once(wide, persons=persons, segments=segments)
    best_look = lambda r: F.greatest(F.coalesce(r["ab_share"], F.lit(0.0)), F.coalesce(r["ba_share"], F.lit(0.0)))
    kept = F.filter("relations", lambda r: (best_look(r) >= relation_share) | (F.coalesce(r["synchrony"], F.lit(0)) >= relation_minimum))
    shown = F.filter("persons", lambda p: p["status"] != "tracked")
    status = lambda x: size(F.filter("persons", lambda p: p["status"] == x))
    texts = F.flatten(F.map_values(F.coalesce(c("texts"), F.map_from_arrays(F.array(), F.array()).cast(wide.schema["texts"].dataType))))
    lengths = F.transform("segments", lambda s: s["seconds"].cast("double"))
    minutes = duration / 60

    pooled = F.flatten(F.transform("segments", lambda s: F.transform(_inside("visuals", s["segment"]), lambda v: F.struct(v["field"].alias("field"), v["mean"].alias("mean"), s["seconds"].cast("double").alias("w")))))
    names = F.array_sort(F.array_distinct(F.transform(pooled, lambda v: v["field"])))
    of = lambda n: F.filter(pooled, lambda v: (v["field"] == n) & v["mean"].isNotNull())
    visuals = F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.struct(F.try_divide(_sum(of(n), lambda v: v["mean"] * v["w"]), _sum(of(n), lambda v: v["w"])).alias("mean"), size(of(n)).alias("n")))))
    medium = _shares(F.filter("segments", lambda s: s["medium"].isNotNull()), lambda s: s["medium"], lambda s: s["seconds"], _sum(F.filter("segments", lambda s: s["medium"].isNotNull()), lambda s: s["seconds"]))

    person = lambda p: F.struct(
        p["person_id"].alias("person_id"), p["status"].alias("status"), p["seconds"].alias("seconds"), p["abstained"].alias("abstained"), trait(p, "gender").alias("gender"), trait(p, "age").alias("age"), trait(p, "emotion").alias("emotion"),
        measured(p, "valence").alias("valence"), measured(p, "arousal").alias("arousal"), measured(p, "movement").alias("movement"), p["by_segment"].alias("by_segment"),
    )
    pick = lambda s, *names: F.struct(*[s[n].alias(n) for n in names])
    sections = {
        "summary": F.struct(
            duration.alias("duration_s"), _sum(c("segments"), lambda s: s["frames"]).cast("long").alias("frames"), F.try_divide(_sum(c("segments"), lambda s: s["frames"]), duration).alias("fps"), size("segments").alias("segments"), size("subjects").alias("subjects"),
            F.struct(size("persons").alias("resolved"), status("described").alias("described"), status("glimpsed").alias("glimpsed"), status("tracked").alias("tracked_only"), size(_ids(c("persons"), "person_id", lambda p: p["abstained"])).alias("abstained"), size(_ids(c("persons"), "person_id", lambda p: p["series"] < 2)).alias("thin")).alias("persons"),
            F.struct(size("relations").alias("co_present"), size(kept).alias("with_evidence"), size(F.filter("relations", lambda r: F.coalesce(r["mutual"], F.lit(False)))).alias("mutual")).alias("relations"),
            F.struct(_sum(texts, lambda x: x["n"]).cast("long").alias("readings"), size(texts).alias("distinct")).alias("text"),
        ),
        "timeline": F.struct(
            F.transform("segments", lambda s: pick(s, "segment", "start", "end", "seconds", "person_ids")).alias("segments"),
            F.struct(size("segments").alias("shots"), F.try_divide(duration, F.size("segments")).alias("mean_s"), F.array_min(lengths).alias("min_s"), F.array_max(lengths).alias("max_s"), F.try_divide(F.size("segments").cast("double"), minutes).alias("shots_per_minute")).alias("rhythm"),
            F.transform("persons", lambda p: pick(p, "person_id", "first_frame", "last_frame", "seconds")).alias("presence"),
        ),
        "plastic": F.struct(F.struct(visuals.alias("visuals"), medium.alias("medium")).alias("video"), F.transform("segments", lambda s: F.struct(s["segment"].alias("segment"), _inside("visuals", s["segment"]).alias("visuals"), s["keyframes"].alias("keyframes"))).alias("segments")),
        "figurative": F.struct(
            F.struct(c("tags").alias("tags")).alias("video"), F.transform("segments", lambda s: F.struct(s["segment"].alias("segment"), B.crowd(s["visible"]).alias("crowdedness"), _inside("objects", s["segment"]).alias("objects"), _inside("texts", s["segment"]).alias("texts"), s["keyframes"].alias("keyframes"))).alias("segments"),
            c("subjects").alias("subjects"), F.transform(shown, person).alias("persons"), _ids(c("persons"), "person_id", lambda p: p["status"] == "tracked").alias("tracked_only"),
        ),
        "enunciative": F.struct(
            F.transform("segments", lambda s: pick(s, "segment", "visible", "followed", "assessment", "movement", "keyframes")).alias("segments"), kept.alias("relations"),
            _shares(F.filter("segments", lambda s: s["movement"].isNotNull()), lambda s: s["movement"], lambda s: s["seconds"], duration).alias("camera"),
        ),
        "gaps": F.struct(
            _ids(c("persons"), "person_id", lambda p: p["abstained"]).alias("abstained"), _ids(c("persons"), "person_id", lambda p: p["series"] < 2).alias("thin"), _ids(shown, "person_id", lambda p: p["status"] == "glimpsed").alias("glimpsed"),
            _ids(c("segments"), "segment", lambda s: ~s["tracked"]).alias("segments_without_tracks"), _ids(c("segments"), "segment", lambda s: s["assessment"] == "under_tracked").alias("under_tracked_segments"),
        ),
    }
    record = _once(wide, **sections).select(item, "inputs_bytes", *sections)
    bytes_ = F.octet_length(F.to_json(F.struct(item, *sections)))
    return record.withColumn("record_bytes_", bytes_).select(item, *sections, F.struct("inputs_bytes", c("record_bytes_").cast("long").alias("record_bytes"), (1 - F.try_divide(c("record_bytes_"), c("inputs_bytes"))).alias("reduction")).alias("budget"))
