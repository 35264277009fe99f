"""Readers of nested item records, as column expressions: a record is one row with the structs timeline, plastic, figurative, enunciative and summary.

Lists are read where they are, by higher-order functions: no reader explodes, shuffles or calls Python. A missing struct, key or list gives null, an empty list what the reader
says of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

DESCRIBED = "described"
#: Shares of samples between which a span lies.
SPAN = (0.005, 0.995)

c = F.col


# ---------------------------------------------------------------- sums and mixes over lists


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: an expression named inside the inner function of a list would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(xs: Column) -> Column:
    """Sum of a list; 0 for an empty one, null for none."""
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def ratio(pairs: Column) -> Column:
    """Weighted mean of a list of (x, w); null without weight."""
    sums = lambda ps: bound(total(F.transform(ps, lambda p: p["w"])), lambda weight: F.when(weight > 0, total(F.transform(ps, lambda p: p["x"] * p["w"])) / weight))
    return bound(pairs, sums)


def pooled(pairs: Column) -> Column:
    """(sum, weight) of a list of (x, w), for totals over many records; null without weight."""
    sums = lambda ps: bound(total(F.transform(ps, lambda p: p["w"])), lambda weight: F.when(weight > 0, F.struct(total(F.transform(ps, lambda p: p["x"] * p["w"])).alias("sum"), weight.alias("total"))))
    return bound(pairs, sums)


def pair(x: Column, w: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), w.cast("double").alias("w"))


def weights(entries: Column) -> Column:
    """Map of a list of (label, w), weights of equal labels added; null labels are left out."""
    def summed(known: Column) -> Column:
        labels = F.array_sort(F.array_distinct(F.transform(known, lambda e: e["label"])))
        own = lambda x: total(F.transform(F.filter(known, lambda e: e["label"] == x), lambda e: e["w"]))
        return F.map_from_entries(F.transform(labels, lambda x: F.struct(x, own(x))))

    return bound(F.filter(entries, lambda e: e["label"].isNotNull()), summed)


def mix(found: Column) -> Column:
    """A map's values over their sum; null where that is not positive."""
    shares = lambda m: bound(total(F.map_values(m)), lambda whole: F.when(whole > 0, F.transform_values(m, lambda _, v: v.cast("double") / whole)))
    return bound(found, shares)


def entry(label: Column, w: Column) -> Column:
    return F.struct(label.cast("string").alias("label"), w.cast("double").alias("w"))


def entries_of(found: Column, by: Column | None = None) -> Column:
    """A map as a list of (label, w), weights times ``by``; an absent map is an empty list."""
    listed = F.transform(F.map_entries(found), lambda e: entry(e["key"], e["value"] * (F.lit(1.0) if by is None else by)))
    return F.coalesce(listed, F.array().cast("array<struct<label:string,w:double>>"))


def seconds() -> Column:
    """segment -> seconds."""
    return F.map_from_entries(F.transform(c("timeline.segments"), lambda s: F.struct(s["segment"], s["seconds"].cast("double"))))


def timed(level: str, label: Callable[[Column], Column]) -> Column:
    """Segments of a level as (label, their seconds)."""
    return bound(seconds(), lambda held: F.transform(c(f"{level}.segments"), lambda s: entry(label(s), held[s["segment"]])))


# ---------------------------------------------------------------- who is described, who watches


def described(strict: bool = False) -> Column:
    """Persons whose status is described; where a record has no status they count as described, unless ``strict``."""
    status = lambda p: p["status"] if strict else F.coalesce(p["status"], F.lit(DESCRIBED))
    return F.filter(c("figurative.persons"), lambda p: F.coalesce(status(p) == DESCRIBED, F.lit(False)))


def watchers() -> Column:
    """Persons of the watching level who are described."""
    ids = F.transform(described(True), lambda p: p["person_id"])
    return bound(ids, lambda known_: F.filter(c("enunciative.persons"), lambda p: F.array_contains(known_, p["person_id"])))


# ---------------------------------------------------------------- one number a record


def plastic_mean(key: str) -> Column:
    return c(f"plastic.video.{key}.mean").cast("double")


def outdoor() -> Column:
    return c("figurative.video.indoor_outdoor.outdoor").cast("double")


def people_time() -> Column:
    return ratio(F.transform(c("timeline.segments"), lambda s: pair((F.size(s["person_ids"]) > 0).cast("int"), s["seconds"])))


def women() -> Column:
    """Seconds of persons whose likelier gender is female, of all with one."""
    found = F.filter(described(), lambda p: p["gender"].isNotNull())
    return ratio(F.transform(found, lambda p: pair((p["gender"]["modal"] == "female").cast("int"), p["seconds"])))


def women_time() -> Column:
    """(probability of female, seconds) of each described person with a gender."""
    found = F.filter(described(True), lambda p: p["gender"].isNotNull())
    return F.transform(found, lambda p: pair(p["gender"]["female"], p["seconds"]))


def affect(axis: str) -> Column:
    found = F.filter(described(), lambda p: p[axis].isNotNull())
    return ratio(F.transform(found, lambda p: pair(p[axis]["mean"], p["seconds"])))


def portrait() -> Column:
    framed = F.filter(c("enunciative.segments"), lambda s: F.coalesce(s["portrait_scene"], F.lit("")) != "")
    return ratio(bound(seconds(), lambda held: F.transform(framed, lambda s: pair((s["portrait_scene"] == "portrait").cast("int"), held[s["segment"]]))))


def single() -> Column:
    """Seconds with one person, of those with people."""
    peopled = F.filter(c("figurative.segments"), lambda s: s["crowdedness"] != "none")
    return ratio(bound(seconds(), lambda held: F.transform(peopled, lambda s: pair((s["crowdedness"] == "single").cast("int"), held[s["segment"]]))))


def per_sample(key: str, value: Callable[[Column], Column], count: Callable[[Column], Column] = lambda x: x["n"], who: Callable[[], Column] = lambda: c("enunciative.persons")) -> Column:
    """A share or angle of persons, pooled by the samples behind it."""
    found = F.filter(who(), lambda p: p[key].isNotNull())
    return ratio(F.transform(found, lambda p: pair(value(p[key]), count(p[key]))))


def looks() -> Column:
    """Pairs with evidence of a look, of all that are present together; null without such."""
    return F.try_divide(c("summary.relations.with_evidence").cast("double"), c("summary.relations.co_present"))


def off_centre() -> Column:
    return bound(F.transform(things("x"), lambda x: F.abs(x - 0.5)), lambda xs: F.when(F.size(xs) > 0, total(xs) / F.size(xs)))


# ---------------------------------------------------------------- one mix a record


def medium() -> Column:
    return mix(c("plastic.video.medium.distribution"))


def histogram(channel: str) -> Column:
    """One channel's bins as a mix of their places."""
    bins = c(f"plastic.video.colour_histogram.{channel}")
    return mix(F.map_from_entries(F.transform(bins, lambda v, i: F.struct(i.cast("string"), v.cast("double")))))


def coverage() -> Column:
    """Regions' shares over time; names without outer blanks. Not brought to one: regions overlap and leave gaps."""
    def shares(held: Column) -> Column:
        each = F.flatten(F.transform(c("plastic.segments"), lambda s: entries_of(s["coverage"], held[s["segment"]])))
        found = weights(F.transform(each, lambda e: entry(F.trim(e["label"]), e["w"])))
        of = lambda m: bound(total(F.map_values(held)), lambda time: F.when((time > 0) & (F.size(m) > 0), F.transform_values(m, lambda _, v: v / time)))
        return bound(found, of)

    return bound(seconds(), shares)


def video_set(key: str, value: str) -> Column:
    """label -> value; null where the record has no such list, an empty map for an empty list."""
    return F.map_from_entries(F.transform(c(f"figurative.video.{key}"), lambda x: F.struct(x["label"], x[value].cast("double"))))


def animals() -> Column:
    """Seconds of a subject over the duration; a duration of 0 counts as 1."""
    whole = F.when(c("summary.duration_s") == 0, F.lit(1.0)).otherwise(c("summary.duration_s"))
    return bound(whole, lambda duration: F.map_from_entries(F.transform(c("figurative.subjects"), lambda s: F.struct(s["label"], s["seconds"] / duration))))


def crowd() -> Column:
    return mix(weights(timed("figurative", lambda s: s["crowdedness"])))


def emotion() -> Column:
    """Emotions of described persons by their time on screen."""
    return mix(weights(F.flatten(F.transform(described(), lambda p: entries_of(p["emotion"]["distribution"], p["seconds"])))))


def persons_mix(key: str) -> Column:
    """Sum of described persons' distributions, one vote each."""
    return weights(F.flatten(F.transform(described(True), lambda p: entries_of(p[key]["distribution"]))))


def modal_emotions() -> Column:
    """How many described persons have an emotion as their likeliest."""
    found = F.filter(described(True), lambda p: p["emotion"].isNotNull())
    return weights(F.transform(found, lambda p: entry(p["emotion"]["modal"], F.lit(1.0))))


def shot_scale() -> Column:
    return mix(weights(timed("enunciative", lambda s: s["camera_distance"]["scale"])))


def time_mix(level: str, label: Callable[[Column], Column], unknown: str = "unknown") -> Column:
    """Seconds of each label; null and unknown ones left out. Seconds, not shares."""
    return weights(F.filter(timed(level, label), lambda e: F.coalesce(e["label"] != unknown, F.lit(False))))


def camera() -> Column:
    """The movements' mix without the unknown."""
    return mix(F.map_filter(c("enunciative.camera"), lambda k, _: k != "unknown"))


def member(labels: Column, wanted: str, other: str) -> Column:
    """Whether a list holds one label and not the other."""
    return F.array_contains(labels, wanted) & ~F.array_contains(labels, other)


def mapped(labels: Column, to: dict[str, str]) -> Column:
    """Labels by another vocabulary, each once, ordered; those it lacks are dropped."""
    table = F.create_map(*[F.lit(x) for kv in to.items() for x in kv])
    return F.array_sort(F.array_distinct(F.filter(F.transform(labels, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull())))


def dominant(found: Column) -> Column:
    """The label with the most weight, the first by name on ties."""
    best = lambda a, e: F.when(a.isNull() | (e["value"] > a["value"]), e).otherwise(a)
    ordered = F.array_sort(F.map_entries(found))
    return F.aggregate(ordered, F.lit(None).cast("struct<key:string,value:double>"), best)["key"]


# ---------------------------------------------------------------- a list of numbers a record


def known(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull())


def each(level: str, value: Callable[[Column], Column]) -> Column:
    """A value of every segment of a level that has it."""
    return known(F.transform(c(f"{level}.segments"), lambda s: value(s).cast("double")))


def person(value: Callable[[Column], Column]) -> Column:
    """A value of every described person who has it."""
    return known(F.transform(described(True), lambda p: value(p).cast("double")))


def watcher(value: Callable[[Column], Column], n: Callable[[Column], Column], floor: int = 1) -> Column:
    """A value of every watcher who has it from ``floor`` samples or more."""
    enough = F.filter(watchers(), lambda p: F.coalesce(n(p), F.lit(0)) >= floor)
    return known(F.transform(enough, lambda p: value(p).cast("double")))


def one(value: Column) -> Column:
    """A number as a list of itself; an empty list for null."""
    return F.filter(F.array(value), lambda x: x.isNotNull())


def things(key: str) -> Column:
    """A measure of the person regions of all segments."""
    each_ = F.transform(c("plastic.segments"), lambda s: F.filter(F.coalesce(s["centralities"], F.array()), lambda t: t["label"] == "person"))
    return F.transform(F.flatten(each_), lambda t: t[key].cast("double"))


def person_depth() -> Column:
    objects = F.flatten(known(F.transform(c("plastic.segments"), lambda s: s["depth"]["objects"])))
    return F.transform(F.filter(objects, lambda o: o["label"] == "person"), lambda o: o["disparity"].cast("double"))


def background_depth() -> Column:
    return each("plastic", lambda s: s["depth"]["background"])


def face_height(tall: Column) -> Column:
    """Face heights over the frame's short side; 0 is no face."""
    return F.filter(each("enunciative", lambda s: s["camera_distance"]["face_height"] * tall), lambda x: x > 0)


def face_ratio() -> Column:
    return F.filter(each("enunciative", lambda s: s["face_background_ratio"]), lambda x: x != 0)


def shot_lengths(log: Callable[[Column], Column] = F.log) -> Column:
    longer = F.filter(c("timeline.segments"), lambda s: s["seconds"] > 0)
    return F.transform(longer, lambda s: log(s["seconds"].cast("double")))


def ages(brackets: list[str]) -> Column:
    """(x, w): positions of the age brackets that have weight, weighted by screen time."""
    weight = lambda found, b: total(F.transform(found, lambda p: F.coalesce(F.try_element_at(p["age"]["distribution"], F.lit(b)), F.lit(0.0)) * p["seconds"]))
    all_ = lambda found: F.array(*[pair(F.lit(i), weight(found, b)) for i, b in enumerate(brackets)])
    return F.filter(bound(F.filter(described(), lambda p: p["age"].isNotNull()), all_), lambda x: x["w"] > 0)


# ---------------------------------------------------------------- sequences


def sequence(level: str, value: Callable[[Column, Column], Column]) -> Column:
    """(start, end, value) of a level's keyframes in order, times as shares of the record's length; keyframes without a value left out, null for no length."""
    start = F.array_min(F.transform(c("timeline.segments"), lambda s: s["start"].cast("double")))
    end = F.array_max(F.transform(c("timeline.segments"), lambda s: s["end"].cast("double")))

    def of(span: Column) -> Column:
        start, length = span["start"], span["end"] - span["start"]
        at = lambda s: F.transform(s["keyframes"], lambda k: F.struct(((k["start"] - start) / length).alias("start"), ((k["end"] - start) / length).alias("end"), value(k, s).alias("value")))
        rows = F.filter(F.flatten(F.transform(c(f"{level}.segments"), at)), lambda r: r["value"].isNotNull())
        return F.when(length > 0, bound(rows, lambda xs: F.when(F.size(xs) > 0, xs)))

    return bound(F.struct(start.alias("start"), end.alias("end")), of)


def value_arc(level: str, key: str) -> Column:
    return sequence(level, lambda k, _: k[key].cast("double"))


def pace_arc() -> Column:
    """Each keyframe carries the logarithm of its segment's seconds."""
    return bound(seconds(), lambda held: sequence("plastic", lambda _, s: F.when(held[s["segment"]] > 0, F.log(held[s["segment"]]))))


def people_arc(most: int = 5) -> Column:
    return sequence("figurative", lambda k, _: F.least(k["people"], F.lit(most)).cast("string"))


def label_arc(level: str, key: str, unknown: str = "unknown") -> Column:
    return sequence(level, lambda k, _: F.nullif(k[key], F.lit(unknown)))


# ---------------------------------------------------------------- over records


def pooled_span(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, low, high): the span of nearly all values; a span without width gets 1."""
    q = values.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, SPAN))).alias("q"))
    low, high = c("q")[0], c("q")[1]
    return q.select(*keys, low.alias("low"), F.when(high > low, high).otherwise(low + 1).alias("high"))


def vocabulary(kits: DataFrame, lists: list[Column]) -> DataFrame:
    """(label): every label that any list of any record holds, each once; blanks around and letter case count as nothing."""
    every = kits.select(F.explode(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))).alias("label"))
    return every.select(F.lower(F.trim("label")).alias("label")).where("label <> ''").distinct()


def seen_without(kits: DataFrame, key: str, keyframes: Column, odd: Callable[[Column], Column], top: int = 30) -> tuple[DataFrame, DataFrame]:
    """The first ``top`` keyframes (by record and start) that are odd, and how many records have one."""
    rows = kits.select(key, F.explode(F.filter(keyframes, odd)).alias("k")).select(key, c("k.start").alias("start"))
    return rows.orderBy(key, "start").limit(top), rows.agg(F.count(F.lit(1)).alias("keyframes"), F.countDistinct(key).alias("records"))
