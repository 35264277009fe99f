"""Queries of stores that are written and read again: archives of arrays, and memos."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import numbering
from ..sources import archives, stored
from .adapters import events
from .catalogue import WITH, query

c = F.col


@query(f"{WITH} SELECT video::VARCHAR AS item, 'value' AS array, count(*)::BIGINT AS n, sum(value) AS total FROM e WHERE video % 3 = 0 GROUP BY 1", "total")
def archived_arrays(spark, d):
    """All series of all items are written as archives; of those one array of a third of the items is read."""
    e = events(spark, d)
    order = F.array_sort(F.collect_list(F.struct("event_id", "value", "frame")))
    of = e.groupBy(c("video").cast("string").alias("item")).agg(order.alias("s"))
    rows = of.select("item", F.explode(F.array(*[F.struct(F.lit(n).alias("array"), F.array(F.size("s")).alias("shape"), c(f"s.{n}").cast("array<double>").alias("values")) for n in ("value", "frame")])).alias("r")).select("item", "r.*")
    at = f"{stored.shared_folder(spark)}/stored/archives-{uuid.uuid4().hex}"
    archives.write_archives(rows, at)
    read = archives.read_archives(spark, at).where("array = 'value'").where(c("item").cast("long") % 3 == 0)
    return read.select("item", "array", F.element_at("shape", 1).cast("long").alias("n"), F.aggregate("values", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(f"{WITH} SELECT video, segment, count(*)::BIGINT AS n, sum(value) AS total FROM e WHERE segment < 25 GROUP BY ALL", "total")
def refreshed_memo(spark, d):
    """A memo of sums by item and day, built for days 0 to 19 and refreshed for days below 25; days that are there are not computed again."""
    e = events(spark, d)
    memo = stored.Memo(spark, f"{stored.shared_folder(spark)}/stored/memo-{uuid.uuid4().hex}", ["video", "segment"], "video long, segment long, n long, total double")
    compute = lambda keys: e.join(keys, ["video", "segment"]).groupBy("video", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    memo.refresh(e.where("segment < 20"), compute, lots=2)
    return memo.refresh(e.where("segment < 25"), compute, lots=2)


QUEUES = f"""{WITH}, g AS (SELECT event_id, video, frame, label, value, k, label <> 'error' AS pose, label IN ('view', 'click') AND k >= 20 AS emotion FROM e),
p AS (SELECT event_id, row_number() OVER o - 1 AS place FROM g WHERE pose WINDOW o AS (ORDER BY frame, video, event_id)), m AS (SELECT event_id, row_number() OVER o - 1 AS place FROM g WHERE emotion WINDOW o AS (ORDER BY frame, video, event_id))"""


def _queued(spark, d):
    e = events(spark, d)
    asks = {"pose": c("label") != "error", "emotion": c("label").isin("view", "click") & (c("k") >= 20)}
    return numbering.reserved(e, ["frame", "video", "event_id"], asks)


@query(f"{QUEUES} SELECT g.event_id, p.place AS pose_place, m.place AS emotion_place FROM g LEFT JOIN p USING (event_id) LEFT JOIN m USING (event_id)")
def reserved_places(spark, d):
    return _queued(spark, d).select("event_id", "pose_place", "emotion_place")


@query(f"{QUEUES} SELECT g.event_id, CASE WHEN p.place % 5 > 0 THEN p.place * 2 END AS pose, CASE WHEN m.place % 3 > 0 THEN g.value END AS emotion FROM g LEFT JOIN p USING (event_id) LEFT JOIN m USING (event_id)", "emotion")
def filled_answers(spark, d):
    q = _queued(spark, d)
    poses = q.where("pose_place % 5 > 0").select(c("pose_place").alias("place"), (c("pose_place") * 2).alias("answer"))
    moods = q.where("emotion_place is not null").select(c("emotion_place").alias("place"), F.when(c("emotion_place") % 3 > 0, c("value")).alias("answer"))
    return numbering.filled(q, {"pose": poses, "emotion": moods}).select("event_id", "answers.pose", "answers.emotion")
