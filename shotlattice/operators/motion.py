"""Motion of the camera from matched points, its measures and decisions, and identities of boxes through frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT
from .assess import best_assignment

#: Pixels by which a point of the consensus may miss the fit, and matched points that a fit needs.
REACH, LEAST_POINTS = 3.0, 10
#: Pairs of points that are tried as fits, and how many at once.
TRIES, AT_ONCE = 400, 40


# ---------------------------------------------------------------- similarity fits


def similarity(before: np.ndarray, after: np.ndarray, rng: np.random.Generator, reach: float = REACH, tries: int = TRIES) -> tuple[complex, complex] | None:
    """(a, b) of the similarity after = a * before + b, points as complex numbers, that most points agree with; None if no two points differ.

    Each try goes through two points. Those within ``reach`` of the best try are fitted by least squares, and again until the consensus stays. If there are not more pairs than tries, all are tried.
    """
    n = len(before)
    i, j = np.triu_indices(n, 1) if n * (n - 1) // 2 <= tries else (rng.integers(n, size=tries), rng.integers(n, size=tries))
    apart = before[i] != before[j]
    i, j = i[apart], j[apart]
    if not len(i):
        return None
    a = (after[i] - after[j]) / (before[i] - before[j])
    b = after[i] - a * before[i]
    votes = np.concatenate([(np.abs(np.outer(a[k : k + AT_ONCE], before) + b[k : k + AT_ONCE, None] - after) <= reach).sum(axis=1) for k in range(0, len(a), AT_ONCE)])
    best = int(votes.argmax())
    if votes[best] < 2:
        return None
    fit, inside = (a[best], b[best]), None
    for _ in range(20):
        now = np.abs(fit[0] * before + fit[1] - after) <= reach
        if now.sum() < 2 or (inside is not None and (now == inside).all()):
            break
        inside = now
        x, y = before[inside], after[inside]
        x0, y0 = x.mean(), y.mean()
        spread = (np.abs(x - x0) ** 2).sum()
        if not spread:
            break
        slope = (np.conj(x - x0) * (y - y0)).sum() / spread
        fit = (slope, y0 - slope * x0)
    return fit


def fitted_motions(pairs: DataFrame, points: str, width: float, height: float, seed: int = 0, least: int = LEAST_POINTS) -> DataFrame:
    """``pairs`` (a row per frame pair) with ``motion`` for its matched points, an array of structs (x0, y0, x1, y1, person).

    motion: tx, ty (the shift of the frame's centre in widths), scale (logarithm), roll (radians), source: 1 fitted to the points off people, 0 nobody is in the frame, 2 the whole frame, as those off people
    were too few or gave no fit, -1 no fit (then the others are null). A fit needs ``least`` points. One Arrow batch holds many frame pairs; nothing is shuffled.
    """
    centre = complex(width / 2, height / 2)

    def fit(p: np.ndarray) -> tuple | None:
        if len(p) < least:
            return None
        found = similarity(p[:, 0] + 1j * p[:, 1], p[:, 2] + 1j * p[:, 3], np.random.default_rng(seed))
        if found is None or not abs(found[0]):
            return None
        shift = found[0] * centre + found[1] - centre
        return shift.real / width, shift.imag / width, float(np.log(abs(found[0]))), float(np.angle(found[0]))

    def step(*columns) -> tuple:
        p = np.array([[] if x is None else x for x in columns], float).T
        p, person = p[:, :4], p[:, 4] > 0
        off = p[~person]
        masked = fit(off) if len(off) < len(p) else None
        whole = masked or fit(p)
        return (*(whole or (None,) * 4), 1 if masked else -1 if whole is None else 0 if len(off) == len(p) else 2)

    @F.pandas_udf("tx double, ty double, scale double, roll double, source int")
    def motions(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, person: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([step(*row) for row in zip(x0, y0, x1, y1, person)], columns=["tx", "ty", "scale", "roll", "source"]).astype({"source": "int32", **{c: "float64" for c in ("tx", "ty", "scale", "roll")}})

    # points cross as arrays of numbers, not as a row object a point
    at = ("x0", "y0", "x1", "y1")
    known = F.filter(points, lambda p: p["x0"].isNotNull() & p["y0"].isNotNull() & p["x1"].isNotNull() & p["y1"].isNotNull())
    number = lambda f: F.transform(known, lambda p: f(p).cast("double"))
    return pairs.withColumn("motion", motions(*[number(lambda p, k=k: p[k]) for k in at], number(lambda p: F.coalesce(p["person"], F.lit(False)))))


# ---------------------------------------------------------------- cameras


def _deviation(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Median absolute deviations, scaled to a normal's, as columns ``mad_<column>``."""
    med = df.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in columns])
    return df.join(med, keys).groupBy(*keys).agg(*[(1.4826 * F.percentile(F.abs(F.col(c) - F.col(f"m_{c}")), F.lit(0.5))).alias(f"mad_{c}") for c in columns])


def camera(steps: DataFrame, keys: list[str], fps: float, tx: str = "tx", ty: str = "ty", scale: str = "scale", roll: str | None = None) -> DataFrame:
    """What a camera does, from its steps between frames (null where none was fitted): n, pan, tilt, zoom, roll, jitter, rig, move, direction, movement, static.

    pan, tilt, zoom and roll are sums per second of the n known steps; jitter is the spread of the shifts about their medians. rig is handheld above the limit of jitter. move is the axis that moves most, zoom first
    and pan before tilt on ties, or none below the limit on all three; directions are the camera's, so content that slides left is a pan to the right. movement names a handheld camera by its move only if the move's mean step reaches
    0.605 of its deviation, or has none. static is minus the largest of the four measures over their limits. With fewer than two known steps movement is unknown and the rest null.
    """
    axes = {"pan": tx, "tilt": ty, "zoom": scale}
    known = steps.where(F.col(tx).isNotNull() & F.col(ty).isNotNull() & F.col(scale).isNotNull())
    if roll is None:
        known, roll = known.withColumn("roll_", F.lit(None).cast("double")), "roll_"
    sums = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[(F.sum(c) * float(fps) / F.count(F.lit(1))).alias(a) for a, c in {**axes, "roll": roll}.items()],
        *[F.avg(c).alias(f"mean_{a}") for a, c in axes.items()], *[F.stddev_pop(c).alias(f"sd_{a}") for a, c in axes.items()],
    )
    spread = _deviation(known, keys, [tx, ty]).select(*keys, ((F.col(f"mad_{tx}") + F.col(f"mad_{ty}")) * float(fps) ** 0.5).alias("jitter"))
    all_ = steps.select(*keys).distinct()
    m = all_.join(sums.join(spread, keys), keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    enough = F.col("n") >= 2
    pan, tilt, zoom = (F.abs(F.col(a)) for a in axes)
    move = F.when(F.greatest(pan, tilt, zoom) < DEFAULT.movement, "none").when(zoom >= F.greatest(pan, tilt), "zoom").when(pan >= tilt, "pan").otherwise("tilt")
    m = m.withColumns({"move": F.when(enough, move), "rig": F.when(enough, F.when(F.col("jitter") > DEFAULT.jitter, "handheld").otherwise("steady"))})
    of = lambda what: F.when(F.col("move") == "pan", F.col(f"{what}_pan")).when(F.col("move") == "tilt", F.col(f"{what}_tilt")).when(F.col("move") == "zoom", F.col(f"{what}_zoom"))
    steady = F.coalesce((of("sd") == 0) | (F.abs(of("mean")) / F.nullif(of("sd"), F.lit(0.0)) >= DEFAULT.steady), F.lit(False))
    still = F.when(F.col("move") == "none", "static").otherwise(F.col("move"))
    direction = F.when(F.col("move") == "zoom", F.when(F.col("zoom") > 0, "in").otherwise("out")).when(F.col("move") == "pan", F.when(F.col("pan") < 0, "right").otherwise("left")).when(F.col("move") == "tilt", F.when(F.col("tilt") < 0, "down").otherwise("up"))
    measures = [F.when(enough, F.col(c)).alias(c) for c in ("pan", "tilt", "zoom", "roll", "jitter")]
    worst = -F.greatest(pan / DEFAULT.movement, tilt / DEFAULT.movement, zoom / DEFAULT.movement, F.col("jitter") / DEFAULT.jitter)
    movement = F.when(~enough, "unknown").when((F.col("rig") == "handheld") & ~steady, "handheld").otherwise(still)
    return m.select(*keys, "n", *measures, "rig", "move", direction.alias("direction"), movement.alias("movement"), F.when(enough, worst).alias("static"))


def at_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with nulls of the columns at the median of the values there are: an item without a measure neither gains nor loses by it. The medians are one row."""
    medians = df.agg(*[F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in columns])
    filled = df.crossJoin(F.broadcast(medians))
    return filled.select(*[F.coalesce(F.col(c), F.col(f"median_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def shake_shares(df: DataFrame, level: str, rig: str) -> DataFrame:
    """By level of shake: items with a rig, and the share of them called handheld."""
    return df.where(F.col(level).isNotNull() & F.col(rig).isNotNull()).groupBy(level).agg(F.count(F.lit(1)).alias("items"), F.avg((F.col(rig) == "handheld").cast("double")).alias("handheld"))


def decisions(df: DataFrame, keys: list[str], shaky: Column, rig: Column, truth: Column, move: Column, right_way: Column, still: Column, movement: Column) -> DataFrame:
    """How often the camera's decisions agree with labels, one row per group.

    ``shaky`` (null: not judged) against ``rig``: precision and recall of handheld. ``truth`` is an array of true moves: of the items with one and a measured move, answered, the share that names it; ``right_way``, of
    those whose move is right and moves at all (null: direction unknown), the share with its direction. ``still`` against ``movement``: precision and recall of static. Shares of nothing are null.
    """
    one = (F.size(truth) == 1) & move.isNotNull()
    named = one & (truth[0] == move)
    held, static = rig == "handheld", movement == "static"
    share = lambda top, of: F.try_divide(F.count_if(F.coalesce(top & of, F.lit(False))).cast("double"), F.count_if(F.coalesce(of, F.lit(False))))
    judged = shaky.isNotNull() & rig.isNotNull()
    sure = still.isNotNull() & movement.isNotNull()
    way = named & (move != "none") & right_way.isNotNull()
    return df.groupBy(*keys).agg(
        F.count_if(judged).alias("rigs"), share(shaky, judged & held).alias("handheld_precision"), share(held, judged & shaky).alias("handheld_recall"),
        F.count_if(F.size(truth) == 1).alias("moves"), F.count_if(one).alias("answered"), share(named, one).alias("move_accuracy"), F.count_if(way).alias("directions"), share(right_way, way).alias("direction_accuracy"),
        F.count_if(sure).alias("stills"), share(still, sure & static).alias("static_precision"), share(static, sure & still).alias("static_recall"),
    )


# ---------------------------------------------------------------- tracking


class _Track:
    """A box that moves evenly: centre and size with their speeds, corrected by part of what each observation misses the prediction by."""

    def __init__(self, number: int, frame: int, box: np.ndarray):
        self.number, self.frame, self.hits = number, frame, 1
        self.at, self.speed = self.centred(box), np.zeros(4)

    @staticmethod
    def centred(box: np.ndarray) -> np.ndarray:
        return np.array([(box[0] + box[2]) / 2, (box[1] + box[3]) / 2, box[2] - box[0], box[3] - box[1]])

    def predicted(self, frame: int) -> np.ndarray:
        x, y, w, h = self.at + self.speed * (frame - self.frame)
        w, h = max(w, 1e-6), max(h, 1e-6)
        return np.array([x - w / 2, y - h / 2, x + w / 2, y + h / 2])

    def seen(self, frame: int, box: np.ndarray) -> None:
        step = max(frame - self.frame, 1)
        guess = self.at + self.speed * step
        miss = self.centred(box) - guess
        pull, turn = (1.0, 1.0) if self.hits == 1 else (0.7, 0.3)
        self.at, self.speed = guess + pull * miss, self.speed + turn * miss / step
        self.frame, self.hits = frame, self.hits + 1


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of each box of ``a`` with each of ``b``."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = np.clip(w, 0, None) * np.clip(h, 0, None)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def _matched(tracks: list[_Track], frame: int, boxes: np.ndarray, floor: float, weights: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (track, box) of the best assignment of predicted boxes, those above ``floor`` only."""
    if not tracks or not len(boxes):
        return []
    gain = overlaps(np.array([t.predicted(frame) for t in tracks]), boxes)
    if weights is not None:
        gain = gain * weights
    return [(i, j) for i, j in best_assignment(np.where(gain > floor, gain, 0.0)) if gain[i, j] > floor]


def two_stage_tracks(boxes: DataFrame, keys: list[str], high: float = 0.5, low: float = 0.1, new: float = 0.6, first_floor: float = 0.2, second_floor: float = 0.5, patience: int = 30) -> DataFrame:
    """(keys, id, frame, track) of the boxes (keys, id, frame, score, x1 to y2) that belong to a track; track counts from 0 within the keys, a shot for example.

    In each frame the tracks seen within ``patience`` frames are moved on by their speed. Boxes scored ``high`` or more are assigned to them first, by the greatest sum of overlap times score, then boxes of ``low`` or more to the tracks of the
    frame before that are left, by overlap: a person who is half hidden keeps their identity. Boxes of ``new`` or more without a track start one; it must be seen again in the next frame, or it is given up. Boxes below ``low`` are left out. A shot's boxes are one
    group, as each frame depends on the one before.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tracks: list[_Track] = []
        out, count, before = [], 0, None
        every, place = g["frame"].to_numpy(), g["id"].to_numpy()
        order = np.lexsort((place, every))
        every, place, boxed, scored = every[order], place[order], g[["x1", "y1", "x2", "y2"]].to_numpy(float)[order], g["score"].to_numpy(float)[order]
        edges = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1], [True])))
        own = [g[k].iloc[0] for k in keys]
        for first, past in zip(edges[:-1].tolist(), edges[1:].tolist()):
            frame, box, score, ids = int(every[first]), boxed[first:past], scored[first:past], place[first:past].tolist()
            tracks = [t for t in tracks if frame - t.frame <= patience and (t.hits > 1 or t.frame == before)]
            kept = {}
            sure = np.flatnonzero(score >= high)
            for i, j in _matched(tracks, frame, box[sure], first_floor, score[sure]):
                kept[int(sure[j])] = tracks[i]
            used = {id(t) for t in kept.values()}
            rest = [t for t in tracks if id(t) not in used and t.frame == before and t.hits > 1]
            unsure = np.flatnonzero((score >= low) & (score < high))
            for i, j in _matched(rest, frame, box[unsure], second_floor):
                kept[int(unsure[j])] = rest[i]
            for j in range(len(ids)):
                t = kept.get(j)
                if t is not None:
                    t.seen(frame, box[j])
                elif score[j] >= max(new, high):
                    t = _Track(count, frame, box[j])
                    count += 1
                    tracks.append(t)
                if t is not None:
                    out.append((*own, ids[j], frame, t.number))
            before = frame
        return pd.DataFrame(out, columns=[*keys, "id", "frame", "track"])

    kinds = dict(boxes.dtypes)
    rows = boxes.select(*keys, F.col("id").cast("long").alias("id"), F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("double").alias(c) for c in ("score", "x1", "y1", "x2", "y2")]).where(F.col("score") >= low)
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", id long, frame long, track long")
