"""Boxes, intervals, angles and heads as column expressions. A box is a struct of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[c.alias(n) for n, c in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))])


def area(b: Column) -> Column:
    """Area of a box; sides that run backwards count 0."""
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 without overlap or area."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def interval_iou(start_a, end_a, start_b, end_b) -> Column:
    """Intersection over union of closed whole-number intervals."""
    both = F.greatest(F.least(end_a, end_b) - F.greatest(start_a, start_b) + 1, F.lit(0))
    return both / ((end_a - start_a + 1) + (end_b - start_b + 1) - both)


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def head_centre(face: Column) -> tuple[Column, Column]:
    """Centre of a face moved up by 0.15 of its height."""
    x, y = centre(face)
    return x, y - 0.15 * (face["y2"] - face["y1"])


def overlaps(a: Column, b: Column) -> Column:
    """Boxes that share area; touching edges do not count."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def inside(x: Column, y: Column, b: Column) -> Column:
    return x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"])


def upper_half(b: Column) -> Column:
    return box(b["x1"], b["y1"], b["x2"], (b["y1"] + b["y2"]) / 2)


def seated(face: Column, body: Column) -> Column:
    """Face centre within a quarter of the body's width of its midline, in the body's upper half."""
    x, y = centre(face)
    mid, middle = centre(body)
    return (F.abs(x - mid) <= 0.25 * (body["x2"] - body["x1"])) & (y >= body["y1"]) & (y <= middle)


def padded(b: Column, pad: float, width: Column, height: Column) -> Column:
    """Box grown on all sides by a share of its longer side, within the frame."""
    by = F.rint(pad * F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"]))
    return box(F.greatest(b["x1"] - by, F.lit(0)), F.greatest(b["y1"] - by, F.lit(0)), F.least(b["x2"] + by, width), F.least(b["y2"] + by, height))


def frontality(nose_x: Column, left_x: Column, right_x: Column) -> Column:
    """1 for a nose midway between the eyes, 0 from half an eye distance off; null for eyes on one place."""
    span = F.abs(right_x - left_x)
    return F.when(span > 0, F.greatest(F.lit(0.0), 1 - 2 * F.abs(nose_x - (left_x + right_x) / 2) / span))


def wrapped_degrees(a: Column, b: Column) -> Column:
    """Angle between two directions in degrees, 0 to 180."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def euler(m: Column) -> Column:
    """Yaw, pitch, roll in degrees of a rotation given as an array of nine numbers by rows; with the middle axis upright, roll is 0."""
    at = lambda r, c: F.element_at(m, 3 * r + c + 1)
    side = F.sqrt(at(0, 0) * at(0, 0) + at(1, 0) * at(1, 0))
    locked = side < 1e-6
    return F.struct(
        F.degrees(F.atan2(-at(2, 0), side)).alias("yaw"),
        F.degrees(F.when(locked, F.atan2(-at(1, 2), at(1, 1))).otherwise(F.atan2(at(2, 1), at(2, 2)))).alias("pitch"),
        F.degrees(F.when(locked, F.lit(0.0)).otherwise(F.atan2(at(1, 0), at(0, 0)))).alias("roll"),
    )


def head_box(face: Column, width: Column, height: Column) -> Column:
    """A face box grown to the head (0.2 of its width left and 0.2 right, 0.4 of its height up, 0.1 down), as shares of the frame."""
    w, h = face["x2"] - face["x1"], face["y2"] - face["y1"]
    share = lambda x, of: F.least(F.greatest(x / of, F.lit(0.0)), F.lit(1.0))
    return box(share(face["x1"] - 0.2 * w, width), share(face["y1"] - 0.4 * h, height), share(face["x2"] + 0.2 * w, width), share(face["y2"] + 0.1 * h, height))


def face_of_head(head: Column) -> Column:
    """The face box that ``head_box`` grows to a head away from the frame's edges."""
    w, h = (head["x2"] - head["x1"]) / 1.4, (head["y2"] - head["y1"]) / 1.5
    return box(head["x1"] + 0.2 * w, head["y1"] + 0.4 * h, head["x2"] - 0.2 * w, head["y2"] - 0.1 * h)


def look_score(in_frame: Column, gaze_degrees: Column, target_degrees: Column, cone: float = 20.0) -> Column:
    """How well a gaze points at a target: presence times a bell of the angle between."""
    return in_frame * F.exp(-F.pow(wrapped_degrees(gaze_degrees, target_degrees) / cone, F.lit(2.0)))


def fitted(width: Column, height: Column, longest: int) -> Column:
    """Whole-number sides with the longer at most ``longest``."""
    scale = F.least(F.lit(1.0), longest / F.greatest(width, height))
    return F.struct(F.rint(width * scale).cast("int").alias("width"), F.rint(height * scale).cast("int").alias("height"))


def ninth(x: Column, y: Column) -> Column:
    """Name of the cell of a 3 by 3 grid that holds a point of the unit square."""
    band = lambda v, names: F.when(v < 1 / 3, names[0]).when(v > 2 / 3, names[2]).otherwise(names[1])
    return F.concat_ws(" ", band(y, ("top", "middle", "bottom")), band(x, ("left", "centre", "right")))


def head_span(face: Column, body: Column, reach: float = 0.58) -> Column:
    """(x, top, bottom) where a head is: the head centre of a face, else from the body's top down by a share of its width, within the body."""
    x, y = head_centre(face)
    mid, _ = centre(body)
    down = F.least(body["y2"], body["y1"] + reach * (body["x2"] - body["x1"]))
    span = lambda a, b, c: F.struct(a.cast("double").alias("x"), b.cast("double").alias("top"), c.cast("double").alias("bottom"))
    return F.when(face.isNotNull(), span(x, y, y)).otherwise(span(mid, body["y1"], down))


def clipped(b: Column, width: Column, height: Column, least: int = 24) -> Column:
    """A box within the frame; null if a side is under ``least``."""
    c = box(F.greatest(b["x1"], F.lit(0)), F.greatest(b["y1"], F.lit(0)), F.least(b["x2"], width), F.least(b["y2"], height))
    return F.when((c["x2"] - c["x1"] >= least) & (c["y2"] - c["y1"] >= least), c)


def best_face(found: Column, crop: Column, scale: Column, floor: float) -> Column:
    """Of detections (x, y, w, h, score) in a scaled crop the best, as a box of the frame that stays in the crop; null under the floor, without size or where a number isn't finite."""
    best = F.array_max(F.transform(found, lambda d: F.struct(d["score"].alias("score"), d["x"].alias("x"), d["y"].alias("y"), d["w"].alias("w"), d["h"].alias("h"))))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    x, y, w, h = (F.rint(best[n] / scale) for n in ("x", "y", "w", "h"))
    ok = (best["score"] >= floor) & finite(best["x"]) & finite(best["y"]) & finite(best["w"]) & finite(best["h"]) & (w > 0) & (h > 0)
    held = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    left, top = crop["x1"] + x, crop["y1"] + y
    return F.when(ok, box(held(left, crop["x1"], crop["x2"]), held(top, crop["y1"], crop["y2"]), held(left + w, crop["x1"], crop["x2"]), held(top + h, crop["y1"], crop["y2"])))


def spans_cells(b: Column, cells: int = 32) -> Column:
    """Whether a box of the unit square still has an inside when its edges are rounded to cells (halves to even)."""
    at = lambda v: F.rint(v * cells)
    return (at(b["x2"]) > at(b["x1"])) & (at(b["y2"]) > at(b["y1"]))


def black_edges(means: Column, dark: float) -> Column:
    """Share of lines that are dark from either end on; 1 if all are."""
    n = F.size(means)
    first = F.array_position(F.transform(means, lambda x: x >= dark), True)
    last = F.array_position(F.reverse(F.transform(means, lambda x: x >= dark)), True)
    return F.when(first == 0, 1.0).otherwise((first + last - 2) / n)
