"""Quadrilateral geometry.

In tables a quad is ``array<struct<x:double,y:double>>``; ordered quads run
top-left, top-right, bottom-right, bottom-left. Scores and box arithmetic are
plain column expressions. Measuring a quad takes several hundred multiplications,
which as one generated method is too large for the JVM to compile, so it happens
once per row in Arrow batches (:func:`measure`).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captura.functions.polygons import flat, quad_agreement, quad_shape
from captura.functions.rounding import clamp01

# --- fixed values ---------------------------------------------------------
TARGET_ASPECTS = (1.586, 1.420)
ASPECT_DECAY = 3.5
AREA_CENTRE = 0.32
AREA_SIGMA = 0.16
AREA_PENALTY_START = 0.60
AREA_PENALTY_SPAN = 0.30
# --------------------------------------------------------------------------

POINT = "struct<x:double,y:double>"
QUAD = f"array<{POINT}>"


def quad(*xy: Column) -> Column:
    """Quad array from eight coordinate columns x0, y0, x1, y1, ..."""
    return F.array(
        *[
            F.struct(xy[2 * i].cast("double").alias("x"), xy[2 * i + 1].cast("double").alias("y"))
            for i in range(4)
        ]
    )


def unflatten(eight: Column) -> Column:
    """Quad array from an array of eight doubles."""
    points = [
        F.struct(F.get(eight, F.lit(2 * i)).alias("x"), F.get(eight, F.lit(2 * i + 1)).alias("y")) for i in range(4)
    ]
    return F.when(eight.isNotNull(), F.array(*points))


def coordinates_area(xs, ys) -> Column:
    """Area of a quad given by coordinate columns."""
    t = [xs[i] * ys[(i + 1) % 4] - xs[(i + 1) % 4] * ys[i] for i in range(4)]
    return F.abs(t[0] + t[1] + t[2] + t[3]) / 2.0


def measure(df: DataFrame, column: str = "corners", name: str = "m") -> DataFrame:
    """Add a struct with the ordered quad and its measurements.

    Fields: ``quad`` (eight ordered doubles), ``area``, ``w`` and ``h`` (mean
    sides), ``mean_cos`` and ``max_cos`` (absolute corner cosines), ``rect`` (area
    over the smallest edge-aligned bounding box), ``x1, y1, x2, y2`` (extremes).
    """
    return df.withColumn(name, quad_shape(flat(F.col(column))))


def measure_agreement(df: DataFrame, pred: str, truth: str, name: str = "m") -> DataFrame:
    """Add a struct with ``iou`` and ``mean, median, max, min`` distance of ordered corners."""
    return df.withColumn(name, quad_agreement(flat(F.col(pred)), flat(F.col(truth))))


def order_points(q: Column) -> Column:
    """Canonical corner order of a quad array; the earliest point wins ties."""

    def pick(key, largest):
        keyed = F.transform(
            q, lambda p, i: F.struct((-key(p) if largest else key(p)).alias("k"), i.alias("i"), p.alias("p"))
        )
        return F.array_min(keyed)["p"]

    total = lambda p: p["x"] + p["y"]
    difference = lambda p: p["y"] - p["x"]
    ordered = F.array(pick(total, False), pick(difference, False), pick(total, True), pick(difference, True))
    return F.when(q.isNotNull(), ordered)


def aspect_ratio(w: Column, h: Column) -> Column:
    """Longer over shorter mean side; sides count as at least one pixel."""
    w, h = F.greatest(F.lit(1.0), w), F.greatest(F.lit(1.0), h)
    return F.greatest(w, h) / F.least(w, h)


def detector_aspect_ratio(w: Column, h: Column) -> Column:
    return F.greatest(w, h) / F.greatest(F.lit(1.0), F.least(w, h))


def score_aspect_ratio(aspect: Column, targets=TARGET_ASPECTS) -> Column:
    upright = F.when(aspect >= 1.0, aspect).otherwise(1.0 / aspect)
    gaps = [F.abs(upright - t) for t in targets]
    gap = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    return F.when(aspect <= 0.0, F.lit(0.0)).otherwise(F.exp(F.lit(-ASPECT_DECAY) * (gap * gap)))


def score_area_ratio(ratio: Column) -> Column:
    d = ratio - AREA_CENTRE
    bell = F.exp(-(d * d) / (2.0 * (AREA_SIGMA**2)))
    penalty = F.greatest(F.lit(0.0), 1.0 - (ratio - AREA_PENALTY_START) / AREA_PENALTY_SPAN)
    scored = F.when(ratio > AREA_PENALTY_START, bell * penalty).otherwise(bell)
    return F.when((ratio <= 0.0) | (ratio >= 1.0), F.lit(0.0)).otherwise(clamp01(scored))


def score_rectangularity(rect: Column, mean_cos: Column) -> Column:
    """Mix of rectangularity and squareness of the corners; without corners the first alone."""
    square = F.greatest(F.lit(0.0), 1.0 - mean_cos)
    return F.when(mean_cos.isNull(), clamp01(rect)).otherwise(clamp01(0.6 * rect + 0.4 * square))


def detector_confidence(rect: Column, mean_cos: Column, aspect: Column, area_ratio: Column) -> Column:
    """Unrounded detector confidence from rectangularity, angles, aspect and coverage."""
    s_aspect = F.greatest(F.lit(0.0), 1.0 - 0.35 * F.abs(aspect - 1.58))
    s_area = F.when(area_ratio < 0.15, F.least(F.lit(1.0), area_ratio / 0.15)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), area_ratio - 0.70) / 0.25)
    )
    return 0.40 * rect + 0.35 * (1.0 - mean_cos) + 0.15 * s_aspect + 0.10 * s_area


def point_in_quad(px: Column, py: Column, xs, ys) -> Column:
    """Boundary-inclusive test for convex quads of either orientation, given as coordinate columns."""
    crosses = []
    for i in range(4):
        j = (i + 1) % 4
        crosses.append((xs[j] - xs[i]) * (py - ys[i]) - (ys[j] - ys[i]) * (px - xs[i]))
    return (F.least(*crosses) >= 0) | (F.greatest(*crosses) <= 0)


def bbox_iou(a: Column, b: Column) -> Column:
    """Intersection over union of ``[x1, y1, x2, y2]`` arrays."""
    at = lambda box, i: F.get(box, F.lit(i)).cast("double")
    iw = F.greatest(F.lit(0.0), F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0)))
    ih = F.greatest(F.lit(0.0), F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)))
    inter = iw * ih
    area = lambda box: (at(box, 2) - at(box, 0)) * (at(box, 3) - at(box, 1))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def extremes_bbox(x1: Column, y1: Column, x2: Column, y2: Column, frame_w: Column, frame_h: Column) -> Column:
    """Bounding box rounded half to even and clamped to the last pixel of the frame."""
    limit = lambda v, top: F.greatest(F.lit(0), F.least(top - 1, F.rint(v).cast("int")))
    return F.array(limit(x1, frame_w), limit(y1, frame_h), limit(x2, frame_w), limit(y2, frame_h))


def corners_bbox(q: Column) -> Column:
    """Outward-rounded box of a quad array, used when only corners are known."""
    xs, ys = F.transform(q, lambda p: p["x"]), F.transform(q, lambda p: p["y"])
    return F.array(
        F.floor(F.array_min(xs)).cast("int"),
        F.floor(F.array_min(ys)).cast("int"),
        F.ceil(F.array_max(xs)).cast("int"),
        F.ceil(F.array_max(ys)).cast("int"),
    )


def crop_rect(bbox: Column, frame_w: Column, frame_h: Column, padding: float = 0.02) -> Column:
    """Padded crop rectangle inside the frame; NULL when the box or crop is degenerate."""
    x1, y1, x2, y2 = (F.get(bbox, F.lit(i)) for i in range(4))
    pad_x = F.rint((x2 - x1) * F.lit(float(max(0.0, padding)))).cast("int")
    pad_y = F.rint((y2 - y1) * F.lit(float(max(0.0, padding)))).cast("int")
    cx1, cy1 = F.greatest(F.lit(0), x1 - pad_x), F.greatest(F.lit(0), y1 - pad_y)
    cx2, cy2 = F.least(frame_w, x2 + pad_x), F.least(frame_h, y2 + pad_y)
    usable = (x2 > x1) & (y2 > y1) & (cx2 > cx1) & (cy2 > cy1)
    return F.when(usable, F.array(cx1, cy1, cx2, cy2))
