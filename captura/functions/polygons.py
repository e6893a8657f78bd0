"""Overlap of quadrilaterals, vectorized over Arrow batches with NumPy.

The area of the intersection of two convex polygons is the sum, over the parts
of each boundary that lie inside the other polygon, of the cross product of the
part's end points. Parts come from clipping every edge against four half planes.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def _cross(a, b):
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def signed_area(p: np.ndarray) -> np.ndarray:
    return _cross(p, np.roll(p, -1, axis=1)).sum(axis=1) / 2.0


def _boundary_inside(p: np.ndarray, q: np.ndarray, keep_shared: bool) -> np.ndarray:
    """Sum of cross products of the parts of p's boundary inside counter-clockwise q."""
    start = p[:, :, None, :]
    step = np.roll(p, -1, axis=1)[:, :, None, :] - start
    origin = q[:, None, :, :]
    edge = np.roll(q, -1, axis=1)[:, None, :, :] - origin
    size = np.maximum(np.hypot(edge[..., 0], edge[..., 1]), 1e-300)
    height = _cross(edge, start - origin) / size
    slope = _cross(edge, step) / size
    scale = np.maximum(np.abs(p).max(axis=(1, 2)), 1.0)[:, None, None] * 1e-10
    parallel = np.abs(slope) <= scale
    with np.errstate(divide="ignore", invalid="ignore"):
        at = -height / slope
    enter = np.where(~parallel & (slope > 0), at, 0.0).max(axis=2)
    leave = np.where(~parallel & (slope < 0), at, 1.0).min(axis=2)
    same_way = (edge * step).sum(axis=-1) > 0
    on_line = np.abs(height) <= scale
    outside = parallel & np.where(on_line, ~(keep_shared & same_way), height < 0)
    point_edge = np.hypot(edge[..., 0], edge[..., 1]) == 0
    outside &= ~point_edge
    t0, t1 = np.clip(enter, 0.0, 1.0), np.clip(leave, 0.0, 1.0)
    live = (t1 > t0) & ~outside.any(axis=2)
    a, d = start[:, :, 0, :], step[:, :, 0, :]
    parts = _cross(a + t0[..., None] * d, a + t1[..., None] * d)
    return np.where(live, parts, 0.0).sum(axis=1)


def _convex_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = np.where((signed_area(a) < 0)[:, None, None], a[:, ::-1], a)
    b = np.where((signed_area(b) < 0)[:, None, None], b[:, ::-1], b)
    shift = a.mean(axis=1, keepdims=True)
    a, b = a - shift, b - shift
    area = (_boundary_inside(a, b, True) + _boundary_inside(b, a, False)) / 2.0
    return np.maximum(area, 0.0)


def _is_convex(p: np.ndarray) -> np.ndarray:
    d = np.roll(p, -1, axis=1) - p
    turns = _cross(d, np.roll(d, -1, axis=1))
    return (turns >= 0).all(axis=1) | (turns <= 0).all(axis=1)


def _triangles(p: np.ndarray):
    """Split simple quads along the diagonal that lies inside them."""
    first = np.abs(signed_area(p[:, [0, 1, 2]])) + np.abs(signed_area(p[:, [0, 2, 3]]))
    second = np.abs(signed_area(p[:, [1, 2, 3]])) + np.abs(signed_area(p[:, [1, 3, 0]]))
    use_first = (first <= second)[:, None, None]
    yield np.where(use_first, p[:, [0, 1, 2]], p[:, [1, 2, 3]])
    yield np.where(use_first, p[:, [0, 2, 3]], p[:, [1, 3, 0]])


def _crossing(p: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the side from corner ``i`` crosses the opposite side, and where."""
    a, b, c, d = (p[:, (i + k) % 4] for k in range(4))
    along, across = b - a, d - c
    slope = _cross(along, across)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = _cross(c - a, across) / slope, _cross(c - a, along) / slope
    crossed = (slope != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    return crossed, a + np.where(crossed, t, 0.0)[:, None] * along


def _parts(p: np.ndarray):
    """Two triangles that cover a quad; the two lobes of one that crosses itself."""
    first, second = _triangles(p)
    for i in (0, 1):
        crossed, at = _crossing(p, i)
        corner = lambda k: p[:, (i + k) % 4]  # noqa: B023, E731
        first = np.where(crossed[:, None, None], np.stack([at, corner(1), corner(2)], axis=1), first)
        second = np.where(crossed[:, None, None], np.stack([at, corner(3), corner(0)], axis=1), second)
    return first, second


def _quad_area(p: np.ndarray, convex: np.ndarray) -> np.ndarray:
    area = np.abs(signed_area(p))
    if not convex.all():
        area[~convex] = sum(np.abs(signed_area(x)) for x in _parts(p[~convex]))
    return area


def _upright(p: np.ndarray) -> np.ndarray:
    """Quads that are boxes with level and plumb sides, from a corner with a level side."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = ((p[:, i, 0], p[:, i, 1]) for i in range(4))
    return (y0 == y1) & (x1 == x2) & (y2 == y3) & (x3 == x0)


def quad_iou_arrays(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of quads shaped (n, 4, 2); 0 where the union is empty.

    A quad that crosses itself is the two lobes on both sides of its crossing.
    """
    if len(a) == 0:
        return np.zeros(0)
    inter = _convex_overlap(a, b)
    convex_a, convex_b = _is_convex(a), _is_convex(b)
    rough = ~(convex_a & convex_b)
    if rough.any():
        inter[rough] = sum(_convex_overlap(x, y) for x in _parts(a[rough]) for y in _parts(b[rough]))
    union = _quad_area(a, convex_a) + _quad_area(b, convex_b) - inter
    boxes = _upright(a) & _upright(b)
    if boxes.any():  # by their sides: no error of clipping moves an overlap that lies half way between two rounded values
        low_a, high_a, low_b, high_b = a[boxes].min(1), a[boxes].max(1), b[boxes].min(1), b[boxes].max(1)
        inter[boxes] = np.maximum(0.0, np.minimum(high_a, high_b) - np.maximum(low_a, low_b)).prod(axis=1)
        union[boxes] = (high_a - low_a).prod(axis=1) + (high_b - low_b).prod(axis=1) - inter[boxes]
    with np.errstate(divide="ignore", invalid="ignore"):
        iou = np.where(union > 0, inter / union, 0.0)
    return np.clip(np.nan_to_num(iou), 0.0, 1.0)


def order_arrays(p: np.ndarray) -> np.ndarray:
    """Canonical corner order of quads shaped (n, 4, 2); the earliest corner wins ties."""
    x, y = p[..., 0].T, p[..., 1].T
    t, d = x + y, y - x
    kept = (t[0] <= t[1]) & (t[0] <= t[2]) & (t[0] <= t[3]) & (d[1] < d[0]) & (d[1] <= d[2]) & (d[1] <= d[3])
    kept &= (t[2] > t[0]) & (t[2] > t[1]) & (t[2] >= t[3]) & (d[3] > d[0]) & (d[3] > d[1]) & (d[3] > d[2])
    if kept.all():
        return p
    out, moved = p.copy(), ~kept
    total, difference = t.T[moved], d.T[moved]
    picks = np.stack([total.argmin(1), difference.argmin(1), total.argmax(1), difference.argmax(1)], axis=1)
    out[moved] = np.take_along_axis(p[moved], picks[:, :, None], axis=1)
    return out


def shape_arrays(p: np.ndarray) -> dict:
    """Measurements of ordered quads (n, 4, 2), in arrays (4, n): long loops run over quads, not over corners."""
    x, y = np.ascontiguousarray(p[..., 0].T), np.ascontiguousarray(p[..., 1].T)
    turned = lambda v, k: np.concatenate([v[k:], v[:k]])
    ex, ey = turned(x, 1) - x, turned(y, 1) - y
    square = ex * ex + ey * ey
    length = np.sqrt(square)
    bx, by = -turned(ex, 3), -turned(ey, 3)
    cosine = np.abs((ex * bx + ey * by) / np.maximum(1e-6, length * turned(length, 3)))
    cross = x * turned(y, 1) - y * turned(x, 1)
    area = np.abs((cross[0] + cross[1] + cross[2] + cross[3]) / 2.0)
    # Seen from a side's first corner, that corner and the side's end lie at 0 and ``square`` along it and at 0 across it.
    dx, dy = turned(x, 2) - x, turned(y, 2) - y
    far, near = dx * ex + dy * ey, bx * ex + by * ey
    along = np.maximum(np.maximum(far, near), square) - np.minimum(np.minimum(far, near), 0.0)
    far, near = ex * dy - ey * dx, ex * by - ey * bx
    across = np.maximum(np.maximum(far, near), 0.0) - np.minimum(np.minimum(far, near), 0.0)
    boxes = along * across / np.maximum(1e-12, square)
    return {
        "area": area,
        "w": 0.5 * (length[0] + length[2]),
        "h": 0.5 * (length[3] + length[1]),
        "mean_cos": (cosine[0] + cosine[1] + cosine[2] + cosine[3]) / 4.0,
        "max_cos": cosine.max(axis=0),
        "rect": np.minimum(1.0, area / np.maximum(1.0, boxes.min(axis=0))),
        "x1": x.min(axis=0),
        "y1": y.min(axis=0),
        "x2": x.max(axis=0),
        "y2": y.max(axis=0),
    }


_NUMBERS = ("area", "w", "h", "mean_cos", "max_cos", "rect", "x1", "y1", "x2", "y2")
_SHAPE = StructType(
    [StructField("quad", ArrayType(DoubleType())), *[StructField(n, DoubleType()) for n in _NUMBERS]]
)
_AGREEMENT_FIELDS = ("iou", "mean", "median", "max", "min")
_AGREEMENT = StructType([StructField(n, DoubleType()) for n in _AGREEMENT_FIELDS])


def points_of(quads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which quads of an array of eight doubles are there, and those as (n, 4, 2)."""
    return np.asarray(quads.is_valid()), np.asarray(quads.flatten(), float).reshape(-1, 4, 2)


def spread(values: np.ndarray, known: np.ndarray, missing: float = np.nan) -> pa.Array:
    """The values of known rows in their places; NaN is NULL."""
    out = np.full(len(known), missing)
    out[known] = values
    return pa.array(out, mask=np.isnan(out))


@F.arrow_udf(_SHAPE)
def _quad_shape(quads: pa.Array) -> pa.Array:
    known, p = points_of(quads)
    p = order_arrays(p)
    numbers = shape_arrays(p)
    ends = np.append(0, np.cumsum(known * 8)).astype(np.int32)
    ordered = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~known, False)), pa.array(p.ravel()))
    return pa.StructArray.from_arrays([ordered, *[spread(numbers[n], known) for n in _NUMBERS]], ["quad", *_NUMBERS])


@F.arrow_udf(_AGREEMENT)
def _quad_agreement(pred: pa.Array, truth: pa.Array) -> pa.Array:
    both = pc.and_(pred.is_valid(), truth.is_valid())
    known = np.asarray(both)
    a, b = points_of(pred.filter(both))[1], points_of(truth.filter(both))[1]
    d = np.linalg.norm(order_arrays(a) - order_arrays(b), axis=2)
    errors = [spread(x, known) for x in (d.mean(1), np.median(d, 1), d.max(1), d.min(1))] if len(d) else [pa.nulls(len(known), pa.float64())] * 4
    return pa.StructArray.from_arrays([spread(quad_iou_arrays(a, b), known, 0.0), *errors], list(_AGREEMENT_FIELDS))


# Marked as non-deterministic so that filters on a measurement do not repeat it.
quad_shape = _quad_shape.asNondeterministic()
quad_agreement = _quad_agreement.asNondeterministic()


def flat(quad):
    """Eight doubles of a quad, the compact form that crosses the Arrow boundary."""
    return F.when(
        F.size(quad) == 4,
        F.array(*[F.get(quad, F.lit(i))[axis].cast("double") for i in range(4) for axis in ("x", "y")]),
    )


def quad_iou(a, b):
    """IoU of two quad columns; 0.0 when either is missing."""
    return quad_agreement(flat(a), flat(b))["iou"]
