"""Candidate quadrilaterals of a frame: validation, scoring, nesting, ranking, de-duplication.

Rows are ``video_id, frame_id, cand_id, corners, area, frame_w, frame_h`` plus the
optional measurements named in each operator. ``cand_id`` is the input order.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captura.functions import geometry as G
from captura.functions.geometry import AREA_CENTRE, AREA_PENALTY_SPAN, AREA_PENALTY_START, AREA_SIGMA, ASPECT_DECAY
from captura.functions.polygons import flat, order_arrays, points_of, shape_arrays, spread
from captura.functions.rounding import clamp01, round_half_even
from captura.operators.grouping import null_safe, tiles
from captura.operators.shared import written

# --- fixed values ---------------------------------------------------------
SCORE_WEIGHTS = {
    "aspect_ratio": 0.30,
    "area": 0.25,
    "rectangularity": 0.20,
    "edge_quality": 0.15,
    "nesting_bonus": 0.10,
}
NESTED_DELTA = 0.20
CONTAINER_DELTA = -0.30
NESTED_AREA_SHARE = 0.85
DUPLICATE_IOU = 0.70
# --------------------------------------------------------------------------

FRAME = ("video_id", "frame_id")
TILE_CANDIDATES = 128


def plausible_areas(candidates: DataFrame, lo: float = 0.05, hi: float = 0.95, min_px: float = 1000.0) -> DataFrame:
    frame_area = F.col("frame_w").cast("double") * F.col("frame_h")
    share = F.col("area") / frame_area
    return candidates.filter((frame_area >= 400) & (share >= lo) & (share <= hi) & (F.col("area") >= min_px))


_VALID = "kept boolean, corners array<struct<x:double,y:double>>, bbox array<int>, aspect_ratio double, rectangularity double, confidence double, mean_cos double"


def _judged(p, area, w, h, rect, min_aspect: float, max_aspect: float) -> dict:
    """Verdict and reported values of quads (n, 4, 2) in canonical order; the arithmetic of ``G.detector_confidence``."""
    m = shape_arrays(p)
    rect = m["rect"] if rect is None else rect
    share = area / (w * h)
    aspect = np.maximum(m["w"], m["h"]) / np.maximum(1.0, np.minimum(m["w"], m["h"]))
    x, y = p[..., 0], p[..., 1]
    near = ((x <= 4.0) | (x >= w[:, None] - 4.0) | (y <= 4.0) | (y >= h[:, None] - 4.0)).all(axis=1)
    kept = ~(near & (share >= 0.88)) & (aspect >= min_aspect) & (aspect <= max_aspect) & (m["max_cos"] <= 0.70) & (rect >= 0.70)
    s_aspect = np.maximum(0.0, 1.0 - 0.35 * np.abs(aspect - 1.58))
    s_area = np.where(share < 0.15, np.minimum(1.0, share / 0.15), np.maximum(0.0, 1.0 - np.maximum(0.0, share - 0.70) / 0.25))
    confidence = 0.40 * rect + 0.35 * (1.0 - m["mean_cos"]) + 0.15 * s_aspect + 0.10 * s_area
    box = np.rint(np.stack([m["x1"], m["y1"], m["x2"], m["y2"]], axis=1))
    box = np.maximum(0, np.minimum(np.stack([w, h, w, h], axis=1) - 1, box))
    return {
        "kept": kept,
        "bbox": np.nan_to_num(box).astype(np.int32),
        "aspect_ratio": np.rint(aspect * 1e3) / 1e3,
        "rectangularity": np.rint(rect * 1e3) / 1e3,
        "confidence": np.clip(np.rint(confidence * 1e4) / 1e4, 0.0, 1.0),
        "mean_cos": m["mean_cos"],
    }


def _validator(min_aspect: float, max_aspect: float):
    def validate(quads: pa.Array, area: pa.Array, w: pa.Array, h: pa.Array, rect: pa.Array) -> pa.Array:
        known, p = points_of(quads)
        of = lambda c: np.asarray(c.filter(pa.array(known)), float)
        p = order_arrays(p)
        given = None if pa.types.is_null(rect.type) or rect.null_count == len(rect) else of(rect)
        out = _judged(p, of(area), of(w), of(h), given, min_aspect, max_aspect)
        kept = np.zeros(len(known), bool)
        kept[known] = out.pop("kept")
        ends = lambda k: pa.array(np.append(0, np.cumsum(known * k)).astype(np.int32), mask=np.append(~known, False))
        xy = pa.StructArray.from_arrays([pa.array(p[..., i].ravel()) for i in (0, 1)], ["x", "y"])
        lists = [pa.ListArray.from_arrays(ends(4), xy), pa.ListArray.from_arrays(ends(4), pa.array(out.pop("bbox").ravel()))]
        return pa.StructArray.from_arrays(
            [pa.array(kept), *lists, *[spread(v, known) for v in out.values()]], ["kept", "corners", "bbox", *out]
        )

    return F.arrow_udf(validate, _VALID).asNondeterministic()  # a filter on the verdict does not repeat it


def validate_quads(candidates: DataFrame, min_aspect: float = 1.0, max_aspect: float = 2.8) -> DataFrame:
    """Keep physically plausible quads and add bbox, aspect, rectangularity, confidence.

    Corners are put in canonical order first. ``rectangularity`` is taken from the
    input when present; otherwise it is measured on the quad itself. ``mean_cos`` is
    kept, so that scoring need not measure again. All of it is arithmetic on Arrow batches: as column expressions it
    is a method too large for the JVM to compile.
    """
    number = lambda c: F.col(c).cast("double")
    if "rectangularity" in candidates.columns:
        candidates = candidates.filter("rectangularity IS NOT NULL")
        rect = number("rectangularity")
    else:
        rect = F.lit(None).cast("double")
    judge = _validator(min_aspect, max_aspect)
    judged = candidates.withColumn("__v", judge(flat(F.col("corners")), number("area"), number("frame_w"), number("frame_h"), rect))
    names = ["corners", "bbox", "aspect_ratio", "rectangularity", "confidence", "mean_cos"]
    return judged.filter("__v.kept").withColumns({n: F.col(f"__v.{n}") for n in names}).drop("__v")


def _inside(points: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """Per pair (n, 4, 2): all points in the convex polygon of either orientation, boundary included."""
    edge = np.roll(polygon, -1, axis=1) - polygon
    offset = points[:, :, None, :] - polygon[:, None, :, :]
    cross = edge[:, None, :, 0] * offset[..., 1] - edge[:, None, :, 1] * offset[..., 0]
    return ((cross.min(axis=2) >= 0) | (cross.max(axis=2) <= 0)).all(axis=1)


def _nest_pairs(ids, areas, quads, inner, outer):
    """Containment of candidate pairs, reduced to the last parent and a count per candidate."""
    small = areas[inner] < areas[outer] * NESTED_AREA_SHARE
    inner, outer = inner[small], outer[small]
    hit = _inside(quads[inner], np.trunc(quads[outer])) if len(inner) else np.zeros(0, bool)
    inner, outer = inner[hit], outer[hit]
    parent = np.full(len(ids), -1, dtype=np.int64)
    np.maximum.at(parent, inner, ids[outer])
    return parent, np.bincount(outer, minlength=len(ids))


def _tile_pairs(n: int, m: int, shapes: dict):
    """Ordered candidate pairs of a tile: all i != j of one side, or both directions across sides."""
    if (n, m) not in shapes:
        if m:
            i, j = np.meshgrid(np.arange(n), np.arange(n, n + m), indexing="ij")
            shapes[n, m] = np.r_[i.ravel(), j.ravel()], np.r_[j.ravel(), i.ravel()]
        else:
            shapes[n, m] = np.nonzero(~np.eye(n, dtype=bool))
    return shapes[n, m]


def _nest_tiles(batches, keys, budget: int = 200_000):
    """Find nested candidates in packed tiles; only candidates with a finding leave."""
    for pdf in batches:
        shapes: dict = {}
        sizes = [(len(a), len(b)) for a, b in zip(pdf["left_id"], pdf["right_id"])]
        start = 0
        while start < len(pdf):
            inner, outer, base, pairs, stop = [], [], 0, 0, start
            while stop < len(pdf) and (stop == start or pairs < budget):
                n, m = sizes[stop]
                i, j = _tile_pairs(n, m, shapes)
                inner.append(i + base)
                outer.append(j + base)
                base, pairs, stop = base + n + m, pairs + len(i), stop + 1
            part = pdf.iloc[start:stop]
            joined = lambda c: np.concatenate(
                [x for pair in zip(part[f"left_{c}"], part[f"right_{c}"]) for x in pair]
            )
            ids, areas = joined("id").astype(np.int64), joined("area").astype(float)
            quads = joined("quad").astype(float).reshape(-1, 4, 2)
            parent, encloses = _nest_pairs(ids, areas, quads, np.concatenate(inner), np.concatenate(outer))
            found = np.flatnonzero((parent >= 0) | (encloses > 0))
            owners = np.repeat(np.arange(start, stop), [n + m for n, m in sizes[start:stop]])
            out = pdf[keys].iloc[owners[found]].reset_index(drop=True)
            yield out.assign(cand_id=ids[found], parent=parent[found], encloses=encloses[found])
            start = stop


def _same_frame(batch: pa.Table, keys) -> np.ndarray:
    """Whether a row has the keys of the row before it; NULL equals NULL."""
    same = np.ones(batch.num_rows, bool)
    same[:1] = False
    for k in keys:
        codes = np.asarray(batch.column(k).combine_chunks().dictionary_encode("encode").indices)
        same[1:] &= codes[1:] == codes[:-1]
    return same


def _nest_frames(start: np.ndarray, ids: np.ndarray, areas: np.ndarray, points: np.ndarray, budget: int = 200_000):
    """Last parent (-1: none) and number of enclosed candidates of every row, among the rows of its frame.

    ``start`` holds the first row of each frame; a row whose area is NaN takes no part. Pairs lose one corner after the
    other: most fail at the first.
    """
    n = len(ids)
    size = np.diff(np.append(start, n))
    x, y = np.ascontiguousarray(points[..., 0].T), np.ascontiguousarray(points[..., 1].T)
    tx, ty = np.trunc(x), np.trunc(y)
    ex, ey = np.roll(tx, -1, axis=0) - tx, np.roll(ty, -1, axis=0) - ty
    parent, encloses = np.full(n, -1, dtype=np.int64), np.zeros(n, np.int64)
    first, others = np.repeat(start, size), np.repeat(size, size)
    upto = np.cumsum(others)
    limits = areas * NESTED_AREA_SHARE
    at = 0
    while at < n:
        done = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, done + budget, "right")))
        inner = np.repeat(np.arange(at, stop), others[at:stop])
        outer = np.arange(len(inner)) - np.repeat(upto[at:stop] - others[at:stop] - done, others[at:stop]) + first[inner]
        hit = areas[inner] < limits[outer]  # never true of a row and itself
        inner, outer = inner[hit], outer[hit]
        for k in range(4):
            px, py = x[k][inner], y[k][inner]
            cross = [ex[i][outer] * (py - ty[i][outer]) - ey[i][outer] * (px - tx[i][outer]) for i in range(4)]
            low = np.minimum(np.minimum(cross[0], cross[1]), np.minimum(cross[2], cross[3]))
            high = np.maximum(np.maximum(cross[0], cross[1]), np.maximum(cross[2], cross[3]))
            hit = (low >= 0) | (high <= 0)
            inner, outer = inner[hit], outer[hit]
        if len(inner):
            np.maximum.at(parent, inner, ids[outer])
            encloses += np.bincount(outer, minlength=n)
        at = stop
    return parent, encloses


def _points(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have four corners, and those corners (n, 4, 2)."""
    quads = rows.column("corners").combine_chunks()
    four = pc.fill_null(pc.equal(pc.list_value_length(quads), 4), False)
    x, y = (np.asarray(v, float) for v in quads.filter(four).flatten().flatten())
    return np.asarray(four), np.stack([x, y], axis=1).reshape(-1, 4, 2)


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return np.asarray(rows.column(name).cast(pa.float64()).combine_chunks(), float)


def _by_frames(batches, keys, limit: int):
    """Cut rows sorted by frame into tables of whole frames, and tables of rows of a frame larger than ``limit``, marked.

    What waits for the end of its frame is never more than ``limit`` rows.
    """
    waiting, large = None, False  # rows of the frame that may go on, or, if it is large, one row that names it
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        start = np.flatnonzero(~_same_frame(table, keys))
        ends = np.append(start[1:], table.num_rows)
        if large:  # the first row was given out before
            if ends[0] > 1:
                yield table.slice(1, ends[0] - 1), True
        elif ends[0] - start[0] > limit:
            yield table.slice(0, ends[0]), True
            large = True
        head = 1 if large else 0
        last = len(start) - 1
        if last == 0 and large:
            waiting = table.slice(0, 1)
            continue
        big = np.flatnonzero(ends - start > limit)
        at = head
        for k in [*big[(big > 0) & (big >= head)], last + 1]:
            until = min(k, last)
            if until > at:
                yield table.slice(start[at], start[until] - start[at]), False
            if k <= last:
                yield table.slice(start[k], ends[k] - start[k]), True
            at = k + 1
        large = last in big
        waiting = table.slice(start[last], 1) if large else table.slice(start[last])
    if waiting is not None and not large:
        yield waiting, False


def _nest_sorted(batches, keys, limit: int):
    """Add ``__parent, __encloses, __large`` to rows sorted by frame; rows of frames over ``limit`` pass through, marked."""
    for rows, large in _by_frames(batches, keys, limit):
        n = rows.num_rows
        parent, encloses = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if not large:
            known, quads = _points(rows)
            points = np.zeros((n, 4, 2))
            points[known] = quads
            areas = np.where(known, _numbers(rows, "area"), np.nan)
            ids = np.asarray(rows.column("cand_id").cast(pa.int64()))
            parent, encloses = _nest_frames(np.flatnonzero(~_same_frame(rows, keys)), ids, areas, points)
        added = {
            "__parent": pa.array(parent, mask=parent < 0).cast(rows.schema.field("cand_id").type),
            "__encloses": pa.array(encloses.astype(np.int32)),
            "__large": pa.array(np.full(n, large)),
        }
        for name, values in added.items():
            rows = rows.append_column(name, values)
        yield from rows.combine_chunks().to_batches()


def nesting(candidates: DataFrame, keys=FRAME, tile_rows: int = TILE_CANDIDATES) -> DataFrame:
    """Add ``is_nested``, ``nested_parent_idx`` and ``encloses_count``.

    A is nested in B when all its corners lie in B, whose coordinates lose their
    fraction, and its area is below 85 % of B's. The parent is the last enclosing
    candidate in input order. Rows are dealt once by frame and read in order, so frames of up to ``tile_rows`` candidates are
    decided where they pass; the result is written. Rows of larger frames are marked in it and spread over tiles, which
    report one partial row per candidate with a finding, never one per pair.
    """
    keys = list(keys)
    schema = T.StructType(
        [
            *candidates.schema.fields,
            T.StructField("__parent", candidates.schema["cand_id"].dataType),
            T.StructField("__encloses", T.IntegerType()),
            T.StructField("__large", T.BooleanType()),
        ]
    )
    dealt = candidates.repartition(*keys).sortWithinPartitions(*keys)

    def pass_through(batches):
        return _nest_sorted(batches, keys, tile_rows)

    marked = written(dealt.mapInArrow(pass_through, schema), "candidates")
    plain = marked.filter(~F.col("__large")).drop("__large")
    large = marked.filter("__large").drop("__large", "__parent", "__encloses")
    return _shown(plain.unionByName(_nest_tiled(large, keys, tile_rows)), candidates.columns)


def _shown(found: DataFrame, columns) -> DataFrame:
    return found.select(
        *columns,
        F.col("__parent").alias("nested_parent_idx"),
        F.coalesce("__encloses", F.lit(0)).alias("encloses_count"),
        F.col("__parent").isNotNull().alias("is_nested"),
    )


def _nest_tiled(large: DataFrame, keys, tile_rows: int) -> DataFrame:
    """Add ``__parent, __encloses`` to rows of large frames."""
    types = dict(large.dtypes)
    slim = large.select(*keys, "cand_id", "area", flat(F.col("corners")).alias("quad"))
    tiled = tiles(slim, keys, ["cand_id"], tile_rows)
    entry = F.struct("cand_id", F.col("area").cast("double").alias("area"), "quad")
    diagonal = F.col("__ti") == F.col("__tj")
    packed = (
        tiled.filter("quad IS NOT NULL")
        .groupBy(*keys, "__ti", "__tj")
        .agg(
            F.collect_list(F.when(F.col("__block") == F.col("__ti"), entry)).alias("left"),
            F.collect_list(F.when(~diagonal & (F.col("__block") == F.col("__tj")), entry)).alias("right"),
        )
        .filter((F.size("left") > 1) | (F.size("right") > 0))
        .select(
            *keys,
            *[
                c
                for side in ("left", "right")
                for c in (
                    F.col(f"{side}.cand_id").alias(f"{side}_id"),
                    F.col(f"{side}.area").alias(f"{side}_area"),
                    F.flatten(F.col(f"{side}.quad")).alias(f"{side}_quad"),
                )
            ],
        )
    )
    found_schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", cand_id {types['cand_id']}, parent bigint, encloses bigint"

    def search(batches):
        return _nest_tiles(batches, keys)

    found = (
        packed.mapInPandas(search, found_schema)
        .groupBy(*keys, "cand_id")
        .agg(
            F.max(F.when(F.col("parent") >= 0, F.col("parent"))).cast(types["cand_id"]).alias("__parent"),
            F.sum("encloses").cast("int").alias("__encloses"),
        )
    )
    return null_safe(large, found, [*keys, "cand_id"])


def score_candidates(
    candidates: DataFrame,
    weights: dict | None = None,
    targets=G.TARGET_ASPECTS,
    keys=FRAME,
    tile_rows: int = TILE_CANDIDATES,
) -> DataFrame:
    """Static score of every candidate from aspect, area, shape, edges and nesting."""
    return _rated(nesting(_scoring_inputs(candidates), keys, tile_rows), weights, targets)


def _scoring_inputs(candidates: DataFrame) -> DataFrame:
    columns = candidates.columns
    known = {"mean_cos", "aspect_ratio"} <= set(columns)
    shaped = candidates if known else G.measure(candidates, "corners", "__m")
    return shaped.withColumns(
        {
            "area_ratio": F.col("area_ratio")
            if "area_ratio" in columns
            else F.col("area") / F.greatest(F.lit(1.0), F.col("frame_w").cast("double") * F.col("frame_h")),
            "aspect_ratio": F.col("aspect_ratio")
            if "aspect_ratio" in columns
            else round_half_even(G.aspect_ratio(F.col("__m.w"), F.col("__m.h")), 3),
            "rectangularity": F.col("rectangularity") if "rectangularity" in columns else F.lit(1.0),
            "__edge": F.coalesce("edge_quality", F.lit(0.5)) if "edge_quality" in columns else F.lit(0.5),
            "__mean_cos": F.col("mean_cos") if "mean_cos" in columns else F.col("__m.mean_cos"),
        }
    ).drop("__m")


def _rated(marked: DataFrame, weights: dict | None, targets) -> DataFrame:
    w = {**SCORE_WEIGHTS, **(weights or {})}
    scored = marked.withColumns(
        {
            "__aspect": G.score_aspect_ratio(F.col("aspect_ratio"), targets),
            "__area": G.score_area_ratio(F.col("area_ratio")),
            "__rect": G.score_rectangularity(F.col("rectangularity"), F.col("__mean_cos")),
        }
    ).withColumn(
        "nesting_delta",
        F.when(F.col("is_nested") & (F.col("__aspect") > 0.5), F.lit(NESTED_DELTA)).otherwise(F.lit(0.0))
        + F.when(F.col("encloses_count") > 0, F.lit(CONTAINER_DELTA)).otherwise(F.lit(0.0)),
    )
    total = (
        w["aspect_ratio"] * F.col("__aspect")
        + w["area"] * F.col("__area")
        + w["rectangularity"] * F.col("__rect")
        + w["edge_quality"] * F.col("__edge")
        + w["nesting_bonus"] * F.col("nesting_delta")
    )
    static = round_half_even(clamp01(total))
    return scored.withColumns(
        {
            "edge_quality": round_half_even(F.col("__edge"), 3),
            "score_aspect": round_half_even(F.col("__aspect")),
            "score_area": round_half_even(F.col("__area")),
            "score_rect": round_half_even(F.col("__rect")),
            "score_edge": round_half_even(F.col("__edge")),
            "nesting_delta": round_half_even(F.col("nesting_delta")),
            "static_score": static,
            "confidence": static,
        }
    ).drop("__aspect", "__area", "__rect", "__edge", "__mean_cos")


def _scores(aspect, share, rect, mean_cos, edge, nested, encloses, weights: dict, targets) -> dict:
    """The arithmetic of :func:`_rated` on arrays of valid quads."""
    clamp = lambda v: np.fmax(0.0, np.fmin(1.0, v))
    upright = np.where(aspect >= 1.0, aspect, 1.0 / aspect)
    gap = np.min([np.abs(upright - t) for t in targets], axis=0)
    s_aspect = np.exp(-ASPECT_DECAY * (gap * gap))
    d = share - AREA_CENTRE
    bell = np.exp(-(d * d) / (2.0 * (AREA_SIGMA**2)))
    penalty = np.maximum(0.0, 1.0 - (share - AREA_PENALTY_START) / AREA_PENALTY_SPAN)
    s_area = np.where((share <= 0.0) | (share >= 1.0), 0.0, clamp(np.where(share > AREA_PENALTY_START, bell * penalty, bell)))
    s_rect = clamp(0.6 * rect + 0.4 * np.maximum(0.0, 1.0 - mean_cos))
    delta = np.where(nested & (s_aspect > 0.5), NESTED_DELTA, 0.0) + np.where(encloses > 0, CONTAINER_DELTA, 0.0)
    total = weights["aspect_ratio"] * s_aspect + weights["area"] * s_area + weights["rectangularity"] * s_rect
    total = total + weights["edge_quality"] * edge + weights["nesting_bonus"] * delta
    rounded = lambda v, scale=1e4: np.rint(v * scale) / scale
    static = rounded(clamp(total))
    return {
        "edge_quality": rounded(edge, 1e3),
        "score_aspect": rounded(s_aspect),
        "score_area": rounded(s_area),
        "score_rect": rounded(s_rect),
        "score_edge": rounded(edge),
        "nesting_delta": rounded(delta),
        "static_score": static,
        "confidence": static,
    }


_ADDED = (
    "corners array<struct<x:double,y:double>>, bbox array<int>, aspect_ratio double, rectangularity double, confidence double, "
    "mean_cos double, area_ratio double, edge_quality double, score_aspect double, score_area double, score_rect double, "
    "score_edge double, nesting_delta double, static_score double, encloses_count int, is_nested boolean"
)
_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_OTHERS = {"corners": _POINTS, "bbox": pa.list_(pa.int32()), "encloses_count": pa.int32(), "is_nested": pa.bool_()}
_ADDED_TYPES = {"__large": pa.bool_()} | {n: _OTHERS.get(n, pa.float64()) for n in (part.split(" ")[0] for part in _ADDED.split(", "))}


class _OnePass:
    """Validation, nesting and scores of rows sorted by frame."""

    def __init__(self, keys, columns, names, best, min_aspect, max_aspect, weights, targets, lo, hi, min_px):
        self.keys, self.columns, self.names, self.best = keys, columns, names, best
        self.aspects, self.weights, self.targets, self.areas = (min_aspect, max_aspect), weights, targets, (lo, hi, min_px)

    def valid(self, rows: pa.Table):
        """Positions of valid rows, and their corners, areas, shares of the frame and measured values."""
        lo, hi, min_px = self.areas
        four, p = _points(rows)
        area, w, h = (_numbers(rows, c) for c in ("area", "frame_w", "frame_h"))
        with np.errstate(divide="ignore", invalid="ignore"):
            share = area / (w * h)
        fits = four & (w * h >= 400) & (share >= lo) & (share <= hi) & (area >= min_px)
        given = _numbers(rows, "rectangularity") if "rectangularity" in rows.column_names else None
        if given is not None:
            fits &= ~np.asarray(rows.column("rectangularity").is_null())
        p = order_arrays(p[fits[four]])
        at = np.flatnonzero(fits)
        out = _judged(p, area[at], w[at], h[at], None if given is None else given[at], *self.aspects)
        kept = out.pop("kept")
        at = at[kept]
        return at, p[kept], area[at], share[at], {k: v[kept] for k, v in out.items()}

    def table(self, rows: pa.Table, base: np.ndarray, pick: np.ndarray, values: dict, large: bool) -> pa.RecordBatch:
        """Output rows: columns of the frame from the rows ``base``, others from ``values`` at ``pick`` (-1: NULL)."""
        none = pick < 0
        chosen = lambda v: np.where(none, v.dtype.type(0), v[pick]) if len(v) else np.zeros(len(pick), v.dtype)
        at = pa.array(chosen(values["__at"]), mask=none)
        arrays = []
        for name in self.names:
            kind = _ADDED_TYPES[name] if name in _ADDED_TYPES else rows.schema.field("cand_id" if name == "nested_parent_idx" else name).type
            wanted = large or self.columns is None or name in self.columns or name in self.keys
            if name == "__large":
                arrays.append(pa.array(np.full(len(pick), large)))
            elif not wanted:
                arrays.append(pa.nulls(len(pick), kind))
            elif name in (*self.keys, "frame_w", "frame_h"):
                arrays.append(rows.column(name).combine_chunks().take(pa.array(base)))
            elif name in ("corners", "bbox") and name in values:
                v = values[name][pick[~none]]
                ends = pa.array(np.append(0, np.cumsum(~none * 4)).astype(np.int32), mask=np.append(none, False))
                xy = lambda i: pa.array(v[..., i].ravel())  # noqa: B023, E731
                parts = pa.StructArray.from_arrays([xy(0), xy(1)], ["x", "y"]) if name == "corners" else pa.array(v.ravel())
                arrays.append(pa.ListArray.from_arrays(ends, parts))
            elif name == "nested_parent_idx" and name in values:
                v = chosen(values[name])
                arrays.append(pa.array(v, mask=none | (v < 0)).cast(kind))
            elif name in values:
                arrays.append(pa.array(chosen(values[name]), mask=none).cast(kind))
            elif name in rows.column_names:
                arrays.append(rows.column(name).combine_chunks().take(at).cast(kind))
            else:
                arrays.append(pa.nulls(len(pick), kind))
        return pa.RecordBatch.from_arrays(arrays, self.names)

    def large(self, rows: pa.Table) -> pa.RecordBatch:
        """Valid rows of a large frame, after one without a candidate that stands for the frame."""
        at, p, _, share, values = self.valid(rows)
        values |= {"corners": p, "area_ratio": share, "__at": at}
        return self.table(rows, np.append(0, at), np.append(-1, np.arange(len(at))), values, True)

    def small(self, rows: pa.Table) -> pa.RecordBatch:
        begins = ~_same_frame(rows, self.keys)
        frame = np.cumsum(begins) - 1
        at, p, area, share, values = self.valid(rows)
        owner = frame[at]
        start = np.flatnonzero(np.diff(owner, prepend=-1))
        ids = np.asarray(rows.column("cand_id").cast(pa.int64()))[at]
        parent, encloses = _nest_frames(start, ids, area, p)
        edge = _numbers(rows, "edge_quality")[at] if "edge_quality" in rows.column_names else np.full(len(at), 0.5)
        if "edge_quality" in rows.column_names:
            edge = np.where(np.asarray(rows.column("edge_quality").is_null())[at], 0.5, edge)
        rated = _scores(values["aspect_ratio"], share, values["rectangularity"], values["mean_cos"], edge, parent >= 0, encloses, self.weights, self.targets)
        values |= {"corners": p, "area_ratio": share, "nested_parent_idx": parent, "encloses_count": encloses, "is_nested": parent >= 0, "__at": at, **rated}
        if not self.best:
            return self.table(rows, at, np.arange(len(at)), values, False)
        pick = np.full(frame[-1] + 1, -1)
        if len(at):
            static = values["static_score"]
            top = np.repeat(np.maximum.reduceat(static, start), np.diff(np.append(start, len(at))))
            hits = np.flatnonzero(static == top)
            hits = hits[np.lexsort((ids[hits], owner[hits]))]
            lead = hits[np.flatnonzero(np.diff(owner[hits], prepend=-1))]
            pick[owner[lead]] = lead
        return self.table(rows, np.flatnonzero(begins), pick, values, False)


def scored_quads(
    candidates: DataFrame,
    best: bool = False,
    columns=None,
    weights: dict | None = None,
    targets=G.TARGET_ASPECTS,
    min_aspect: float = 1.0,
    max_aspect: float = 2.8,
    areas=(0.05, 0.95, 1000.0),
    keys=FRAME,
    tile_rows: int = TILE_CANDIDATES,
) -> DataFrame:
    """``score_candidates(validate_quads(plausible_areas(candidates)))`` in one pass over rows dealt by frame.

    With ``best`` every frame of ``candidates`` gives one row: its best candidate, or NULL where none is valid. ``columns`` names
    those wanted besides the keys. What the pass gives is written; rows of frames of more than ``tile_rows`` candidates are only
    validated in it, and go on to the tiles of :func:`nesting`.
    """
    keys = list(keys)
    added = T.StructType.fromDDL(_ADDED)
    given = [f for f in candidates.schema.fields if f.name not in added.fieldNames()]
    idx = T.StructField("nested_parent_idx", candidates.schema["cand_id"].dataType)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*given, *added.fields, idx]] + [T.StructField("__large", T.BooleanType())])
    shown = [c for c in schema.fieldNames() if c != "__large" and (columns is None or c in keys or c in columns)]
    work = _OnePass(keys, columns, schema.fieldNames(), best, min_aspect, max_aspect, {**SCORE_WEIGHTS, **(weights or {})}, targets, *areas)

    def scan(batches):
        for rows, large in _by_frames(batches, keys, tile_rows):
            yield work.large(rows) if large else work.small(rows)

    dealt = candidates.repartition(*keys).sortWithinPartitions(*keys)
    marked = written(dealt.mapInArrow(scan, schema), "candidates")
    small = marked.filter(~F.col("__large")).select(*shown)
    large = marked.filter("__large").drop("__large")
    inputs = _scoring_inputs(large.filter("cand_id IS NOT NULL").select(*[c.name for c in given], *added.fieldNames()[:8]))
    nested = _shown(_nest_tiled(inputs, keys, tile_rows), inputs.columns)
    rated = _rated(nested, weights, targets).select(*shown)
    if best:
        rest = [c for c in shown if c not in (*keys, "frame_w", "frame_h")]
        top = _best(_rated(nested, weights, targets).select(*{*shown, "static_score", "cand_id"}), keys, [-F.col("static_score"), F.col("cand_id")])
        sizes = [F.first(c).alias(c) for c in ("frame_w", "frame_h") if c in shown]
        frames = large.filter("cand_id IS NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *sizes).drop("__n")
        rated = null_safe(frames, top.select(*keys, *rest), keys).select(*shown)
    return small.unionByName(rated)


def _best(rows: DataFrame, keys, rank) -> DataFrame:
    """First row per group by a rank struct; partial aggregation keeps one row per map task."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*rank)).alias("__row"))
    return picked.select(*keys, "__row.*")


def best_candidate(scored: DataFrame, min_score: float = 0.30, keys=FRAME) -> DataFrame:
    """Top candidate per frame; frames whose best misses the floor give no row."""
    top = _best(scored, list(keys), [-F.col("static_score"), F.col("cand_id")])
    return top.filter(F.col("static_score") >= min_score)


def baseline_candidate(candidates: DataFrame, min_confidence: float = 0.35, keys=FRAME) -> DataFrame:
    """Top candidate by confidence, then area, then input order."""
    top = _best(candidates, list(keys), [-F.col("confidence"), -F.col("area"), F.col("cand_id")])
    return top.filter(F.col("confidence") >= min_confidence)


def _boxes(batch: pa.Table) -> np.ndarray:
    """Boxes (n, 5): sides and area."""
    box = np.asarray(batch.column("bbox").combine_chunks().flatten(), float).reshape(-1, 4)
    return np.column_stack([box, (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])])


def _too_close(a: np.ndarray, b: np.ndarray, iou: float) -> np.ndarray:
    """Whether boxes overlap by more than ``iou``; equal boxes always do."""
    width = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    height = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    inter = np.maximum(width, 0) * np.maximum(height, 0)
    union = a[..., 4] + b[..., 4] - inter
    share = inter / np.where(union > 0, union, np.inf)
    return (share > iou) | (share == 1)


def _greedy(boxes: np.ndarray, kept: np.ndarray, iou: float):
    """Flags of the boxes of one frame in rank order, and all boxes kept so far."""
    flags = np.zeros(len(boxes), bool)
    for n, box in enumerate(boxes):
        if not _too_close(box, kept, iou).any():
            kept = np.vstack([kept, box])
            flags[n] = True
    return flags, kept


def _greedy_frames(boxes: np.ndarray, start: np.ndarray, size: np.ndarray, iou: float) -> np.ndarray:
    """Flags of the boxes of many small frames at once: one step per rank, not per box."""
    first, others = np.repeat(start, size), np.repeat(size, size)
    rank = np.arange(len(boxes)) - first
    ends = np.cumsum(others - rank - 1)
    better = np.repeat(np.arange(len(boxes)), others - rank - 1)
    worse = better + 1 + np.arange(len(better)) - np.repeat(ends - (others - rank - 1), others - rank - 1)
    close = _too_close(boxes[better], boxes[worse], iou)
    better, worse = better[close], worse[close]
    order = np.argsort(rank[better], kind="stable")
    better, worse = better[order], worse[order]
    cuts = np.searchsorted(rank[better], np.arange(size.max(initial=0) + 1))
    alive = np.ones(len(boxes), bool)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        alive[worse[lo:hi][alive[better[lo:hi]]]] = False
    return alive


def _scan_duplicates(batches, keys, iou, small: int = 64):
    """Greedy suppression over rows sorted by frame and rank.

    Frames of at most ``small`` rows that lie in a batch are decided together. Of one that goes on, only
    the kept boxes stay in memory. Kept boxes overlap little, so their number is limited by the frame, not by the input.
    """
    last, kept = None, np.zeros((0, 5))  # the last row given out, and the boxes kept in its frame
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        same = _same_frame(rows if last is None else pa.concat_tables([last, rows]), keys)
        goes_on = last is not None and bool(same[1])
        start = np.flatnonzero(~same[-rows.num_rows :])
        start = np.append(0, start) if goes_on else start
        size = np.diff(np.append(start, rows.num_rows))
        boxes, flags = _boxes(rows), np.zeros(rows.num_rows, bool)
        alone = size > small
        alone[0] |= goes_on
        alone[-1] = True  # it may go on
        together = np.repeat(~alone, size)
        if together.any():
            n = size[~alone]
            flags[together] = _greedy_frames(boxes[together], np.cumsum(n) - n, n, iou)
        for k in np.flatnonzero(alone):
            a, b = start[k], start[k] + size[k]
            flags[a:b], kept = _greedy(boxes[a:b], kept if k == 0 and goes_on else kept[:0], iou)
        last = rows.slice(rows.num_rows - 1)
        yield batch.filter(pa.array(flags))


def nms(candidates: DataFrame, iou: float = DUPLICATE_IOU, keys=FRAME) -> DataFrame:
    """Greedy de-duplication by confidence: drop a box that overlaps a kept one too much.

    Boxes with equal coordinates share their fate with the best of them, which drops the others. Rows are dealt once by
    frame and scanned in rank order, with the kept boxes as the only state, whatever the size of a frame.
    """
    keys = list(keys)
    ranked = candidates.withColumn("__rank", -F.col("confidence"))

    def scan(batches):
        return _scan_duplicates(batches, keys, iou)

    dealt = ranked.repartition(*keys).sortWithinPartitions(*keys, "__rank", "cand_id")
    return dealt.drop("__rank").mapInArrow(scan, candidates.schema)
