"""Stateful tracking of the best quad over the ordered frames of each capture.

A gap that outlasts the tracker's patience erases its state, so the stretches between
such gaps are independent: rows are shuffled by capture and segment and read in order as
a stream of Arrow batches, in which all segments advance together, one frame a step.
The state is one quad and a few numbers, so a capture of any length needs constant memory.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captura.functions.polygons import flat, order_arrays, quad_iou_arrays, signed_area
from captura.operators.grouping import null_safe, order_buckets
from captura.operators.shared import written


# --- fixed values ---------------------------------------------------------
NO_CANDIDATES = ("no_candidates", "No candidates provided")
REJECTED = "rejected_low_confidence"
METHODS = np.array([NO_CANDIDATES[0], REJECTED, "first_frame_detection", "temporally_guided"], dtype=object)
REJECTED_WHY = "Best candidate score ({:.3f}) below threshold ({:.3f})"
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class TrackerConfig:
    # --- fixed values -----------------------------------------------------
    temporal_weight: float = 0.40
    max_corner_displacement: float = 0.20
    max_center_displacement: float = 0.15
    max_area_change: float = 0.50
    min_tracking_score: float = 0.35
    smoothing_alpha: float = 0.70
    max_frames_lost: int = 5
    temporal_enabled: bool = True
    # ----------------------------------------------------------------------


RESULT_SCHEMA = (
    "detected boolean, method string, corners array<struct<x:double,y:double>>, bbox array<int>, "
    "confidence double, static_score double, temporal_score double, reason string"
)
RESULT_COLUMNS = [part.split(" ")[0] for part in RESULT_SCHEMA.split(", ")]
CANDIDATES = "array<struct<rank:double,cand_id:{cand_id},quad:array<double>,area:double,aspect:double>>"


class Tracks:
    """State of many independent tracks: last accepted quad (ordered corners), its shape, frames lost since."""

    def __init__(self, size: int):
        self.known = np.zeros(size, bool)
        self.quad = np.zeros((size, 4, 2))
        self.area, self.aspect = np.zeros(size), np.zeros(size)
        self.lost = np.zeros(size, int)

    def copy_from(self, at: int, other: "Tracks", place: int) -> None:
        for name in ("known", "quad", "area", "aspect", "lost"):
            getattr(self, name)[at] = getattr(other, name)[place]

    def miss(self, at: np.ndarray, cfg: TrackerConfig) -> None:
        self.lost[at] += 1
        gone = at[self.lost[at] > cfg.max_frames_lost]
        self.known[gone], self.lost[gone] = False, 0

    def accept(self, at: np.ndarray, quads: np.ndarray, areas, aspects) -> None:
        self.known[at], self.quad[at], self.area[at], self.aspect[at], self.lost[at] = True, quads, areas, aspects, 0

    def take_over(self, at: np.ndarray, quads: np.ndarray) -> None:
        """A tier-2 detection (ordered corners) replaces the tracked quad."""
        width = np.linalg.norm(quads[:, 1] - quads[:, 0], axis=1)
        height = np.linalg.norm(quads[:, 3] - quads[:, 0], axis=1)
        aspect = np.maximum(width, height) / np.maximum(1.0, np.minimum(width, height))
        self.accept(at, quads, np.abs(signed_area(quads)), aspect)


def similarity_to_last(last, last_area, last_aspect, quads, areas, aspects, w, h, cfg: TrackerConfig) -> np.ndarray:
    """Temporal similarity in [0, 1] of candidate quads (n, 4, 2), each to the accepted one beside it."""
    diagonal = np.maximum(1.0, np.hypot(w, h))
    centre = np.linalg.norm(quads.mean(axis=1) - last.mean(axis=1), axis=1) / diagonal
    corner = np.linalg.norm(quads - last, axis=2).mean(axis=1) / diagonal
    s_centre = np.maximum(0.0, 1.0 - centre / max(1e-4, cfg.max_center_displacement))
    s_corner = np.maximum(0.0, 1.0 - corner / max(1e-4, cfg.max_corner_displacement))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.minimum(areas, last_area) / np.maximum(areas, last_area)
    stable = np.where(ratio >= 1.0 - cfg.max_area_change, ratio, 0.5 * ratio)
    s_area = np.where((last_area > 0) & (areas > 0), stable, 0.5)
    apart = np.maximum(0.0, 1.0 - 2.5 * np.abs(aspects - last_aspect))
    s_aspect = np.where((last_aspect > 0) & (aspects > 0), apart, 0.5)
    s_iou = quad_iou_arrays(quads, last)
    return np.clip(0.35 * s_iou + 0.30 * s_corner + 0.15 * s_centre + 0.10 * s_area + 0.10 * s_aspect, 0.0, 1.0)


class FrameBatch:
    """Frames of an Arrow batch as arrays, with their candidates in order of static score."""

    def __init__(self, batch: pa.RecordBatch):
        cands = batch.column("cands")
        self.count = np.asarray(pc.fill_null(pc.list_value_length(cands), 0), int)
        self.start = np.cumsum(self.count) - self.count
        flat = cands.flatten()
        number = lambda name: np.asarray(pc.fill_null(flat.field(name), float("nan")), float)
        self.static, self.area, self.aspect = -number("rank"), number("area"), number("aspect")
        self.quad = order_arrays(np.asarray(flat.field("quad").flatten(), float).reshape(-1, 4, 2))
        self.w, self.h = (np.asarray(batch.column(c), float) for c in ("frame_w", "frame_h"))
        tier2 = batch.column("tier2")
        self.replaced = np.asarray(tier2.is_valid())
        self.tier2 = np.zeros((batch.num_rows, 4, 2))
        self.tier2[self.replaced] = order_arrays(np.asarray(tier2.flatten(), float).reshape(-1, 4, 2))
        n = batch.num_rows
        self.outcome = np.zeros(n, int)  # 0 no candidates, 1 rejected, 2 first detection, 3 guided
        self.corners, self.box = np.zeros((n, 4, 2)), np.zeros((n, 4), int)
        self.score, self.best_static, self.similar = np.zeros(n), np.zeros(n), np.zeros(n)

    def step(self, tracks: Tracks, frames: np.ndarray, at: np.ndarray, cfg: TrackerConfig) -> None:
        """Advance the tracks ``at`` by one frame each, all at once."""
        count = self.count[frames]
        tracks.miss(at[count == 0], cfg)
        frames_with, tracks_with, count = frames[count > 0], at[count > 0], count[count > 0]
        if len(frames_with):
            self._choose(tracks, frames_with, tracks_with, count, cfg)
        over = self.replaced[frames]
        if over.any():
            tracks.take_over(at[over], self.tier2[frames[over]])

    def _choose(self, tracks: Tracks, frames, at, count, cfg: TrackerConfig) -> None:
        first = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(frames)), count)
        c = np.arange(len(owner)) - first[owner] + self.start[frames][owner]
        guided = tracks.known[at] if cfg.temporal_enabled else np.zeros(len(at), bool)
        temporal, fused = np.ones(len(c)), self.static[c]
        g = guided[owner]
        if g.any():
            mine, cg, f = at[owner[g]], c[g], frames[owner[g]]
            temporal[g] = similarity_to_last(
                tracks.quad[mine], tracks.area[mine], tracks.aspect[mine], self.quad[cg], self.area[cg], self.aspect[cg], self.w[f], self.h[f], cfg
            )
            fused = np.where(g, (1.0 - cfg.temporal_weight) * fused + cfg.temporal_weight * temporal, fused)
        fused = np.round(np.clip(fused, 0.0, 1.0), 4)
        top = np.maximum.reduceat(fused, first)
        hits = np.flatnonzero(fused == top[owner])
        best = hits[np.unique(owner[hits], return_index=True)[1]]
        pick = c[best]
        self.score[frames], self.best_static[frames] = top, self.static[pick]
        self.similar[frames] = np.round(temporal[best], 4)
        taken = top >= cfg.min_tracking_score
        tracks.miss(at[~taken], cfg)
        self.outcome[frames] = np.where(taken, np.where(guided, 3, 2), 1)
        quads = self.quad[pick]
        smooth = cfg.smoothing_alpha * quads + (1.0 - cfg.smoothing_alpha) * tracks.quad[at]
        quads = np.where(guided[:, None, None], smooth, quads)
        yes = np.flatnonzero(taken)
        tracks.accept(at[yes], quads[yes], self.area[pick[yes]], self.aspect[pick[yes]])
        f = frames[yes]
        self.corners[f] = quads[yes]
        low, high = np.rint(quads[yes].min(axis=1)), np.rint(quads[yes].max(axis=1))
        edge = np.stack([self.w[f], self.h[f]], axis=1) - 1
        self.box[f] = np.concatenate([np.clip(low, 0, edge), np.clip(high, 0, edge)], axis=1)

    def reasons(self, cfg: TrackerConfig) -> np.ndarray:
        rejected = np.flatnonzero(self.outcome == 1)
        reasons = np.where(self.outcome == 0, NO_CANDIDATES[1], None).astype(object)
        reasons[rejected] = [REJECTED_WHY.format(s, cfg.min_tracking_score) for s in self.score[rejected].tolist()]
        return reasons

    def results(self, cfg: TrackerConfig) -> list[pa.Array]:
        """Columns of ``RESULT_SCHEMA``."""
        taken = self.outcome >= 2
        points = self.corners[taken].reshape(-1, 2)
        xy = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
        ends = lambda k: pa.array(np.concatenate([[0], np.cumsum(taken * k)]).astype(np.int32), mask=np.append(~taken, False))
        return [
            pa.array(taken),
            pa.array(METHODS[self.outcome], pa.string()),
            pa.ListArray.from_arrays(ends(4), xy),
            pa.ListArray.from_arrays(ends(4), pa.array(self.box[taken].ravel().astype(np.int32))),
            pa.array(self.score),
            pa.array(self.best_static),
            pa.array(self.similar),
            pa.array(self.reasons(cfg), pa.string()),
        ]


def frame_candidates(scored: DataFrame, keys=("video_id", "frame_idx")) -> DataFrame:
    """One row per frame with its candidates ``cands`` in order of static score, then ``cand_id``.

    ``scored`` carries the keys and ``cand_id, corners, area, aspect_ratio, static_score``. A candidate without four corners is none.
    """
    quad = flat(F.col("corners"))  # put in canonical order by FrameBatch
    slim = scored.select(
        *keys,
        F.struct(
            -F.coalesce(F.col("static_score").cast("double"), F.lit(0.0)).alias("rank"),
            "cand_id",
            quad.alias("quad"),
            F.col("area").cast("double").alias("area"),
            F.col("aspect_ratio").cast("double").alias("aspect"),
        ).alias("cand"),
    ).filter("cand.quad IS NOT NULL")
    kind = CANDIDATES.format(cand_id=dict(scored.dtypes)["cand_id"])
    return slim.groupBy(*keys).agg(F.sort_array(F.collect_list("cand")).cast(kind).alias("cands"))


def _frame_key(types: dict):
    return F.struct(*[F.col(c).cast(types[c]).alias(c) for c in ("video_id", "frame_idx")]).alias("__frame")  # NULL equals NULL


def frame_rows(frames: DataFrame, scored: DataFrame, tier2: DataFrame | None = None, bucket_rows: int = 4096) -> DataFrame:
    """One narrow row per frame with its order bucket and whether it is live: has candidates or a tier-2 quad.

    ``frames`` is ``video_id, frame_idx, frame_w, frame_h``; the others are those of :func:`track`. Buckets come from the frames alone, which are cheaper to read
    twice than their candidates.
    """
    key = _frame_key(dict(frames.dtypes))
    cut = order_buckets(frames.select("video_id", "frame_idx", "frame_w", "frame_h"), ["video_id"], "frame_idx", bucket_rows)
    quad = F.size("corners") == 4
    live = scored.filter(F.size("cands") > 0 if "cands" in scored.columns else quad).select(key)
    if tier2 is not None:
        live = live.unionByName(tier2.filter(quad).select(key))
    listed = live.distinct().withColumn("__live", F.lit(True))
    given = cut.select(key, "frame_w", "frame_h", "__bucket").join(listed, "__frame", "left")
    return given.select("__frame.video_id", "__frame.frame_idx", "frame_w", "frame_h", "__bucket", F.coalesce("__live", F.lit(False)).alias("__live"))


def track_segments(rows: DataFrame, max_frames_lost: int) -> DataFrame:
    """Add ``segment``: frames of a capture with different segments cannot influence each other.

    More than ``max_frames_lost`` frames in a row without candidates and without a take-over leave the tracker without a
    history, whatever it was before. The frame after such a gap starts a segment, named by its index; the first
    segment is NULL. Gaps are looked for within the buckets of :func:`frame_rows`, one row per bucket
    carries the segment on; a gap across the end of a bucket may stay uncut, which only makes a segment longer.
    """
    inside = Window.partitionBy("video_id", "__bucket").orderBy("frame_idx")
    numbered = rows.withColumn("__rn", F.row_number().over(inside))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(F.when(F.col("__live"), F.col("__rn")), ignorenulls=True).over(before), F.lit(0))
    starts = numbered.withColumn("__start", F.when(F.col("__live") & (F.col("__rn") - last - 1 > max_frames_lost), F.col("frame_idx")))
    begun = F.last("__start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    local = starts.withColumn("__local", begun)
    ends = local.groupBy("video_id", "__bucket").agg(F.max("__start").alias("__last"))
    along = Window.partitionBy("video_id").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carried", F.last("__last", ignorenulls=True).over(along))
    carried = carried.filter("__carried IS NOT NULL").select("video_id", "__bucket", "__carried")
    joined = null_safe(local, carried, ["video_id", "__bucket"])
    kept = [c for c in rows.columns if c not in ("__bucket", "__live")]
    return joined.select(*kept, F.coalesce("__local", "__carried").alias("segment"))


def _lockstep(batches, cfg: TrackerConfig):
    """Track sorted rows: the segments of a batch advance together, frame by frame.

    The last segment of a batch may go on in the next, so its state is kept; nothing else is.
    """
    names = ["video_id", "frame_idx", *RESULT_COLUMNS]
    kept, key = Tracks(1), None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(c) for c in ("video_id", "segment")]
        change = np.zeros(n, bool)
        for c in columns:
            codes = np.asarray(c.dictionary_encode("encode").indices)
            change[1:] |= codes[1:] != codes[:-1]
        first = [c[0].as_py() for c in columns]
        change[0] = True
        start = np.flatnonzero(change)
        size = np.diff(np.append(start, n))
        tracks = Tracks(len(start))
        if first == key:
            tracks.copy_from(0, kept, 0)
        work = FrameBatch(batch)
        at = np.argsort(-size, kind="stable")
        for t in range(size.max()):
            at = at[: np.searchsorted(-size[at], -t, "left")]
            work.step(tracks, start[at] + t, at, cfg)
        kept.copy_from(0, tracks, len(start) - 1)
        key = [c[n - 1].as_py() for c in columns]
        yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("frame_idx"), *work.results(cfg)], names)


def track(
    frames: DataFrame,
    scored: DataFrame,
    cfg: TrackerConfig = TrackerConfig(),
    tier2: DataFrame | None = None,
    bucket_rows: int = 4096,
) -> DataFrame:
    """Tracked detection for every frame of every capture.

    ``scored`` holds scored candidates or, as ``cands``, those of :func:`frame_candidates`; ``tier2`` lists quads that replace the
    tracked one after their frame. Candidates by frame are written once: segments come from narrow rows that know only whether a
    frame has any, and the candidates join their frame after that. Rows are then dealt by capture and segment, so a capture
    with gaps is spread; a task streams its rows in order.
    """
    key = _frame_key(dict(frames.dtypes))
    grouped = written((scored if "cands" in scored.columns else frame_candidates(scored)).select("video_id", "frame_idx", "cands"), "frames")
    over = None if tier2 is None else written(tier2.select("video_id", "frame_idx", "corners").filter(F.size("corners") == 4), "tier2")
    cut = track_segments(frame_rows(frames, grouped, over, bucket_rows), cfg.max_frames_lost).select(key, "frame_w", "frame_h", "segment")
    joined = cut.join(grouped.select(key, "cands"), "__frame", "left")
    if over is None:
        joined = joined.withColumn("tier2", F.lit(None).cast("array<double>"))
    else:
        joined = joined.join(over.select(key, flat(F.col("corners")).alias("tier2")), "__frame", "left")
    rows = joined.select("__frame.video_id", "__frame.frame_idx", "frame_w", "frame_h", "cands", "tier2", "segment")
    types = dict(rows.dtypes)
    ordered = rows.repartition("video_id", "segment").sortWithinPartitions("video_id", "segment", "frame_idx")
    schema = f"video_id {types['video_id']}, frame_idx {types['frame_idx']}, {RESULT_SCHEMA}"

    def scan(batches):
        return _lockstep(batches, cfg)

    return ordered.mapInArrow(scan, schema)


def linear_scan(decay: np.ndarray, value: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solve ``s[t] = value[t] + decay[t] * s[t - 1]`` from zero within runs of rows, ``place`` counting from 0 in each.

    Pairs (decay, sum) combine associatively, so spans double: after k steps a row covers 2**k rows of its run. Returns
    the product of decays since the start of the run, and the sums.
    """
    decay, total, span = decay.copy(), value.copy(), 1
    longest = int(place.max(initial=-1))
    while span <= longest:
        reach = np.flatnonzero(place >= span)
        total[reach], decay[reach] = total[reach] + decay[reach] * total[reach - span], decay[reach] * decay[reach - span]
        span *= 2
    return decay, total


def _recurrence(batches, group, until: str):
    """``s = x + decay * s`` along sorted rows; a new group starts from its first ``seed``.

    ``until`` says whether the value after the row or before it is reported. A group may go on in the next batch.
    """
    key, carried, seen = None, 0.0, 0
    for pdf in batches:
        if not len(pdf):
            continue
        codes = pdf.groupby(group, sort=False, dropna=False).ngroup().to_numpy()
        new = np.r_[True, codes[1:] != codes[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(len(pdf)), 0))
        place = np.arange(len(pdf)) - start
        entering = pdf["__seed"].to_numpy(float)[start]
        first = pdf[group].iloc[:1].to_numpy().tolist()
        before_batch = np.zeros(len(pdf), np.int64)
        if first == key:
            own = start == 0
            entering, before_batch = np.where(own, carried, entering), np.where(own, seen, 0)
        decay, total = linear_scan(pdf["__decay"].to_numpy(float), pdf["__x"].to_numpy(float), place)
        after = total + decay * entering
        index = place + 1 + before_batch
        key, carried, seen = pdf[group].iloc[-1:].to_numpy().tolist(), after[-1], int(index[-1])
        before = np.where(new, entering, np.r_[0.0, after[:-1]])
        yield pdf.assign(__s=before if until == "before" else after, __i=index)


def ema(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.7, name: str = "ema", width: int = 4096) -> DataFrame:
    """Exponential smoothing ``s_t = a x_t + (1 - a) s_{t-1}`` that starts at the first value.

    The smoothing is linear: every bucket of about ``width`` rows is scanned on its own
    from zero, and the state entering a bucket adds a decayed multiple to its rows.
    One row per bucket carries the state along the capture.
    """
    keep = 1.0 - alpha
    base = order_buckets(df, [key], order, width).withColumns(
        {
            "__x": F.lit(alpha) * F.col(value).cast("double"),
            "__decay": F.lit(keep),
            "__seed": F.lit(0.0),
        }
    )
    kinds = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    key_kind, bucket_kind = dict(df.dtypes)[key], dict(base.dtypes)["__bucket"]

    def inside(batches):
        return _recurrence(batches, [key, "__bucket"], "after")

    def across(batches):
        return _recurrence(batches, [key], "before")

    local = (
        base.repartition(key, "__bucket")
        .sortWithinPartitions(key, "__bucket", order)
        .mapInPandas(inside, f"{kinds}, __s double, __i long")
    )
    ends = local.groupBy(key, "__bucket").agg(
        F.max_by("__s", "__i").alias("__x"),
        F.pow(F.lit(keep), F.max("__i")).alias("__decay"),
        F.min_by(F.col(value).cast("double"), "__i").alias("__seed"),
    )
    entering = (
        ends.repartition(key)
        .sortWithinPartitions(key, "__bucket")
        .mapInPandas(across, f"`{key}` {key_kind}, __bucket {bucket_kind}, __x double, __decay double, __seed double, __s double, __i long")
        .select(key, "__bucket", F.col("__s").alias("__in"))
    )
    smoothed = F.col("__s") + F.col("__in") * F.pow(F.lit(keep), F.col("__i"))
    return null_safe(local, entering, [key, "__bucket"]).select(*df.columns, smoothed.alias(name))
