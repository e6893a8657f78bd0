"""The tracker against a plain frame-by-frame version, and the scan behind smoothing."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from captura.functions.polygons import quad_iou_arrays
from captura.operators.grouping import order_buckets
from captura.operators.tracking import TrackerConfig, ema, frame_candidates, frame_rows, linear_scan, track, track_segments

QUAD = "array<struct<x:double,y:double>>"
CANDS = f"video_id string, frame_idx long, cand_id int, corners {QUAD}, area double, aspect_ratio double, static_score double"
FRAMES = "video_id string, frame_idx long, frame_w int, frame_h int"
TIER2 = f"video_id string, frame_idx long, corners {QUAD}"


def ordered(q):
    total, difference = [x + y for x, y in q], [y - x for x, y in q]
    at = lambda v, best: q[v.index(best(v))]
    return [at(total, min), at(difference, min), at(total, max), at(difference, max)]


def plain_tracker(frames, cands, tier2, cfg):
    """(video, frame) -> (method, box, confidence, static, temporal), one frame at a time."""
    out, state, lost, video = {}, None, 0, object()
    for v, f, w, h in sorted(frames, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if v != video:
            state, lost, video = None, 0, v
        rows = sorted((c for c in cands if c[:2] == (v, f)), key=lambda c: (-c[6], c[2]))
        rated = []
        for _, _, _, quad, area, aspect, static in rows:
            q = ordered(quad)
            similar, fused = 1.0, static
            if state and cfg.temporal_enabled:
                last, last_area, last_aspect = state
                diagonal = max(1.0, math.hypot(w, h))
                mean = lambda p: (sum(x for x, _ in p) / 4, sum(y for _, y in p) / 4)
                centre = max(0.0, 1 - math.dist(mean(q), mean(last)) / diagonal / cfg.max_center_displacement)
                corner = max(0.0, 1 - sum(map(math.dist, q, last)) / 4 / diagonal / cfg.max_corner_displacement)
                ratio = min(area, last_area) / max(area, last_area) if area > 0 and last_area > 0 else None
                s_area = 0.5 if ratio is None else ratio if ratio >= 1 - cfg.max_area_change else ratio / 2
                s_aspect = max(0.0, 1 - 2.5 * abs(aspect - last_aspect)) if aspect > 0 and last_aspect > 0 else 0.5
                iou = quad_iou_arrays(np.array([q]), np.array([last]))[0]
                similar = min(1.0, max(0.0, 0.35 * iou + 0.3 * corner + 0.15 * centre + 0.1 * s_area + 0.1 * s_aspect))
                fused = (1 - cfg.temporal_weight) * static + cfg.temporal_weight * similar
            rated.append((round(min(1.0, max(0.0, fused)), 4), round(similar, 4), static, q, area, aspect))
        best = max(rated, key=lambda r: r[0], default=None)
        if best is None or best[0] < cfg.min_tracking_score:
            out[v, f] = ("no_candidates", None, 0.0, 0.0, 0.0) if best is None else ("rejected_low_confidence", None, best[0], best[2], best[1])
            lost += 1
            if lost > cfg.max_frames_lost:
                state, lost = None, 0
        else:
            guided = state is not None and cfg.temporal_enabled
            a = cfg.smoothing_alpha
            q = [(a * x + (1 - a) * u, a * y + (1 - a) * z) for (x, y), (u, z) in zip(best[3], state[0])] if guided else best[3]
            state, lost = (q, best[4], best[5]), 0
            edge = lambda k, pick, top: max(0, min(top - 1, round(pick(p[k] for p in q))))
            box = [edge(0, min, w), edge(1, min, h), edge(0, max, w), edge(1, max, h)]
            out[v, f] = ("temporally_guided" if guided else "first_frame_detection", box, best[0], best[2], best[1])
        if (v, f) in tier2:
            q = ordered(tier2[v, f])
            sides = math.dist(q[1], q[0]), math.dist(q[3], q[0])
            area = abs(sum(q[i][0] * q[i - 3][1] - q[i - 3][0] * q[i][1] for i in range(4))) / 2
            state, lost = (q, area, max(sides) / max(1.0, min(sides))), 0
    return out


def sequences(seed, videos=("a", "b", None), frames=60):
    rng = random.Random(seed)
    rows, cands, tier2 = [], [], {}
    for v in videos:
        x, y, index = 100.0, 100.0, 0
        for _ in range(frames):
            index += rng.choice([1, 1, 1, 7, 10**6])
            rows.append((v, index, 640, 480))
            x, y = x + rng.uniform(-9, 9), y + rng.uniform(-9, 9)
            quiet = rng.random() < 0.12 or (len(rows) % 30 > 20)
            for c in range(0 if quiet else rng.randint(0, 3)):
                dx, dy, w, h = rng.uniform(-30, 30), rng.uniform(-30, 30), rng.uniform(150, 300), rng.uniform(90, 200)
                quad = [(x + dx + w, y + dy + 3.0), (x + dx, y + dy), (x + dx - 4, y + dy + h), (x + dx + w, y + dy + h + 5)]
                cands.append((v, index, c, quad, rng.choice([0.0, w * h]), w / h, round(rng.choice([0.1, 0.5, rng.random()]), 2)))
            if rng.random() < 0.08:
                tier2[v, index] = [(x + 200, y), (x, y), (x, y + 120), (x + 200, y + 120)]
    return rows, cands, tier2


def tables(spark, rows, cands, tier2):
    second = spark.createDataFrame([(*k, q) for k, q in tier2.items()], TIER2) if tier2 is not None else None
    return spark.createDataFrame(rows, FRAMES), spark.createDataFrame(cands, CANDS), second


@pytest.mark.parametrize("cfg", [TrackerConfig(), TrackerConfig(max_frames_lost=0), TrackerConfig(temporal_enabled=False, min_tracking_score=0.45)])
@pytest.mark.parametrize("bucket_rows", [4096, 5])
def test_tracker_equals_plain_version(spark, cfg, bucket_rows):
    rows, cands, tier2 = sequences(2)
    frames, scored, second = tables(spark, rows, cands, tier2)
    got = {(r.video_id, r.frame_idx): r for r in track(frames, scored, cfg, second, bucket_rows).collect()}
    want = plain_tracker(rows, cands, tier2, cfg)
    assert set(got) == set(want) and len({w[0] for w in want.values()}) >= 3
    for k, (method, box, confidence, static, temporal) in want.items():
        r = got[k]
        assert (r.method, r.bbox, r.detected) == (method, box, box is not None), k
        assert (r.confidence, r.static_score, r.temporal_score) == pytest.approx((confidence, static, temporal), abs=1.1e-4)
        assert (r.corners is None) == (box is None) and (r.reason is None) == (box is not None)


def test_tracker_without_take_over_differs(spark):
    rows, cands, tier2 = sequences(2)
    frames, scored, second = tables(spark, rows, cands, tier2)
    methods = lambda t2: {(r.video_id, r.frame_idx): (r.method, r.confidence) for r in track(frames, scored, tier2=t2).collect()}
    assert methods(second) != methods(None)


def test_take_over_inside_lost_frames(spark):
    """A take-over amid empty frames keeps the history that the gap would have erased, and cuts no segment."""
    card = [(100.0, 100.0), (400.0, 100.0), (400.0, 290.0), (100.0, 290.0)]
    rows = [("v", f, 640, 480) for f in range(12)]
    cands = [("v", f, 0, card, 57000.0, 1.579, 0.7) for f in (0, 8)]
    frames, scored, second = tables(spark, rows, cands, {("v", 4): card})
    lone = {r.frame_idx: r.method for r in track(frames, scored).collect()}
    both = {r.frame_idx: r.method for r in track(frames, scored, tier2=second).collect()}
    assert lone[8] == "first_frame_detection" and both[8] == "temporally_guided"
    segments = track_segments(frame_rows(frames, scored, second), 5).select("segment").distinct().collect()
    assert [s.segment for s in segments] == [None]


def test_capture_with_gaps_is_spread(spark):
    """Frames far apart in number and in stretches of their own get a segment for each stretch."""
    rows = [("v", 10**6 * f, 640, 480) for f in range(400)]
    card = [(100.0, 100.0), (400.0, 100.0), (400.0, 290.0), (100.0, 290.0)]
    cands = [("v", 10**6 * f, 0, card, 57000.0, 1.579, 0.7) for f in range(400) if f % 10 < 3]
    frames, scored, _ = tables(spark, rows, cands, None)
    for bucket_rows in (4096, 32):
        sizes = track_segments(frame_rows(frames, scored, bucket_rows=bucket_rows), 5).groupBy("segment").count().collect()
        assert len(sizes) >= (40 if bucket_rows == 4096 else 20) and max(r["count"] for r in sizes) <= 50


def test_order_buckets_of_sparse_values(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, None).otherwise(F.lit("v")).alias("k"), (F.col("id") * F.col("id") * 1000).alias("f"))
    df = df.union(spark.createDataFrame([("few", 5), ("few", 10**12)], "k string, f long"))
    sizes = order_buckets(df, ["k"], "f", 500).groupBy("k", "__bucket").agg(F.count("*").alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi")).collect()
    hot = sorted((r for r in sizes if r.k == "v"), key=lambda r: r["__bucket"])
    assert len(hot) > 15 and max(r.n for r in hot) < 2500
    assert all(a.hi < b.lo for a, b in zip(hot, hot[1:]))
    assert sum(r.n for r in sizes) == 20_002 and [r.n for r in sizes if r.k == "few"] == [2]
    assert len([r for r in sizes if r.k is None]) > 3


def test_linear_scan():
    rng = np.random.default_rng(1)
    place = np.concatenate([np.arange(n) for n in (1, 7, 300, 2)])
    decay, value = rng.random(len(place)), rng.random(len(place))
    product, total = linear_scan(decay, value, place)
    s = d = 0.0
    for t, first in enumerate(place == 0):
        s, d = (value[t], decay[t]) if first else (value[t] + decay[t] * s, decay[t] * d)
        assert total[t] == pytest.approx(s) and product[t] == pytest.approx(d)


def test_smoothing_of_null_capture_and_sparse_frames(spark):
    rows = [(k, i * i * 977, float(i % 7)) for k in ("a", None) for i in range(200)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx long, x double")
    got = {(r.video_id, r.frame_idx): r.ema for r in ema(df, "video_id", "frame_idx", "x", width=16).collect()}
    assert len(got) == 400
    s = 0.0
    for i in range(200):
        s = 0.7 * (i % 7) + 0.3 * s if i else 0.0
        assert got["a", i * i * 977] == pytest.approx(s) and got[None, i * i * 977] == pytest.approx(s)


def test_segments_come_from_narrow_rows(spark):
    """Candidates by frame give the tracks of single candidates, and do not pass the windows that look for gaps."""
    rows, cands, tier2 = sequences(3)
    frames, scored, second = tables(spark, rows, cands, tier2)
    assert "cands" not in track_segments(frame_rows(frames, scored, second), 5).columns
    grouped = frame_candidates(scored)
    shown = lambda df: sorted(str(r) for r in df.collect())
    assert shown(track(frames, grouped, tier2=second)) == shown(track(frames, scored, tier2=second))
