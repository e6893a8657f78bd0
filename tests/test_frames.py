import numpy as np
import pytest
from pyspark.sql import functions as F

from captura.functions.geometry import score_area_ratio, score_aspect_ratio
from captura.functions.polygons import quad_iou_arrays
from captura.operators import candidates as C
from captura.operators import evaluation as E
from captura.operators import gates as A
from captura.operators import splits as S
from captura.operators.frames import map_frames
from captura.operators.grouping import percentiles
from captura.operators.localization import against_truth
from captura.operators.sampling import frame_schedule, sample_frames
from captura.operators.temporal import anomalous_transitions, mean_pairwise_similarity, temporal_consistency
from captura.operators.tracking import track


def box(x1, y1, x2, y2):
    return [(float(x1), float(y1)), (float(x2), float(y1)), (float(x2), float(y2)), (float(x1), float(y2))]


QUAD = "array<struct<x:double,y:double>>"


def test_quad_overlap():
    a = np.array([box(0, 0, 100, 100)])
    shifted = lambda dx, dy: np.array([box(dx, dy, 100 + dx, 100 + dy)])
    assert quad_iou_arrays(a, a)[0] == pytest.approx(1.0)
    assert quad_iou_arrays(a, shifted(500, 0))[0] == 0.0
    assert quad_iou_arrays(a, shifted(50, 0))[0] == pytest.approx(1 / 3)
    assert quad_iou_arrays(a, shifted(10, 0))[0] == pytest.approx(9 / 11)
    diamond = np.array([[(50.0, -20.0), (120.0, 50.0), (50.0, 120.0), (-20.0, 50.0)]])
    corner = 4 * (30 * 30) / 2
    assert quad_iou_arrays(a, diamond)[0] == pytest.approx((10000 - corner) / (10000 + 9800 - (10000 - corner)))
    assert quad_iou_arrays(a, diamond[:, ::-1])[0] == pytest.approx(quad_iou_arrays(diamond, a)[0])


def test_overlap_of_rough_quads():
    """Concave quads and quads that cross themselves, against counts on a grid (even-odd rule)."""
    rng = np.random.default_rng(4)
    xs, ys = np.meshgrid(np.arange(0.25, 100, 0.5), np.arange(0.25, 100, 0.5))

    def inside(q):
        out = np.zeros(xs.shape, bool)
        for (x1, y1), (x2, y2) in zip(q, np.roll(q, -1, axis=0)):
            with np.errstate(divide="ignore", invalid="ignore"):
                out ^= ((y1 > ys) != (y2 > ys)) & (xs < (x2 - x1) * (ys - y1) / (y2 - y1) + x1)
        return out

    quads = rng.uniform(5, 95, (60, 2, 4, 2))
    got = quad_iou_arrays(quads[:, 0], quads[:, 1])
    for (a, b), value in zip(quads, got):
        p, q = inside(a), inside(b)
        assert value == pytest.approx((p & q).sum() / max(1, (p | q).sum()), abs=0.02)


def test_quality_against_truth(spark):
    det = spark.createDataFrame(
        [("v", 1, True, box(3, 4, 103, 104)), ("v", 2, False, None), ("v", 3, True, box(0, 0, 9, 9))],
        f"video_id string, frame_id int, detected boolean, corners {QUAD}",
    )
    truth = spark.createDataFrame(
        [("v", 1, box(0, 0, 100, 100)), ("v", 2, box(0, 0, 1, 1))], f"video_id string, frame_id int, corners {QUAD}"
    )
    got = {r.frame_id: r for r in against_truth(det, truth).collect()}
    assert got[1].mean_corner_error == pytest.approx(5.0) and 0.8 < got[1].iou < 0.9
    assert got[2].iou == 0.0 and got[2].mean_corner_error is None
    assert got[3].iou == 0.0 and not got[3].has_truth


CAND = f"video_id string, frame_id int, cand_id int, corners {QUAD}, area double, aspect_ratio double, edge_quality double, frame_h int, frame_w int"


def test_nesting_ranks_inner_card_first(spark):
    rows = [
        ("v", 1, 0, box(50, 50, 750, 750), 490000.0, 1.0, 0.5, 800, 800),
        ("v", 1, 1, box(200, 250, 600, 502), 100800.0, 1.587, 0.5, 800, 800),
    ]
    for tile in (128, 1):
        scored = C.score_candidates(spark.createDataFrame(rows, CAND), tile_rows=tile)
        got = {r.cand_id: r for r in scored.collect()}
        assert got[1].is_nested and got[1].nested_parent_idx == 0 and got[0].encloses_count == 1
        assert got[1].static_score > got[0].static_score
    assert [r.cand_id for r in C.best_candidate(scored).collect()] == [1]


def test_suppression_paths_agree(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        x, y = (int(v) for v in rng.integers(0, 40, 2))
        rows.append(("v", 1, i, [x, y, x + 100, y + 80], float(rng.integers(0, 30)) / 30))
    df = spark.createDataFrame(rows, "video_id string, frame_id int, cand_id int, bbox array<int>, confidence double")

    def iou(a, b):
        inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return inter / (2 * 8000 - inter)

    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[2])):
        if all(iou(r[3], k[3]) <= 0.7 for k in kept):
            kept.append(r)
    want = {k[2] for k in kept}
    assert {r.cand_id for r in C.nms(df).collect()} == want


def test_shape_scores(spark):
    row = spark.range(1).select(
        *[score_aspect_ratio(F.lit(a)).alias(f"a{i}") for i, a in enumerate((1.586, 1.42, 1.62, 1.05, 2.6))],
        *[score_area_ratio(F.lit(a)).alias(f"r{i}") for i, a in enumerate((0.30, 0.20, 0.80))],
    ).first()
    assert row.a0 > 0.99 and row.a1 > 0.99 and row.a2 > 0.95 and row.a2 > max(row.a3, row.a4)
    assert row.r0 > 0.9 and row.r1 > 0.7 and row.r2 < 0.2


def test_gate_reasons(spark):
    card = box(100, 100, 600, 415)
    rows = [
        (0, True, 0.77, 380000.0, 1.42, 0, card, 1000, 1000),
        (1, True, 0.64, 151500.0, 1.62, 0, card, 1000, 1600),
        (2, True, 0.85, 250000.0, 1.58, 2, card, 1000, 1000),
        (3, True, 0.72, 160000.0, 2.45, 0, card, 1000, 1000),
        (4, True, 0.78, 150000.0, 1.586, 0, card, 1000, 1600),
        (5, False, 0.0, 0.0, 0.0, 0, None, 1000, 1600),
    ]
    df = spark.createDataFrame(
        rows,
        f"id int, detected boolean, static_score double, area double, aspect_ratio double, encloses_count int, corners {QUAD}, frame_h int, frame_w int",
    )
    got = {r.id: r for r in A.apply_gates(df).collect()}
    assert [got[i].invoke_tier2 for i in range(6)] == [True, False, True, True, False, True]
    assert got[0].reason == "carrier_area_exceeded (0.380 > 0.35)"
    assert got[1].reason == "confident_opencv_candidate" and got[1].signals.is_pristine
    assert got[2].reason == "encloses_inner_quad_container"
    assert got[3].reason.startswith("aspect_ratio_deviation") and got[5].reason == "opencv_not_detected"


def test_tracker_states(spark):
    frames, cands = [], []
    for f in range(10):
        frames.append(("v", f, 640, 480))
    card = lambda dx, dy: box(100 + dx, 100 + dy, 400 + dx, 290 + dy)
    cands.append(("v", 0, 0, card(0, 0), 57000.0, 1.579, 0.7))
    cands.append(("v", 1, 0, card(4, 2), 57000.0, 1.579, 0.7))
    cands.append(("v", 1, 1, box(20, 20, 600, 450), 249400.0, 1.349, 0.5))
    cands.append(("v", 8, 0, card(0, 0), 57000.0, 1.579, 0.7))
    cands.append(("v", 9, 0, card(0, 0), 57000.0, 1.579, 0.1))
    frame_df = spark.createDataFrame(frames + [("w", 0, 640, 480)], "video_id string, frame_idx int, frame_w int, frame_h int")
    scored = spark.createDataFrame(
        cands, f"video_id string, frame_idx int, cand_id int, corners {QUAD}, area double, aspect_ratio double, static_score double"
    )
    got = {(r.video_id, r.frame_idx): r for r in track(frame_df, scored).collect()}
    assert got["v", 0].method == "first_frame_detection" and got["v", 1].method == "temporally_guided"
    assert 100 <= got["v", 1].corners[0].x <= 104 and 100 <= got["v", 1].corners[0].y <= 102
    assert got["v", 1].corners[0].x == pytest.approx(0.7 * 104 + 0.3 * 100)
    assert all(got["v", f].method == "no_candidates" for f in range(2, 8))
    assert got["v", 8].method == "first_frame_detection" and got["w", 0].method == "no_candidates"
    assert got["v", 9].detected and len(got) == 11


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "video_id string, frame_idx int, vec array<float>")


def test_temporal(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("x", i, v) for i, v in enumerate((a, a, b, a))] + [("y", 0, a), ("y", 1, None)] + [("z", i, a) for i in range(4)]
    emb = _vectors(spark, rows)
    got = {r.video_id: r for r in temporal_consistency(emb).collect()}
    assert got["z"].temporal_consistency_score == 1.0 and got["z"].is_consistent
    assert got["x"].num_anomalies == 2 and not got["x"].is_consistent
    assert got["y"].status == "insufficient_frames" and got["y"].temporal_consistency_score == 0.0
    assert (1, 2) in {(r.frame_a, r.frame_b) for r in anomalous_transitions(emb).collect()}


def test_buckets_and_tiles_do_not_change_results(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(50, 6))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    emb = spark.createDataFrame(
        [("v", int(i * 13), [float(x) for x in v]) for i, v in enumerate(vectors)],
        "video_id string, frame_idx int, vec array<double>",
    )
    dots = np.clip(vectors @ vectors.T, 0, 1)
    want = dots[np.triu_indices(50, 1)].mean()
    for rows in (256, 7):
        assert mean_pairwise_similarity(emb, tile_rows=rows).first().mean_pairwise == pytest.approx(want, abs=1e-12)
    from captura.operators.temporal import consecutive_similarity

    pairs = {(r.frame_a, r.frame_b): r.similarity for r in consecutive_similarity(emb, width=40).collect()}
    assert len(pairs) == 49
    assert all(abs(pairs[i * 13, (i + 1) * 13] - dots[i, i + 1]) < 1e-4 for i in range(49))


def test_tiles_keep_null_groups(spark):
    rows = [(k, i, [1.0, i / 20.0]) for k, n in (("a", 12), (None, 3), ("b", 1)) for i in range(n)]
    emb = spark.createDataFrame(rows, "video_id string, frame_idx int, vec array<double>")
    wide = {r.video_id: r.mean_pairwise for r in mean_pairwise_similarity(emb, tile_rows=10_000).collect()}
    for size in (2, 8):
        got = {r.video_id: r.mean_pairwise for r in mean_pairwise_similarity(emb, tile_rows=size).collect()}
        assert set(got) == {"a", None, "b"} and got == pytest.approx(wide)


def test_null_groups_keep_their_medians(spark):
    from captura.operators.evaluation import score_stats

    df = spark.createDataFrame([(None, 0.9), (None, 0.8), ("a", 0.2)], "k string, y_score double")
    got = {r.k: r.median for r in score_stats(df, ["k"]).collect()}
    assert got[None] == pytest.approx(0.85) and got["a"] == pytest.approx(0.2)


def test_plugin_model_sees_each_row_once(spark):
    from captura.operators.frames import map_frames

    calls = spark.sparkContext.accumulator(0)

    def build():
        def model(pdf):
            calls.add(len(pdf))
            return pdf.assign(y=pdf["frame_idx"] * 2)

        return model

    df = spark.createDataFrame([("v", i) for i in range(10)], "video_id string, frame_idx int")
    good, bad = map_frames(df, build, "y int")
    assert good.count() == 10 and bad.count() == 0 and calls.value == 10


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    values = np.round(rng.random(200), 2)
    df = spark.createDataFrame([("g", float(v)) for v in values], "k string, x double")
    row = percentiles(df, ["k"], "x", {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    assert [row.a, row.b, row.c] == pytest.approx(np.percentile(values, [10, 50, 90]).tolist())


def test_schedule(spark):
    df = spark.range(0, 60)
    for k in (1, 4, 10):
        for r in df.select("id", frame_schedule(F.col("id"), k).alias("s")).collect():
            n = r.id
            want = sorted(set(np.linspace(0, n - 1, min(n, k), dtype=int).tolist())) if n else []
            assert r.s == want
    frames = spark.createDataFrame([("v", i * 3) for i in range(23)], "video_id string, frame_idx int")
    want = [int(i) * 3 for i in np.linspace(0, 22, 5, dtype=int)]
    assert sorted(r.frame_idx for r in sample_frames(frames, 5, width=10).collect()) == want


def test_metrics(spark):
    cases = {
        "perfect": ([0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 1, 1], [0.1, 0.05, 0.2, 0.9, 0.85, 0.95]),
        "inverted": ([0, 0, 1, 1], [1, 1, 0, 0], [0.9, 0.8, 0.1, 0.2]),
        "mixed": ([0, 0, 0, 1, 1], [0, 0, 1, 1, 0], [0.2, 0.3, 0.7, 0.8, 0.4]),
        "single": ([0], [0], [0.1]),
    }
    rows = [(e, *r) for e, cols in cases.items() for r in zip(*cols)]
    df = spark.createDataFrame(rows, "experiment_id string, y_true int, y_pred int, y_score double")
    got = {r.experiment_id: r for r in E.binary_metrics(df, ["experiment_id"]).collect()}
    assert got["perfect"].accuracy == got["perfect"].f1_score == got["perfect"].roc_auc == 1.0
    assert got["inverted"].f1_score == 0.0 and got["inverted"].false_positive_rate == 1.0 and got["inverted"].roc_auc == 0.0
    m = got["mixed"]
    assert (m.tn, m.fp, m.fn, m.tp) == (2, 1, 1, 1)
    assert (m.false_positive_rate, m.false_negative_rate, m.f1_score, m.accuracy) == (0.3333, 0.5, 0.5, 0.6)
    assert got["single"].roc_auc is None
    empty = E.binary_metrics(df.filter("false")).first()
    assert empty.total_samples == 0 and empty.accuracy == 0.0 and empty.roc_auc is None


def test_leak_free_split(spark):
    rows = [(f"{c}{d}", lab, d * 10 + f) for c, lab in (("r", 0), ("a", 1)) for d in range(10) for f in range(4)]
    df = spark.createDataFrame(rows, "doc_id string, label int, pos int")
    first = {r.doc_id: r.split for r in S.grouped_split(df).collect()}
    again = {r.doc_id: r.split for r in S.grouped_split(df.repartition(7)).collect()}
    assert first == again and S.grouped_split(df).count() == 80
    assert S.leakage(S.grouped_split(df)).first().is_leak_free
    sizes = {s: sum(v == s for v in first.values()) for s in ("train", "val", "test")}
    assert sizes == {"train": 14, "val": 4, "test": 2}
    with pytest.raises(ValueError):
        S.document_splits(df, ratios=(0.5, 0.1, 0.1))


def test_plugin_failures_are_kept(spark):
    df = spark.createDataFrame([("v", i) for i in range(10)], "video_id string, frame_idx int")

    def build():
        def model(pdf):
            if (pdf["frame_idx"] == 3).any():
                raise ValueError("bad frame")
            return pdf.assign(score=pdf["frame_idx"] * 2.0)[["score"]]

        return model

    good, bad = map_frames(df, build, "score double")
    assert sorted(r.frame_idx for r in good.collect()) == [i for i in range(10) if i != 3]
    assert [(r.frame_idx, r.reason) for r in bad.collect()] == [(3, "ValueError: bad frame")]


def test_smoothing_matches_sequential_fold(spark):
    from captura.operators.tracking import ema

    rng = np.random.default_rng(11)
    rows = [(v, int(f), float(x)) for v in ("a", "b") for f, x in zip(np.cumsum(rng.integers(1, 9, 40)), rng.random(40) * 1e5)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx long, x double")
    want, state = {}, {}
    for v, f, x in rows:
        state[v] = x if v not in state else 0.7 * x + 0.3 * state[v]
        want[v, f] = state[v]
    for width in (10, 4096):
        got = {(r.video_id, r.frame_idx): r.ema for r in ema(df, "video_id", "frame_idx", "x", width=width).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_suppression_reads_its_input_once(spark):
    rows = [(1, 1, k, [dict(x=10.0 + k, y=10.0), dict(x=400.0, y=10.0), dict(x=400.0, y=260.0), dict(x=10.0, y=260.0)], 9e4, 1600, 1000) for k in range(3)]
    df = spark.createDataFrame(rows, "video_id int, frame_id int, cand_id int, corners array<struct<x:double,y:double>>, area double, frame_w int, frame_h int")
    kept = C.nms(C.validate_quads(df))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert kept.count() == 1 and kept.columns == C.validate_quads(df).columns


def test_suppression_of_frames_across_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sizes = [1, 3, 150, 2, 7, 64, 65, 30, 1, 1, 40]
    frame = np.repeat(np.arange(len(sizes)), sizes)
    low = rng.integers(0, 40, (len(frame), 2))
    box = np.hstack([low, low + rng.integers(-2, 30, (len(frame), 2))])
    box[5:25] = box[5]  # copies
    want = []
    for f in range(len(sizes)):
        kept = []
        for n in np.flatnonzero(frame == f):
            x = box[n].astype(float)

            def share(k):
                inter = max(0, min(x[2], k[2]) - max(x[0], k[0])) * max(0, min(x[3], k[3]) - max(x[1], k[1]))
                union = (x[2] - x[0]) * (x[3] - x[1]) + (k[2] - k[0]) * (k[3] - k[1]) - inter
                return inter / union if union > 0 else 0.0

            if not any(share(k) > 0.5 for k in kept):
                kept.append(x)
                want.append(int(n))
    table = pa.table({"video_id": pa.array([None if f == 3 else int(f) for f in frame], pa.int32()), "cand_id": np.arange(len(frame)), "bbox": pa.array(box.tolist(), pa.list_(pa.int32()))})
    for step in (1, 7, 64, 1000):
        out = C._scan_duplicates(iter(table.to_batches(max_chunksize=step)), ["video_id"], 0.5)
        assert [n for b in out for n in b.column("cand_id").to_pylist()] == want
