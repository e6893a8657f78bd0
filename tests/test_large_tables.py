"""Steps that large tables brought to their limits, against brute force on small ones."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from captura.functions.polygons import quad_iou_arrays
from captura.operators import candidates as C
from captura.operators import gates as A
from captura.operators import localization as L
from captura.operators.grouping import percentiles
from captura.operators.temporal import consecutive_similarity
from captura.plans import catalog_geometry as G
from captura.plans import catalog_sets as S
from captura.plans import views as V
from captura.plans.registry import ORACLES
from captura.operators.tracking import track
from captura.streaming.live import ROCKSDB, run_to_table, similarity_stream, track_stream

CANDIDATES = "video_id long, frame_id string, cand_id int, corners array<struct<x:double,y:double>>, area double"


def _boxes(sizes, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for n, (frame, size) in enumerate(sizes.items()):
        for c in range(size):
            x, y, w, h = (float(v) for v in rng.integers(1, 60, 4))
            corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if c % 7 != 6 else None
            rows.append((None if n % 3 == 2 else n % 2, frame, c, corners, w * h))
    return rows


def _nested(rows):
    out = {}
    for v, f, c, q, area in rows:
        outer = [r for r in rows if r[:2] == (v, f) and r[3] and q and area < 0.85 * r[4] and all(r[3][0][0] <= x <= r[3][2][0] and r[3][0][1] <= y <= r[3][2][1] for x, y in q)]
        inner = [r for r in rows if r[:2] == (v, f) and r[3] and q and r[4] < 0.85 * area and all(q[0][0] <= x <= q[2][0] and q[0][1] <= y <= q[2][1] for x, y in r[3])]
        out[v, f, c] = (max((r[2] for r in outer), default=None), len(inner))
    return out


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_nesting_in_order_and_over_tiles(spark, batch):
    rows = _boxes({"a": 5, "b": 41, "c": 1, None: 9, "d": 8, "e": 30, "f": 3})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = C.nesting(spark.createDataFrame(rows, CANDIDATES), tile_rows=8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.video_id, r.frame_id, r.cand_id): (r.nested_parent_idx, r.encloses_count) for r in got} == _nested(rows)
    assert len(got) == len(rows) and all(r.is_nested == (r.nested_parent_idx is not None) for r in got)


def test_small_frames_pass_one_shuffle_before_they_are_written(spark, monkeypatch):
    plans = []
    keep = C.written
    monkeypatch.setattr(C, "written", lambda df, kind: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, kind))[1])
    C.nesting(spark.createDataFrame(_boxes({"a": 5}), CANDIDATES))
    assert plans[0].count("Exchange") == 1 and "MapInArrow" in plans[0]


@pytest.fixture
def items(spark, tmp_path):
    """Order lines with keys of large tables: suppliers beyond four digits."""
    real = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    table = real.withColumns({"l_suppkey": F.col("l_suppkey") * 977 + 9_990, "l_orderkey": F.col("l_orderkey") + 5_100})
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    return str(tmp_path), con


def test_annotations_of_suppliers_beyond_four_digits(spark, items):
    folder, con = items
    names = S.inventory(spark, folder).columns
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['s07_j02_j04_inventory']})").fetchall()
    got = [tuple(r) for r in S.inventory(spark, folder).collect()]
    assert len({r[-1] for r in got}) == 2 and sorted(got) == sorted(want)


def test_truth_has_the_bits_of_its_sql(spark, items):
    folder, con = items
    want = dict(con.execute(f"WITH {V.SQL_CORNERS}, {G._TRUTH_SQL} SELECT frame_id, ty2 FROM truth").fetchall())
    got = {r.frame_id: r.corners[2].y for r in G._truth(spark, folder).collect()}
    assert got == want


def test_percentiles_sort_only_the_buckets_of_their_ranks(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.random(900), None: rng.integers(0, 3, 500) / 2.0, "c": rng.random(7) * 9 - 4, "d": np.array([0.25])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)]
    wanted = {"p05": 0.05, "mid": 0.5, "p99": 0.99}
    got = {r.k: r for r in percentiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", wanted).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert np.allclose([got[k][n] for n in wanted], np.quantile(v, list(wanted.values())), rtol=0, atol=1e-12)


def test_metrics_and_scorecards_see_their_frames_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    iou = counted.asNondeterministic()
    base = spark.range(40).withColumns({"mode": F.lit("or"), "detected": F.lit(True), "iou": iou((F.col("id") % 9) / 9.0)})
    rated = base.withColumns({"mean_corner_error": F.col("id") * 1.0, "max_corner_error": F.col("id") * 2.0})
    assert {r.frames for r in L.localization_metrics(rated).collect()} == {40} and seen.value == 40
    tiers = {f"{t}_{c}": v for t in ("t1", "t2") for c, v in (("detected", F.lit(True)), ("iou", F.col("iou")), ("error", F.lit(1.0)), ("ms", F.lit(2.0)))}
    decisions = base.withColumns({"gate": F.lit("g"), "invoke_tier2": F.col("id") % 2 == 0, **tiers})
    assert {r.frames for r in L.gate_scorecard(decisions).collect()} == {40} and seen.value == 80


def test_live_tracker_keeps_many_captures_in_a_few_states(spark, tmp_path):
    quad = [(100.0, 100.0), (400.0, 100.0), (400.0, 290.0), (100.0, 290.0)]
    schema = "video_id long, frame_idx int, event_time timestamp, frame_w int, frame_h int, cand_id int, corners array<struct<x:double,y:double>>, area double, aspect_ratio double, static_score double"
    rows = [(v, f, 1000 + 2 * f, 640, 480, 0, quad, 57000.0, 1.579, 0.7 if (v or 0) % 3 else 0.2 + f / 10) for v in [*range(9), None] for f in range(4)]
    rows.append((-1, 0, 10**6, 640, 480, None, None, None, None, None))
    given = spark.createDataFrame(rows, schema.replace("event_time timestamp", "t long"))
    for part in (F.col("frame_idx") % 4 < 2, F.col("frame_idx") % 4 >= 2):
        given.filter(part).withColumn("event_time", F.timestamp_seconds("t")).select(*[c.split(" ")[0] for c in schema.split(", ")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live = run_to_table(track_stream(stream, delay="20 seconds", idle_ms=10**9, shards=2), f"{tmp_path}/out").filter("video_id IS NULL OR video_id >= 0")
    scored = given.filter("cand_id IS NOT NULL")
    batch = track(scored.select("video_id", "frame_idx", "frame_w", "frame_h"), scored)
    pick = lambda df: sorted((str(r.video_id), r.frame_idx, r.method, r.confidence, r.bbox or []) for r in df.collect())
    assert pick(live.filter("video_id IS NOT NULL")) == pick(batch.filter("video_id IS NOT NULL")) and len(pick(live)) == 40


def _waiting_rows(spark, checkpoint, batch):
    """Rows that wait in the state after a micro-batch, by the frame's event time in milliseconds."""
    state = spark.read.format("statestore").option("batchId", batch).load(checkpoint).select("value.groupState.pending")
    return [ms for r in state.collect() if r.pending for ms in pa.ipc.open_stream(bytes(r.pending)).read_pandas()["ms"]]


@pytest.mark.parametrize("provider", [None, ROCKSDB])
def test_a_backlog_does_not_wait_in_the_state(spark, tmp_path, provider):
    """One micro-batch brings 300 frames of each capture; what waits is its last stretch, as long as the watermark's delay."""
    name, given = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    frames = spark.range(0, 2400).selectExpr("id % 8 AS video_id", "cast(id / 8 AS int) AS frame_idx", "640 AS frame_w", "480 AS frame_h")
    quad = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((100.0, 100.0), (400.0, 100.0), (400.0, 290.0), (100.0, 290.0))])
    scored = frames.withColumns({"cand_id": F.lit(0), "corners": quad, "area": F.lit(57000.0), "aspect_ratio": F.lit(1.579), "static_score": 0.2 + F.col("frame_idx") % 7 / 10})
    rows = scored.withColumn("event_time", F.timestamp_seconds(F.col("frame_idx") + 1000))
    late = rows.filter("frame_idx = 100").withColumn("frame_idx", F.lit(1000))  # its capture is 190 seconds further
    try:
        spark.conf.set(name, provider or given)
        for k, part in enumerate((rows, late.unionByName(rows.filter("frame_idx = 299").withColumns({"video_id": F.lit(-1).cast("long"), "event_time": F.timestamp_seconds(F.lit(10**6))})))):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
            live = run_to_table(track_stream(stream, delay="10 seconds", idle_ms=10**9, shards=3), f"{tmp_path}/out")
            if k == 0:
                waiting = _waiting_rows(spark, f"{tmp_path}/out/checkpoint", 0)
                assert sorted(waiting) == [1000 * t for t in range(1290, 1300) for _ in range(8)]
    finally:
        spark.conf.set(name, given)
    pick = lambda df: sorted((r.video_id, r.frame_idx, r.method, r.confidence, r.bbox or [], str(r.corners), r.reason or "") for r in df.collect())
    assert pick(live.filter("video_id >= 0")) == pick(track(frames, scored))


def test_similarity_of_a_backlog_does_not_wait_in_the_state(spark, tmp_path):
    emb = spark.range(0, 600).selectExpr("id % 3 AS video_id", "cast(id / 3 AS int) AS frame_idx", "array(cos(id), sin(id)) AS vec", "timestamp_seconds(1000 + cast(id / 3 AS int)) AS event_time")
    late = emb.filter("frame_idx = 100").withColumn("frame_idx", F.lit(1000))
    for k, part in enumerate((emb, late.unionByName(emb.filter("frame_idx = 199").withColumns({"video_id": F.lit(-1).cast("long"), "event_time": F.timestamp_seconds(F.lit(10**6))})))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(emb.schema).parquet(f"{tmp_path}/in")
        live = run_to_table(similarity_stream(stream, idle_ms=10**9), f"{tmp_path}/out")
        if k == 0:
            assert sorted(_waiting_rows(spark, f"{tmp_path}/out/checkpoint", 0)) == [1000 * t for t in range(1190, 1200) for _ in range(3)]
    columns = ["video_id", "frame_a", "frame_b", "similarity", "is_anomaly"]
    assert sorted(live.select(columns).collect()) == sorted(consecutive_similarity(emb).select(columns).collect())


def test_overlap_of_boxes_has_the_bits_of_their_sides():
    rng = np.random.default_rng(1)
    low, size = rng.integers(0, 300, (5000, 2)) + 0.0, rng.integers(400, 900, (5000, 2)) / 1.3
    quads = lambda low, high: np.stack([low, np.c_[high[:, 0], low[:, 1]], high, np.c_[low[:, 0], high[:, 1]]], axis=1)
    moved, high = low + rng.integers(0, 7, (5000, 2)), low + size
    moved_high = high + (moved - low)
    inter = np.maximum(0.0, high - moved).prod(axis=1)
    want = inter / ((moved_high - moved).prod(axis=1) + (high - low).prod(axis=1) - inter)
    assert (quad_iou_arrays(quads(moved, moved_high), quads(low, high)) == want).all()


def _quads(spark):
    """Frames of several sizes with plain, skewed, implausible, short and missing quads."""
    rng, rows = np.random.default_rng(8), []
    for n, (frame, size) in enumerate({"a": 5, "b": 23, None: 4, "c": 9, "d": 2, "e": 1}.items()):
        for c in range(size):
            x, y, w, h = (float(v) for v in rng.integers(20, 260, 4))
            w, h, s = w + 300, h + 150, float(rng.integers(-9, 9)) * (1 if c % 4 else 30)
            quad = [(x, y), (x + w, y + s), (x + w + s, y + h), (x - s, y + h)]
            quad = [quad[(i + c) % 4] for i in range(4)]
            quad = None if c % 11 == 7 else quad[:3] if c % 11 == 8 else quad
            area = 10.0 if frame in ("d", "e") else None if c % 11 == 9 else w * h
            rows.append((None if n % 3 == 2 else n % 2, frame, c, quad, area, None if c % 5 == 1 else float(rng.random()), 1000, 1600, f"{frame}{c}"))
    return spark.createDataFrame(rows, CANDIDATES + ", edge_quality double, frame_h int, frame_w int, note string")


@pytest.mark.parametrize("tile,batch", [(128, "10000"), (8, "3"), (1, "10000")])
def test_one_pass_gives_the_scores_of_its_steps(spark, tile, batch):
    df = _quads(spark)
    want = C.score_candidates(C.validate_quads(C.plausible_areas(df)))
    rows = lambda d, names: sorted((tuple(r[n] for n in names) for r in d.collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert rows(C.scored_quads(df, tile_rows=tile), want.columns) == rows(want, want.columns)
        top, lead = C.scored_quads(df, best=True, tile_rows=tile).cache(), C.best_candidate(want, 0.0)
        few = C.scored_quads(df, best=True, columns=["static_score"], tile_rows=tile)
        assert rows(few, ["frame_id", "static_score"]) == rows(top, ["frame_id", "static_score"]) and few.columns == ["video_id", "frame_id", "static_score"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(top.filter("static_score IS NOT NULL"), lead.columns) == rows(lead, lead.columns)
    assert top.count() == 6 and {r.frame_id for r in top.filter("static_score IS NULL").collect()} == {"d", "e"}
    assert {(r.frame_w, r.frame_h) for r in top.collect()} == {(1600, 1000)}


def _written_plans(monkeypatch):
    plans, keep = [], C.written
    monkeypatch.setattr(C, "written", lambda df, kind: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, kind))[1])
    return plans


def test_order_lines_are_dealt_once_for_their_best_candidates(spark, monkeypatch):
    plans = _written_plans(monkeypatch)
    G.best(spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and plans[0].count("Exchange") == 1 and plans[0].count("Sort [") == 1


def test_gates_read_the_order_lines_once(spark, monkeypatch):
    """The pass gives every frame, so frames are not looked up again; the rows are those of the join."""
    folder = "/root/testdata/sf0.001"
    plans = _written_plans(monkeypatch)
    best = G._tier1(spark, folder)
    assert len(plans) == 1 and plans[0].count("Exchange") == 1 and "lineitem" not in best._jdf.queryExecution().executedPlan().toString()
    want = A.tier1_detection(C.best_candidate(G._scored(spark, folder), 0.0), G._frames(spark, folder))
    names = [c for c in want.columns if c in best.columns]
    assert set(names) == set(want.columns)
    assert sorted(map(str, best.select(names).collect())) == sorted(map(str, want.select(names).collect()))


def test_a_frame_without_a_key_is_not_detected(spark):
    rows = [(None, 1, 0.9, 5), (1, None, 0.9, 5), (1, 1, 0.9, 5), (1, 2, 0.3, 5), (1, 3, None, None)]
    got = A.tier1_of_best(spark.createDataFrame(rows, "video_id int, frame_id int, static_score double, cand_id int")).collect()
    assert [(r.detected, r.cand_id) for r in sorted(got, key=lambda r: (not r.detected,))] == [(True, 5)] + [(False, None)] * 4


def test_truth_keeps_one_line_of_a_frame_before_it_sorts_on(spark):
    plan = G._truth(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 1
