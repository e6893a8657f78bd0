import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from captura.operators.splits import SPLITS
from captura.sources import annotations as VIA
from captura.sources import manifests as M
from captura.sources import sinks
from captura.streaming.live import (
    consensus_counts_stream,
    leading_values,
    run_to_table,
    similarity_stream,
    track_stream,
    use_rocksdb,
)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def test_manifest_round_trip(spark, folder):
    rows = [
        ("train/REAL/a_1.png", "", "real ", "doc_1", "", "Train"),
        ("", "val/ATTACKED/b_2.png", "ATTACKED", "", "grp", "validation"),
        ("", "REAL/doc_9_f1.png", "REAL", "", "", "test"),
        ("x.png", "", "OTHER", "d", "", "train"),
        ("x.png", "", "REAL", "d", "", "unassigned"),
    ]
    df = spark.createDataFrame(rows, "crop_path string, path string, label string, document_id string, source_group string, split string")
    sinks.write_csv(df, f"{folder}/m")
    got = {r.path: r for r in M.manifest_samples(M.read_manifest(spark, f"{folder}/m")).collect()}
    assert len(got) == 3
    assert got["train/REAL/a_1.png"].doc_id == "doc_1" and got["train/REAL/a_1.png"].label == 0
    assert got["val/ATTACKED/b_2.png"].split == "val" and got["val/ATTACKED/b_2.png"].doc_id == "grp"
    assert got["REAL/doc_9_f1.png"].doc_id == "doc_9"


def test_listing(spark, folder):
    import os

    for split in SPLITS:
        os.makedirs(f"{folder}/{split}/real")
        with open(f"{folder}/{split}/real/doc_1_f1.PNG", "wb") as f:
            f.write(split.encode())
    with open(f"{folder}/train/real/notes.txt", "w") as f:
        f.write("x")
    files = M.list_files(spark, folder)
    samples = M.tree_samples(files, folder).collect()
    assert {r.split for r in samples} == set(SPLITS) and len(samples) == 3
    assert M.is_partitioned(files, folder).first().is_partitioned
    import hashlib

    sums = {r.path.split("/")[-3]: r for r in M.checksums(spark, folder).collect() if r.path.endswith("PNG")}
    assert sums["val"].sha256 == hashlib.sha256(b"val").hexdigest() and sums["val"].md5 == hashlib.md5(b"val").hexdigest()


def test_annotations(spark):
    def region(name, value, xs, ys, shape="polygon"):
        return {
            "region_attributes": {"field_name": name, "value": value},
            "shape_attributes": {"name": shape, "all_points_x": xs, "all_points_y": ys},
        }

    doc = {
        "_via_img_metadata": {
            "k1": {"filename": "1.jpg", "regions": [region("doc_quad", "", [9, 1, 1, 9], [1, 1, 5, 5])]},
            "k2": {"filename": "2.jpg", "regions": [region("name", "A", [1], [1]), region("name", "B", [1], [1]), region("doc_quad", "", [1, 2, 3], [1, 2, 3])]},
        }
    }
    df = spark.createDataFrame([("c", json.dumps(doc))], "clip_id string, json string")
    quads = {r.filename: r.corners for r in VIA.document_quads(df).collect()}
    assert [(p.x, p.y) for p in quads["1.jpg"]] == [(9, 1), (1, 1), (1, 5), (9, 5)] and quads["2.jpg"] is None
    first = {r.filename: r.corners for r in VIA.first_polygon_quads(df).collect()}
    assert [(p.x, p.y) for p in first["1.jpg"]] == [(1, 1), (9, 1), (9, 5), (1, 5)] and first["2.jpg"] is None
    fields = VIA.template_fields(df).collect()
    assert [(r.document, r.ground_truth_text) for r in fields] == [("2", '{"name":"B"}')]


def test_partitioned_write(spark, folder):
    df = spark.createDataFrame([("p1", "train", "REAL"), ("p2", "val", "ATTACKED")], "path string, split string, label string")
    sinks.write_samples(df, f"{folder}/out")
    assert spark.read.parquet(f"{folder}/out/split=val").count() == 1


def slices(df, folder, parts):
    """Append rows to a folder in order of time, one file each, so that a stream takes one slice after the other."""
    for k in range(parts):
        df.filter(f"part = {k}").drop("part").coalesce(1).write.mode("append").parquet(folder)


def test_live_similarity_matches_batch(spark, folder):
    """Frames of a capture come out of order within the delay; one comes too late and is dropped."""
    from captura.operators.temporal import consecutive_similarity

    vec = [(f"v{i % 2}", i, [float(i % 3), 1.0, 0.1 * i], (i + 3 * (i % 2)) // 8) for i in range(40)]
    vec += [("v0", 1, [9.0, 9.0, 9.0], 5), ("end", 10**6, [1.0], 6)]
    emb = spark.createDataFrame(vec, "video_id string, frame_idx long, vec array<double>, part int")
    emb = emb.withColumn("event_time", F.timestamp_seconds(F.col("frame_idx") + 1000))
    slices(emb, f"{folder}/emb", 7)
    stream = spark.readStream.schema(emb.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/emb")
    live = run_to_table(similarity_stream(stream, idle_ms=10**9), f"{folder}/s1").filter("video_id <> 'end'")
    columns = ["video_id", "frame_a", "frame_b", "similarity", "is_anomaly"]
    batch = consecutive_similarity(emb.filter("video_id <> 'end' AND part < 5 OR part = 5 AND frame_idx <> 1"))
    assert sorted(live.select(columns).collect()) == sorted(batch.select(columns).collect())
    assert live.count() == 38


def test_live_tracker_matches_batch(spark, folder):
    """The candidates of every fourth frame are split over two micro-batches."""
    from captura.operators.tracking import track
    from tests.test_tracking import CANDS, FRAMES, sequences

    rows, cands, _ = sequences(3, ("a", "b"), 40)
    when = {k: n for n, k in enumerate(sorted({(r[1], r[0]) for r in rows}))}
    frames, scored = spark.createDataFrame(rows, FRAMES), spark.createDataFrame(cands, CANDS)
    times = spark.createDataFrame([(v, f, n) for (f, v), n in when.items()], "video_id string, frame_idx long, n int")
    part = F.least(F.lit(9), F.floor((F.col("n") + F.when((F.col("n") % 4 == 0) & (F.col("cand_id") == 1), 9).otherwise(0)) / 8))
    joined = frames.join(scored, ["video_id", "frame_idx"], "left").join(times, ["video_id", "frame_idx"])
    given = joined.select("*", F.timestamp_seconds(F.col("n") + 1000).alias("event_time"), part.cast("int").alias("part")).drop("n")
    last = spark.createDataFrame([("end", 0, 640, 480)], FRAMES).select("*", F.timestamp_seconds(F.lit(10**6)).alias("event_time"), F.lit(10).alias("part"))
    given = given.unionByName(last, allowMissingColumns=True)
    slices(given, f"{folder}/c", 11)
    stream = spark.readStream.schema(given.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/c")
    live = run_to_table(track_stream(stream, delay="20 seconds", idle_ms=10**9), f"{folder}/s2").filter("video_id <> 'end'")
    pick = lambda df: sorted((r.video_id, r.frame_idx, r.method, r.confidence, r.bbox, r.reason) for r in df.collect())
    assert pick(live) == pick(track(frames, scored)) and len({r.method for r in live.collect()}) >= 3


def test_state_expires(spark, folder):
    """A capture that was quiet for longer than the expiry starts anew."""
    quad = [(100.0, 100.0), (400.0, 100.0), (400.0, 290.0), (100.0, 290.0)]
    rows = [("v", k, t, 640, 480, 0, quad, 57000.0, 1.579, 0.7, k) for k, t in enumerate((0, 10, 2000))] + [("end", 0, t, 640, 480, None, None, None, None, None, p) for t, p in ((1000, 1), (10**6, 3))]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, t long, frame_w int, frame_h int, cand_id int, corners array<struct<x:double,y:double>>, area double, aspect_ratio double, static_score double, part int")
    df = df.withColumn("event_time", F.timestamp_seconds(F.col("t") + 1000)).drop("t")
    slices(df, f"{folder}/c", 4)
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/c")
    live = run_to_table(track_stream(stream, idle_ms=60_000), f"{folder}/s").filter("video_id = 'v'")
    assert [r.method for r in live.sort("frame_idx").collect()] == ["first_frame_detection", "temporally_guided", "first_frame_detection"]


def test_live_consensus_matches_batch(spark, folder):
    from captura.operators.consensus import consensus_of

    values = spark.createDataFrame(
        [("v", i, "name", ["a", "b", "b", "a"][i % 4], True) for i in range(7)],
        "video_id string, frame_idx int, field string, value string, valid boolean",
    )
    values.write.parquet(f"{folder}/t")
    stream = spark.readStream.schema(values.schema).parquet(f"{folder}/t")
    tallies = run_to_table(consensus_counts_stream(stream), f"{folder}/s3", mode="update")
    best = leading_values(tallies).first()
    want = consensus_of(values).first()
    assert (best.consensus, best.frequency) == (want.consensus, want.frequency)
