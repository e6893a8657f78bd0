"""Image sets on shared storage, the metrics cache, template texts."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from captura.operators.cache import with_cache
from captura.sources import manifests as M
from captura.sources.annotations import with_template_text
from captura.sources.dataset import PREPARED_COLUMNS, build_dataset, copy_files, plain_root, put_files


@pytest.fixture()
def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def images(spark, root, n=60):
    rows = [(f"{'REAL' if k % 2 else 'ATTACKED'}/doc-{k % 12}_f{k:04d}.png", f"pixels {k}".encode() if k else None) for k in range(n)]
    return put_files(spark.createDataFrame(rows, "path string, content binary"), root)


def test_files_are_written_once_each(spark, folder):
    receipts = {r.path: r.length for r in images(spark, folder).collect()}
    listed = {r.path.removeprefix(plain_root(folder) + "/"): r.length for r in M.list_files(spark, folder).collect()}
    assert receipts.pop("ATTACKED/doc-0_f0000.png") == 0  # written, but Spark lists no empty file
    assert receipts == listed and len(listed) == 59


def test_dataset_build_repeats_itself(spark, folder):
    source, target = f"{folder}/a", f"{folder}/b"
    images(spark, source)
    first = sorted(map(tuple, build_dataset(spark, source, target).collect()))
    assert sorted(map(tuple, build_dataset(spark, source, target).collect())) == first
    files = M.tree_samples(M.list_files(spark, target), plain_root(target)).collect()
    assert len(files) == 59 and {f.split for f in files} == {"train", "val", "test"}
    assert all(len({f.split for f in files if f.doc_id == d}) == 1 for d in {f.doc_id for f in files})
    rows = M.read_manifest(spark, f"{target}/manifest.csv", PREPARED_COLUMNS).collect()
    assert {r.path for r in rows} == {f.path.removeprefix(plain_root(target) + "/") for f in files}
    assert not M.list_files(spark, target).filter("path LIKE '%.part'").count()


def test_listing_is_made_by_tasks_and_equals_the_scan(spark, folder):
    names = ["a.png", "x/b.png", "x/y/c d.png", "_part=1/d.png", "_metadata", "_SUCCESS", ".e.png", ".h/f.png", "_g/g.png", "x/%41.png"]
    rows = [(n, n.encode()) for n in names] + [("x/empty.png", None)] + [(f"many/{k}.png", b"xy") for k in range(99)]
    put_files(spark.createDataFrame(rows, "path string, content binary"), folder)
    files = M.list_files(spark, folder)
    assert not [f for f in files.inputFiles() if f.endswith(".png")]  # the plan reads a table, not the files
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    want = sorted((r.path.replace("file:/", "/"), r.length) for r in scan.select("path", "length").collect())
    assert sorted(map(tuple, files.collect())) == want and len(want) == 104
    one = M.list_files(spark, f"{folder}/x/*.png").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in one) == ["%41.png", "b.png"]


def test_copies_of_a_small_manifest_are_dealt(spark, folder):
    images(spark, f"{folder}/a")
    manifest = M.list_files(spark, f"{folder}/a").select(F.concat(F.lit("all/"), F.substring_index("path", "/", -1)).alias("path"), F.col("path").alias("source"))
    receipts = copy_files(manifest.coalesce(1), f"{folder}/b")
    assert receipts.count() == 59 and receipts.select(F.input_file_name()).distinct().count() > 1
    assert sorted(os.listdir(f"{plain_root(folder)}/b")) == ["all"]  # no drafts are left


def test_unfit_source_is_refused(spark, folder):
    images(spark, folder, 6)
    with pytest.raises(ValueError):
        build_dataset(spark, folder, f"{folder}-out")


def test_same_name_twice_is_refused(spark, folder):
    rows = [(f"{c}/{d}/x{k % 2}/doc-{k}.png", b"x") for c in ("REAL", "ATTACKED") for k in range(8) for d in ("p", "q")]
    put_files(spark.createDataFrame(rows, "path string, content binary"), folder)
    with pytest.raises(ValueError):
        build_dataset(spark, folder, f"{folder}-out")


def test_cache_computes_misses_once(spark, folder):
    asked = []

    def compute(missing):
        asked.append(sorted(str(r.frame_id) for r in missing.collect()))
        return missing.select("frame_id", F.concat(F.lit("v"), F.coalesce("frame_id", F.lit("none"))).alias("value"))

    def run(ids):
        df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "frame_id string, n int")
        out = with_cache(df, f"{folder}/cache", "frame_id string, value string", compute)
        return sorted((str(r.frame_id), r.value, r.from_cache, r.n) for r in out.collect())

    assert run(["a", "b", "b"]) == [("a", "va", False, 0), ("b", "vb", False, 1), ("b", "vb", False, 2)]
    assert run(["b", "c", None]) == [("None", "vnone", False, 2), ("b", "vb", True, 0), ("c", "vc", False, 1)]
    assert run(["c", None, "a"]) == [("None", "vnone", True, 1), ("a", "va", True, 2), ("c", "vc", True, 0)]
    assert asked == [["a", "b"], ["None", "c"], []]


def test_failed_run_leaves_the_cache(spark, folder):
    df = spark.createDataFrame([("a",)], "frame_id string")

    def broken(missing):
        return missing.select("frame_id", F.raise_error(F.lit("no model")).cast("string").alias("value"))

    with pytest.raises(Exception, match="no model"):
        with_cache(df, f"{folder}/cache", "frame_id string, value string", broken)
    good = with_cache(df, f"{folder}/cache", "frame_id string, value string", lambda m: m.select("frame_id", F.lit("v").alias("value")))
    assert [tuple(r) for r in good.select("value", "from_cache").collect()] == [("v", False)]


def test_template_text_of_clips(spark):
    clips = spark.createDataFrame([("lva_passport_28", 1), ("lva_passport_3", 2), (None, 3)], "clip_id string, n int")
    fields = spark.createDataFrame([("28", "{}a"), ("28", "{}b"), ("4", "{}")], "document string, ground_truth_text string")
    got = {r.n: r.ground_truth_text for r in with_template_text(clips, fields).collect()}
    assert got == {1: "{}b", 2: "", 3: ""}
