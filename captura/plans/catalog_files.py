"""Queries over files: image sets written from a given table, their listings and manifests, and the metrics cache."""

from pyspark.sql import functions as F

from captura.functions import paths as P
from captura.functions.rounding import round_half_even
from captura.operators import localization as L
from captura.operators.cache import with_cache
from captura.operators.shared import new_path, written
from captura.plans import catalog_geometry as G
from captura.plans import views as V
from captura.plans.registry import query, r
from captura.sources import manifests as M
from captura.sources.dataset import PREPARED_COLUMNS, build_dataset, plain_root, put_files
from captura.sources.sinks import write_samples

# Every document of the table is an image file; 90 capture groups of both classes.
_IMAGE = {
    "class_name": "CASE WHEN doc_id % 2 = 1 THEN 'REAL' ELSE 'ATTACKED' END",
    "source_group": "'doc-' || CAST(doc_id % 90 AS STRING)",
    "name": "'doc-' || CAST(doc_id % 90 AS STRING) || '_f' || lpad(CAST(doc_id AS STRING), 8, '0') || '.png'",
}
_IMAGES_SQL = "images AS (SELECT * FROM (" + V.sql_select({**_IMAGE, "bytes": "octet_length(encode(coalesce(text, '')))"}, "documents").replace("STRING", "VARCHAR") + ") WHERE bytes > 0)"


def image_set(spark, sf_dir):
    """The address of a class-per-directory set with a file per document, written to shared storage."""
    root = new_path(spark, "images")
    docs = V.table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {n}" for n, e in _IMAGE.items()], "CAST(text AS BINARY) AS content")
    put_files(docs.select(F.concat_ws("/", "class_name", "name").alias("path"), "content"), root)
    return root


def prepared_set(spark, sf_dir):
    source, target = image_set(spark, sf_dir), new_path(spark, "prepared")
    return source, target, build_dataset(spark, source, target)


@query(
    "s03_flat_samples",
    f"WITH {_IMAGES_SQL} SELECT name, CASE WHEN class_name = 'REAL' THEN 0 ELSE 1 END AS label, class_name, source_group AS doc_id, bytes FROM images",
)
def flat(spark, sf_dir):
    root = image_set(spark, sf_dir)
    files = M.list_files(spark, root)
    samples = M.flat_samples(files, plain_root(root)).join(files, "path")
    return samples.select(P.file_name(F.col("path")).alias("name"), "label", "class_name", "doc_id", F.col("length").alias("bytes"))


@query(
    "s02_s04_tree_samples",
    f"WITH {_IMAGES_SQL} SELECT name, CASE WHEN class_name = 'REAL' THEN 0 ELSE 1 END AS label, class_name, source_group AS doc_id, bytes, true AS as_in_manifest, false AS source_is_partitioned, true AS target_is_partitioned FROM images",
)
def tree(spark, sf_dir):
    """The files of the prepared set as its tree names them, against the manifest that was written beside them."""
    source, target, _ = prepared_set(spark, sf_dir)
    files = M.list_files(spark, target)
    flags = [M.is_partitioned(x, plain_root(root)).first().is_partitioned for x, root in ((M.list_files(spark, source), source), (files, target))]
    listed = M.tree_samples(files, plain_root(target)).join(files, "path")
    manifest = M.read_manifest(spark, f"{target}/manifest.csv", PREPARED_COLUMNS)
    known = manifest.select(F.concat_ws("/", F.lit(plain_root(target)), "path").alias("path"), F.col("split").alias("__split"), F.col("label").alias("__label"))
    same = (F.col("split") == F.col("__split")) & (F.col("class_name") == F.col("__label"))
    return listed.join(known, "path", "left").select(
        P.file_name(F.col("path")).alias("name"), "label", "class_name", "doc_id", F.col("length").alias("bytes"),
        F.coalesce(same, F.lit(False)).alias("as_in_manifest"), F.lit(flags[0]).alias("source_is_partitioned"), F.lit(flags[1]).alias("target_is_partitioned"),
    )


@query(
    "e06_s08_s13_dataset_build",
    f"WITH {_IMAGES_SQL} SELECT class_name AS label, count(*) AS images, count(DISTINCT source_group) AS documents, sum(bytes) AS bytes, count(*) AS manifest_rows, count(*) AS partition_rows, "
    "CAST(0 AS BIGINT) AS documents_in_two_splits, true AS every_split_filled FROM images GROUP BY 1",
)
def dataset_build(spark, sf_dir):
    """The whole chain; counts from the copied files, the manifest file and the partitioned table of samples."""
    _, target, manifest = prepared_set(spark, sf_dir)
    listed = M.list_files(spark, target)
    files = M.tree_samples(listed, plain_root(target)).join(listed, "path")
    copied = files.groupBy(F.col("class_name").alias("label")).agg(
        F.count(F.lit(1)).alias("images"), F.countDistinct("doc_id").alias("documents"), F.sum("length").alias("bytes"), F.countDistinct("split").alias("splits")
    )
    rows = M.read_manifest(spark, f"{target}/manifest.csv", PREPARED_COLUMNS).groupBy("label").agg(F.count(F.lit(1)).alias("manifest_rows"))
    write_samples(manifest, f"{target}/samples")
    parts = spark.read.parquet(f"{target}/samples").groupBy("label").agg(F.count(F.lit(1)).alias("partition_rows"))
    twice = files.groupBy("doc_id").agg(F.countDistinct("split").alias("n"), F.collect_set("class_name").alias("labels"))
    leaks = twice.agg(F.count_if(F.col("n") > 1).alias("documents_in_two_splits"))
    return copied.join(rows, "label").join(parts, "label").crossJoin(F.broadcast(leaks)).select(
        "label", "images", "documents", "bytes", "manifest_rows", "partition_rows", "documents_in_two_splits", (F.col("splits") == 3).alias("every_split_filled")
    )


@query(
    "p13_p14_document_kinds",
    f"WITH {V.SQL_SAMPLES}, d AS (SELECT pos, CASE WHEN pos % 3 = 0 THEN 'alb_id_' ELSE 'aze_passport_' END || lpad(CAST(pos % 12 AS VARCHAR), 2, '0') AS doc FROM samples) "
    "SELECT pos, CASE WHEN pos % 3 = 0 THEN 'albanian_id' ELSE 'azerbaijan_passport' END AS document_type, "
    + "CASE ((pos % 12) + 3) % 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(P.ATTACK_CYCLE)) + " END AS attack_type FROM d",
)
def document_kinds(spark, sf_dir):
    prefix = F.when(F.col("pos") % 3 == 0, F.lit("alb_id_")).otherwise(F.lit("aze_passport_"))
    doc = F.concat(prefix, F.lpad((F.col("pos") % 12).cast("string"), 2, "0"))
    rows = V.samples(spark, sf_dir)
    return rows.select("pos", P.document_type(doc).alias("document_type"), P.synthetic_attack_type(doc).alias("attack_type"))


_CACHE_SCHEMA = "frame_id long, detected boolean, iou double, mean_corner_error double"
_RUNS = {1: "o_orderstatus = 'F'", 2: "true", 3: "true"}


@query(
    "j05_cached_metrics",
    f"WITH {V.SQL_CORNERS}, {G._TRUTH_SQL}, tier2q AS (SELECT r.frame_id, detected, {G._iou_sql()} AS iou, {G._error_sql()} FROM tier2 r JOIN truth t ON r.frame_id = t.frame_id), "
    "runs AS (SELECT 1 AS run, o_orderkey, false AS from_cache FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, o_orderkey, o_orderstatus = 'F' FROM orders UNION ALL SELECT 3, o_orderkey, true FROM orders) "
    f"SELECT run, frame_id, from_cache, detected, {r('iou')} AS iou, {r('mean_error', 2)} AS mean_corner_error FROM runs JOIN tier2q ON frame_id = o_orderkey",
)
def cached_metrics(spark, sf_dir):
    """Second-detector metrics of frames in three runs: finished captures, all captures, all again (no miss)."""
    path = new_path(spark, "metrics-cache")
    orders = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), "o_orderstatus")
    measured = written(G._truth(spark, sf_dir), "truth")  # read by every run
    truth = measured.select("frame_id", "corners")
    second = G._tier2(spark, sf_dir, measured).select("frame_id", "detected", "corners")
    frames = orders.join(truth.select("frame_id"), "frame_id")

    def compute(missing):
        return L.against_truth(second.join(missing.select("frame_id"), "frame_id", "left_semi"), truth, keys=("frame_id",))

    out = None
    for run, which in _RUNS.items():
        known = with_cache(frames.filter(which).select("frame_id"), path, _CACHE_SCHEMA, compute)
        rows = known.select(F.lit(run).alias("run"), "frame_id", "from_cache", "detected", round_half_even(F.col("iou")).alias("iou"), round_half_even(F.col("mean_corner_error"), 2).alias("mean_corner_error"))
        out = rows if out is None else out.union(rows)
    return out
