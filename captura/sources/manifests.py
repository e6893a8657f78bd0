"""Manifests and directory listings to samples."""

import os
import re
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captura.functions.paths import (
    CLASS_LABELS,
    IMAGE_SUFFIXES,
    clip_metadata,
    doc_id,
    file_name,
    lookup,
    parent_name,
    stem,
    unix_path,
)
from captura.functions.text import strip
from captura.operators.shared import written

_IMAGE_RE = "(?i)(" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + ")$"
SPLIT_NAMES = ("train", "val", "test")
LISTED_ROWS = 8192  # files of a listing's batch


def read_manifest(spark: SparkSession, path: str, columns: list | None = None) -> DataFrame:
    """Manifest CSV with a header, every column text. Give ``columns`` to skip reading the header first."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path)


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def manifest_samples(manifest: DataFrame, base_dir: str = "", validation_alias: bool = True) -> DataFrame:
    """Samples of a partitioned manifest.

    Unknown labels and splits are dropped. Empty text counts as missing.
    ``validation_alias`` reads split ``validation`` as ``val``; without it those
    rows do not belong to any split.
    """
    has = lambda c: c in manifest.columns
    pick = lambda *names: F.coalesce(
        *[F.nullif(F.col(n), F.lit("")) for n in names if has(n)], F.lit(None).cast("string")
    )
    split = strip(F.lower("split"))
    if validation_alias:
        split = F.when(split == "validation", F.lit("val")).otherwise(split)
    relative = F.coalesce(pick("crop_path", "path"), F.lit(""))
    path = F.concat_ws("/", F.lit(base_dir.rstrip("/")), relative) if base_dir else relative
    label = strip(F.upper("label"))
    return (
        manifest.withColumns({"__split": split, "__class": label, "__path": path})
        .filter(F.col("__class").isin(*CLASS_LABELS) & F.col("__split").isin(*SPLIT_NAMES))
        .select(
            F.col("__path").alias("path"),
            lookup(F.col("__class"), CLASS_LABELS).alias("label"),
            F.col("__class").alias("class_name"),
            F.coalesce(pick("document_id", "source_group"), doc_id(F.col("__path"))).alias("doc_id"),
            F.col("__split").alias("split"),
        )
    )


def plain_root(root: str) -> str:
    """The root as listings report it: local addresses without their scheme."""
    return re.sub(r"^file:/+", "/", root).rstrip("/")


def open_storage(root: str):
    """File system of an address and the root's path in it."""
    system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{plain_root(root)}")
    return system, base.rstrip("/")


def _hidden(name: str) -> bool:
    """Names that Spark's scans leave out."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _entries(system, folder: str):
    """Name, size and kind of what lies in a folder; a local folder is never held whole."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                yield e.name, e.stat().st_size, e.is_dir()
    else:
        for e in system.get_file_info(fs.FileSelector(folder)):
            yield e.base_name, e.size, e.type == fs.FileType.Directory


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path and length of every file below a directory; contents are never read. As in Spark's scans, empty files and hidden names are left out.

    Tasks list the directories of a level and write what they find, so neither the driver nor a plan holds the files. The listing is
    a table and stays as it was when it was made. What ``pyarrow.fs`` cannot open as a directory (a pattern, one file,
    a storage that only Spark knows) goes through Spark's own scan.
    """
    try:
        system, base = open_storage(root)
        tree = system.get_file_info(base or "/").type == fs.FileType.Directory
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        tree = False
    if not tree:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return listing.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length")
    top = plain_root(root)

    def work(batches):
        system, base = open_storage(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                kept = (x for x in _entries(system, (base + path[len(top) :]) or "/") if not _hidden(x[0]) and (x[2] or x[1]))
                while part := list(islice(kept, LISTED_ROWS)):
                    names, sizes, kinds = zip(*part)
                    columns = [pa.array([f"{path}/{n}" for n in names]), pa.array(sizes, pa.int64()), pa.array(kinds)]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "length", "is_folder"])

    width = max(32, spark.sparkContext.defaultParallelism)
    folders, out = spark.createDataFrame([(top,)], "path string"), None
    while out is None or not folders.isEmpty():
        found = folders.repartition(width, "path").mapInArrow(work, "path string, length long, is_folder boolean")
        level = written(found.repartition(width, "path"), "listing")
        files, folders = level.filter("NOT is_folder").select("path", "length"), level.filter("is_folder").select("path")
        out = files if out is None else out.unionByName(files)
    return out


def images_of(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").rlike(_IMAGE_RE))


def tree_samples(files: DataFrame, root: str) -> DataFrame:
    """Samples of a ``split/class/.../image`` tree; class directories in upper or lower case."""
    base = "^" + root.rstrip("/").replace(".", r"\.") + "/"
    relative = F.regexp_replace("path", base, "")
    parts = F.split(relative, "/")
    cls = F.get(parts, F.lit(1))
    return (
        images_of(files)
        .withColumns({"split": F.get(parts, F.lit(0)), "__class": cls})
        .filter(F.col("split").isin(*SPLIT_NAMES) & F.col("__class").isin("REAL", "ATTACKED", "real", "attacked"))
        .select(
            "path",
            lookup(F.upper("__class"), CLASS_LABELS).alias("label"),
            F.upper("__class").alias("class_name"),
            doc_id(F.col("path")).alias("doc_id"),
            "split",
        )
    )


def flat_samples(files: DataFrame, root: str, real_subdir: str = "REAL", attacked_subdir: str = "ATTACKED") -> DataFrame:
    """Samples of a dataset with one directory per class; sort where they are written."""
    base = "^" + root.rstrip("/").replace(".", r"\.") + "/"
    top = F.get(F.split(F.regexp_replace("path", base, ""), "/"), F.lit(0))
    cls = F.when(top == real_subdir, F.lit("REAL")).when(top == attacked_subdir, F.lit("ATTACKED"))
    return (
        images_of(files)
        .withColumn("class_name", cls)
        .filter(F.col("class_name").isNotNull())
        .select("path", lookup(F.col("class_name"), CLASS_LABELS).alias("label"), "class_name", doc_id(F.col("path")).alias("doc_id"))
    )


def is_partitioned(files: DataFrame, root: str) -> DataFrame:
    """One row: whether the listing has a manifest or files below all three split directories."""
    base = "^" + root.rstrip("/").replace(".", r"\.") + "/"
    relative = F.regexp_replace("path", base, "")
    top = F.when(F.instr(relative, "/") > 0, F.get(F.split(relative, "/"), F.lit(0)))
    return files.agg(
        (
            F.coalesce(F.bool_or(relative == "manifest.csv"), F.lit(False))
            | (F.countDistinct(F.when(top.isin(*SPLIT_NAMES), top)) == 3)
        ).alias("is_partitioned")
    )


def clip_files(files: DataFrame) -> DataFrame:
    """Frame files of ``.../<clip>/<frame>.jpg`` with the clip's document, mode and label."""
    from captura.functions.paths import label_from_mode

    path = unix_path(F.col("path"))
    meta = clip_metadata(parent_name(path))
    return (
        files.filter(F.col("path").rlike(r"\.jpg$"))
        .withColumns({"path": path, "__m": meta})
        .select(
            "path",
            "length",
            F.col("__m.clip_id").alias("clip_id"),
            F.col("__m.document_id").alias("document_id"),
            F.col("__m.mode").alias("attack_type"),
            label_from_mode(F.col("__m.mode")).alias("label"),
            file_name(path).alias("frame_filename"),
        )
    )


def prepared_manifest(samples: DataFrame, document_type: str = "mock_identity_card") -> DataFrame:
    """Manifest rows of a split sample set, with the path inside the prepared tree."""
    target = F.concat_ws("/", F.col("split"), F.lower("class_name"), file_name(F.col("path")))
    return samples.select(
        stem(F.col("path")).alias("sample_id"),
        F.col("path").alias("source"),
        F.col("doc_id").alias("source_group"),
        target.alias("path"),
        F.col("class_name").alias("label"),
        F.lit(document_type).alias("document_type"),
        F.col("doc_id").alias("video_id"),
        "split",
    )


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 and MD5 of every file below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        F.regexp_replace("path", r"^file:/+", "/").alias("path"),
        F.sha2("content", 256).alias("sha256"),
        F.md5("content").alias("md5"),
    )
