"""Building a partitioned image set on shared storage: listing, leak-free split, copies, manifest.

Files are copied by the tasks that own their manifest rows and never pass through a table or the driver. The storage
is any that executors share and ``pyarrow.fs`` opens by its address.
"""

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captura.operators.audit import validate_dataset
from captura.operators.shared import written
from captura.operators.splits import grouped_split, leakage
from captura.sources.manifests import flat_samples, list_files, open_storage, plain_root, prepared_manifest
from captura.sources.sinks import write_csv

# --- fixed values ---------------------------------------------------------
PREPARED_COLUMNS = ["sample_id", "source", "source_group", "path", "label", "document_type", "video_id", "split"]
COPY_TASKS_PER_CORE = 4
# --------------------------------------------------------------------------


def _each_file(rows: DataFrame, root: str, columns: list, fill_of) -> DataFrame:
    """Run a task per row that makes ``root/path``; one receipt ``path, length`` per file, kept as a table.

    A file is made in a hidden folder of its task and moved over its place, so that a lost task leaves no half file and
    tasks do not wait for each other to create files in one large folder.
    """

    def work(batches):
        system, base = open_storage(root)
        drafts, made = f"{base}/.drafts-{uuid.uuid4().hex}", set()
        try:
            for batch in batches:
                sizes = []
                for path, *given in zip(*[batch.column(c).to_pylist() for c in columns]):
                    target, draft = f"{base}/{path}", f"{drafts}/file"
                    for folder in {target.rsplit("/", 1)[0], drafts} - made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    fill_of(system, *given)(draft)
                    system.move(draft, target)
                    sizes.append(system.get_file_info(target).size)
                yield pa.RecordBatch.from_arrays([batch.column(columns[0]), pa.array(sizes, pa.int64())], ["path", "length"])
        finally:
            if made:
                system.delete_dir(drafts)

    return written(rows.select(*columns).mapInArrow(work, "path string, length long"), "receipts")


def put_files(contents: DataFrame, root: str) -> DataFrame:
    """Write ``path, content`` rows as files below ``root``; a NULL content is an empty file."""

    def fill_of(system, content):
        def fill(draft):
            with system.open_output_stream(draft) as out:
                out.write(content or b"")

        return fill

    return _each_file(contents, root, ["path", "content"], fill_of)


def copy_files(manifest: DataFrame, root: str) -> DataFrame:
    """Copy every ``source`` to ``root/path`` within one storage. Rows are dealt evenly: a small manifest may be one partition."""

    def fill_of(system, source):
        return lambda draft: system.copy_file(source, draft)

    dealt = manifest.repartition(COPY_TASKS_PER_CORE * manifest.sparkSession.sparkContext.defaultParallelism, "path")
    return _each_file(dealt, root, ["path", "source"], fill_of)


def build_dataset(spark: SparkSession, source: str, target: str, ratios=(0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Split a class-per-directory image set by document and write it as ``split/class/image`` with ``manifest.csv``.

    Returns the manifest as written. The source is validated first; a document in two splits, or two images that
    would share a path, end the build before anything is copied. A repeated build overwrites the same files with the
    same contents: splits depend on names and the seed alone.
    """
    samples = flat_samples(list_files(spark, source), plain_root(source))
    report = validate_dataset(samples).first()
    if not report.is_valid:
        raise ValueError(f"source {source} cannot be prepared: {'; '.join(report.issues)}")
    split = grouped_split(samples, order="path", ratios=ratios, seed=seed)
    manifest = written(prepared_manifest(split).select(*PREPARED_COLUMNS), "manifest")
    if not leakage(manifest, group="source_group").first().is_leak_free:
        raise ValueError("a document is in more than one split")
    if not manifest.groupBy("path").count().filter("count > 1").isEmpty():
        raise ValueError("two images of one class and split share a name")
    copied = copy_files(manifest, target)
    missing = manifest.join(copied, "path", "left_anti")
    if not missing.isEmpty():
        raise RuntimeError("not every image was copied")
    write_csv(manifest, f"{target.rstrip('/')}/manifest.csv", PREPARED_COLUMNS, mode="overwrite")
    return manifest
