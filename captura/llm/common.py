"""Helpers shared by the corpus operators: tables, shared storage, worker state, Arrow batches."""

import sys
import tempfile
import types
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, as in tests on one machine, a temporary folder is set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/llm/{kind}-{uuid.uuid4().hex}"


#: For tables whose rows have a megabyte each: Parquet looks at the size of its pages and row groups after every row, not
#: after a hundred, so that neither writers nor readers hold more than a few rows.
LARGE_ROWS = {f"parquet.{part}.size.row.check.{end}": "1" for part in ("page", "block") for end in ("min", "max")} | {
    "parquet.block.size": str(8 << 20),
    "parquet.enable.dictionary": "false",
}


def materialize(df: DataFrame, kind: str, options: dict | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, for caches kept between its tasks."""
    name = "_corpus_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].state = {}
    return sys.modules[name].state


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo a number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def crc_fold_of(doc_id, folds: int) -> int:
    """The same fold in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_shared(fn: Callable, **given) -> Callable:
    """Bind parameters without a closure over a module, so that the function pickles by value."""

    def bound(batches):
        return fn(batches, **given)

    return bound


def portions(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``size`` bytes in one text column each."""
    if not batch.num_rows:
        return
    lengths = pa.compute.binary_length(batch.column(column).cast(pa.large_binary())).to_pylist()
    start = used = 0
    for i, n in enumerate(lengths):
        used += n or 0
        if used >= size:
            yield batch.slice(start, i + 1 - start)
            start, used = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Mark a written table for broadcast if its rows are few; a larger one is joined as Spark plans it."""
    return F.broadcast(df) if df.count() <= limit else df


KEY_LIMIT = 1_000_000


def _on_key(keys: DataFrame) -> tuple[DataFrame, Column]:
    """A written table of row keys (``doc_id, text_hash``), with the condition that joins it to documents.

    Up to ``KEY_LIMIT`` keys are broadcast, so that texts need no shuffle; more are joined as Spark plans it.
    """
    right = small(keys, KEY_LIMIT).select(*[F.col(c).alias(f"__{c}") for c in keys.columns])
    return right, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64("text") == F.col("__text_hash"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose id and text are not among the keys."""
    right, same = _on_key(materialize(keys.select("doc_id", "text_hash").distinct(), "keys"))
    return docs.join(right, same, "left_anti")


def repeated(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents as often as their keys say (``doc_id, text_hash, copies``, one row for each document).

    Rows with one id and text are interchangeable: the first stands for their copies together.
    """
    totals = counts.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    right, same = _on_key(materialize(totals.filter("copies > 0"), "copies"))
    joined = docs.join(right, same)
    if not right.filter("__rows > 1").isEmpty():
        twins = joined.filter("__rows > 1").dropDuplicates(["doc_id", "text"])
        joined = joined.filter("__rows = 1").union(twins)
    times = F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))
    return joined.select(*[F.col(c) for c in docs.columns], times.alias("__time")).drop("__time")
