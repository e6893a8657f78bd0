"""Results kept from run to run: what a cache table knows is joined, the rest is computed once and appended."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captura.operators.grouping import null_safe
from captura.operators.shared import written


def read_cache(spark: SparkSession, path: str, schema: str, keys) -> DataFrame:
    """The cache as it stands, one row per key; empty where nothing was written yet."""
    shape = T._parse_datatype_string(schema)
    try:
        known = spark.read.schema(shape).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], shape)
    # Two runs at a time may both have computed a key; either row will do, but only one.
    others = [f.name for f in shape.fields if f.name not in keys]
    rows = known.groupBy(*keys).agg(F.min(F.struct(*others)).alias("__row"))
    return rows.select(*keys, "__row.*")


def with_cache(frames: DataFrame, path: str, schema: str, compute: Callable[[DataFrame], DataFrame], keys=("frame_id",)) -> DataFrame:
    """Frames with the cached columns and ``from_cache``; ``compute`` sees only frames that the cache lacks.

    ``schema`` lists the keys and the columns that ``compute`` returns. New rows are appended by one Spark write, which
    shows all or none of them, so a run that failed leaves the cache as it was and can be repeated. NULL keys count
    as one key; rows of one key are computed together, once.
    """
    keys = list(keys)
    spark = frames.sparkSession
    known = read_cache(spark, path, schema, keys)
    missing = null_safe(frames, known.select(*keys), keys, "left_anti")
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    fresh = compute(missing.dropDuplicates(keys)).select(*names)
    before = known.select(*keys, F.lit(True).alias("from_cache"))
    # Spark takes two reads of one path for the same, however many files each has listed: each state is written apart.
    marked = written(null_safe(frames, before, keys), "cache-marks")
    if not missing.isEmpty():
        fresh.write.mode("append").parquet(path)
    full = null_safe(marked, read_cache(spark, path, schema, keys), keys)
    return written(full.withColumn("from_cache", F.coalesce("from_cache", F.lit(False))), "cached")
