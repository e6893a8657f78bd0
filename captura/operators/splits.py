"""Leak-free splits, leakage checks and fixed allocations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captura.functions.paths import lookup
from captura.operators.grouping import positions

# --- fixed values ---------------------------------------------------------
SPLITS = ("train", "val", "test")
DOCUMENT_SPLITS = {
    "alb_id_00": "train",
    "alb_id_01": "train",
    "alb_id_02": "train",
    "alb_id_03": "train",
    "alb_id_04": "val",
    "alb_id_05": "val",
    "aze_passport_00": "test",
    "aze_passport_01": "test",
}
STRATIFIED_ALLOCATION = {
    "train": ["alb_id_00", "alb_id_01", "alb_id_02", "aze_passport_00"],
    "val": ["alb_id_03", "alb_id_04"],
    "test": ["alb_id_05", "aze_passport_01"],
}
# --------------------------------------------------------------------------


def split_of_rank(rank: Column, n: Column, train: float, val: float) -> Column:
    """Split of the zero-based ``rank`` among ``n`` documents of one class."""
    n_train = F.greatest(F.lit(1), F.rint(n * F.lit(train)).cast("long"))
    wanted_val = F.greatest(F.lit(1), F.rint(n * F.lit(val)).cast("long"))
    n_val = F.when(n_train + wanted_val >= n, F.greatest(F.lit(1), n - n_train)).otherwise(wanted_val)
    # An empty test set takes the last training document when training can spare it.
    moved = (n_train + n_val >= n) & (F.least(n_train, n) > 1) & (rank == F.least(n_train, n) - 1)
    general = (
        F.when(moved, F.lit("test"))
        .when(rank < n_train, F.lit("train"))
        .when(rank < n_train + n_val, F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return F.when(n <= 2, F.when(rank == 0, F.lit("train")).otherwise(F.lit("val"))).otherwise(general)


def document_splits(
    samples: DataFrame,
    group: str = "doc_id",
    label: str = "label",
    order: str = "pos",
    ratios=(0.70, 0.15, 0.15),
    seed: int = 42,
) -> DataFrame:
    """One row per document: its label (the first seen) and split.

    Documents of a class are ranked by a seeded hash, which depends on neither row
    order nor partitioning. The hash is uniform, so its top bits cut the ranking
    of millions of documents into even buckets.
    """
    if abs(sum(ratios) - 1.0) > 1e-4:
        raise ValueError(f"split ratios must sum to 1, got {sum(ratios)}")
    docs = samples.groupBy(group).agg(F.min_by(label, order).alias(label))
    hashed = docs.withColumn("__h", F.xxhash64(F.col(group).cast("string"), F.lit(seed)))
    ranked = positions(hashed, [label], ["__h", group], F.shiftright("__h", 54), "__rank", "__size")
    split = split_of_rank(F.col("__rank"), F.col("__size"), ratios[0], ratios[1])
    return ranked.select(group, label, split.alias("split"))


def grouped_split(samples: DataFrame, group: str = "doc_id", label: str = "label", order: str = "pos",
                  ratios=(0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Attach the document's split to every sample."""
    assigned = document_splits(samples, group, label, order, ratios, seed).select(group, "split")
    return samples.join(assigned, group)


def assign_split(df: DataFrame, allocation: dict, group: str = "doc_id", default: str = "train") -> DataFrame:
    """Split from a fixed allocation; unknown documents get the default."""
    return df.withColumn("split", lookup(F.col(group), allocation, default))


def allocation_gaps(df: DataFrame, allocation: DataFrame, group: str = "doc_id") -> DataFrame:
    """Documents present on one side only: both lists must be empty."""
    mine, theirs = df.select(group).distinct(), allocation.select(group).distinct()
    missing = mine.join(theirs, group, "left_anti").withColumn("problem", F.lit("not_allocated"))
    unused = theirs.join(mine, group, "left_anti").withColumn("problem", F.lit("not_in_manifest"))
    return missing.unionByName(unused)


def reassign(df: DataFrame, allocation: DataFrame, group: str = "doc_id", file_column: str = "crop_path") -> DataFrame:
    """Move rows to the allocated split and rebuild the relative crop path."""
    moved = df.drop("split").join(allocation.select(group, "split"), group)
    name = F.substring_index(F.col(file_column), "/", -1)
    return moved.withColumn(file_column, F.concat_ws("/", F.col("split"), F.upper("label"), name))


def _memberships(df: DataFrame, group: str, split: str) -> DataFrame:
    inside = [F.coalesce(F.bool_or(F.col(split) == s), F.lit(False)).alias(f"in_{s}") for s in SPLITS]
    return df.groupBy(group).agg(*inside, F.min(split).alias("first_split"), F.max(split).alias("last_split"))


def leakage(df: DataFrame, group: str = "doc_id", split: str = "split") -> DataFrame:
    """Number of documents shared by each pair of splits and whether there are none."""
    m = _memberships(df, group, split)
    both = lambda a, b: F.count_if(F.col(f"in_{a}") & F.col(f"in_{b}"))
    return m.agg(
        both("train", "val").alias("train_val_overlap"),
        both("train", "test").alias("train_test_overlap"),
        both("val", "test").alias("val_test_overlap"),
        (F.count_if(F.col("first_split") != F.col("last_split")) == 0).alias("is_leak_free"),
    )


def leaking_documents(df: DataFrame, group: str = "doc_id", split: str = "split") -> DataFrame:
    """Documents that appear in more than one split, with the splits they appear in."""
    listed = F.array_compact(F.array(*[F.when(F.col(f"in_{s}"), F.lit(s)) for s in SPLITS]))
    return (
        _memberships(df, group, split)
        .filter(F.col("first_split") != F.col("last_split"))
        .select(group, F.array_join(listed, ",").alias("splits"))
    )


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Identifiers present in both data sets."""
    return a.select(key).intersect(b.select(key))
