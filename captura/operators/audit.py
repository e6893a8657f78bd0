"""Inventories, distribution summaries and validation reports of sample sets."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captura.functions.rounding import ratio_or_zero, round_half_even

# --- fixed values ---------------------------------------------------------
TOO_FEW = ("Insufficient {} samples: found ", ", minimum required is {}.")
EMPTY_SPLIT = "Partitioned dataset has 0 {} samples."
ONE_GROUP = (
    "Only ",
    " unique document group detected. Multiple document/video groups are required to prevent train/test leakage.",
)
# --------------------------------------------------------------------------


def split_summary(samples: DataFrame, group: str = "doc_id") -> DataFrame:
    """Rows, class counts, documents and share of the total per split."""
    per_split = samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("class_name") == "REAL").alias("real"),
        F.count_if(F.col("class_name") == "ATTACKED").alias("attacked"),
        F.countDistinct(group).alias("documents"),
    )
    # The frame below holds one row per split, not the samples.
    everything = F.sum("total").over(Window.partitionBy())
    return per_split.withColumn("percentage", round_half_even(F.col("total") / everything * 100.0, 1))


def split_breakdown(samples: DataFrame, split: str = "split", dimensions=("label", "doc_id", "document_type", "attack_type")) -> DataFrame:
    """Counts per split and, separately, per value of every dimension, from one pass."""
    exploded = samples.select(
        split,
        F.explode(
            F.array(
                F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")),
                *[
                    F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value"))
                    for d in dimensions
                ],
            )
        ).alias("e"),
    )
    return exploded.groupBy(split, "e.dimension", "e.value").agg(F.count(F.lit(1)).alias("n"))


def inventory(files: DataFrame, annotations: DataFrame, keys=("clip_id",), carried=("document_id", "attack_type", "label", "split")) -> DataFrame:
    """Frames, bytes, first path and annotation status of every clip.

    ``files`` is one row per frame with ``path, length``; ``annotations`` lists
    the clips that have an annotation file.
    """
    per_clip = files.groupBy(*keys, *carried).agg(
        F.count(F.lit(1)).alias("frame_count"), F.sum("length").alias("disk_bytes"), F.min("path").alias("sample_frame_path")
    )
    known = annotations.select(*keys).distinct().withColumn("__known", F.lit(True))
    joined = per_clip.join(known, list(keys), "left")
    return joined.withColumn(
        "annotation_status", F.when(F.col("__known"), F.lit("available")).otherwise(F.lit("missing"))
    ).drop("__known")


def ingestion_report(clips: DataFrame) -> DataFrame:
    """Totals over an inventory with clips by attack type and split."""
    is_attack = lambda m: F.count_if(F.col("attack_type") == m)
    is_split = lambda s: F.count_if(F.col("split") == s)
    return clips.agg(
        F.countDistinct("document_id").alias("total_documents"),
        F.count(F.lit(1)).alias("total_clips"),
        F.sum("frame_count").alias("total_frames"),
        round_half_even(F.sum("disk_bytes") / (1024.0 * 1024.0), 2).alias("total_disk_mb"),
        *[is_attack(m).alias(f"clips_{m}") for m in ("or", "cc", "cg", "re")],
        *[is_split(s).alias(f"clips_{s}") for s in ("train", "validation", "test")],
    )


def normalization_summary(manifest: DataFrame, failures: DataFrame) -> DataFrame:
    """Processed, succeeded and failed frames with rates, by split, label, mode, method and overall.

    Failed frames never reached a method, so they count under method ``none``.
    """
    columns = ["split", "label", "attack_type"]
    rows = manifest.select(*columns, F.col("localization_method").alias("method"), F.lit(1).alias("ok")).unionByName(
        failures.select(*columns, F.lit("none").alias("method"), F.lit(0).alias("ok"))
    )
    dims = {"split": "split", "label": "label", "mode": "attack_type", "method": "method"}
    exploded = rows.select(
        "ok",
        "method",
        F.explode(
            F.array(
                F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")),
                *[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in dims.items()],
            )
        ).alias("e"),
    )
    n = F.count(F.lit(1))
    return exploded.groupBy("e.dimension", "e.value").agg(
        n.alias("processed"),
        F.sum("ok").alias("succeeded"),
        F.sum(1 - F.col("ok")).alias("failed"),
        round_half_even(F.sum("ok") / n * 100.0, 2).alias("success_pct"),
        round_half_even(F.count_if(F.col("method") == "tier2") / n * 100.0, 2).alias("tier2_pct"),
    )


def _issue(test: Column, message: Column) -> Column:
    return F.when(test, message)


def validate_dataset(samples: DataFrame, by=(), min_per_class: int = 5, partitioned: bool = False) -> DataFrame:
    """Class and group counts with the list of issues; valid when the list is empty.

    ``samples`` is ``label, doc_id`` and, for a partitioned set, ``split``.
    """
    real, attacked = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    split_counts = (
        [F.count_if(F.col("split") == s).alias(f"{s}_count") for s in ("train", "val", "test")] if partitioned else []
    )
    counts = samples.groupBy(*by).agg(
        real.alias("real_count"),
        attacked.alias("attacked_count"),
        F.count(F.lit(1)).alias("total_count"),
        F.countDistinct("doc_id").alias("unique_groups"),
        *split_counts,
    )

    def too_few(name, column):
        return _issue(
            F.col(column) < min_per_class,
            F.concat(
                F.lit(TOO_FEW[0].format(name)), F.col(column), F.lit(TOO_FEW[1].format(min_per_class))
            ),
        )

    issues = []
    if partitioned:
        named = {"train": "training", "val": "validation", "test": "test"}
        issues += [
            _issue(F.col(f"{s}_count") == 0, F.lit(EMPTY_SPLIT.format(n))) for s, n in named.items()
        ]
    issues += [too_few("REAL", "real_count"), too_few("ATTACKED", "attacked_count")]
    if not partitioned:
        issues.append(
            _issue(
                (F.col("total_count") > 0) & (F.col("unique_groups") < 2),
                F.concat(
                    F.lit(ONE_GROUP[0]),
                    F.col("unique_groups"),
                    F.lit(ONE_GROUP[1]),
                ),
            )
        )
    listed = counts.withColumn("issues", F.array_compact(F.array(*issues)))
    return listed.withColumn("is_valid", F.size("issues") == 0)


def audit(samples: DataFrame, source: str = "source", min_per_class: int = 5) -> DataFrame:
    """Per source: counts, documents per class, attack mix and suitability for training.

    ``samples`` is ``label, doc_id, attack_type`` plus the source column.
    """
    report = validate_dataset(samples, [source], min_per_class)
    docs = lambda lab: F.countDistinct(F.when(F.col("label") == lab, F.col("doc_id")))
    kinds = ("photo_tamper", "text_alteration", "screen_replay", "print_scan")
    per_kind = lambda k: F.countDistinct(
        F.when((F.col("label") == 1) & (F.col("attack_type") == k), F.col("doc_id"))
    )
    mix = samples.groupBy(source).agg(
        docs(0).alias("real_documents"), docs(1).alias("attacked_documents"), *[per_kind(k).alias(k) for k in kinds]
    )
    joined = report.join(mix, source)
    return joined.select(
        source,
        "total_count",
        "real_count",
        "attacked_count",
        "unique_groups",
        "real_documents",
        "attacked_documents",
        *kinds,
        F.when(F.col("is_valid"), F.lit("YES")).otherwise(F.lit("NO")).alias("suitable_for_training"),
        F.array_join("issues", " ").alias("reason"),
    )


def crop_violations(crops: DataFrame, width: int = 600, height: int = 400, mode: str = "RGB", fmt: str = "PNG") -> DataFrame:
    """Crops that miss the required size, colour mode or format; must be empty."""
    fits = (
        (F.col("width") == width) & (F.col("height") == height) & (F.col("color_mode") == mode) & (F.col("format") == fmt)
    )
    return crops.filter(~F.coalesce(fits, F.lit(False)))


def stage_status(items: Column, failed: Column) -> Column:
    return F.when(failed, F.lit("FAILED")).when(items > 0, F.lit("SUCCESS")).otherwise(F.lit("WARNING"))


def stage_times(stage_runs: DataFrame, key: str = "video_id") -> DataFrame:
    """Total processing time of a capture."""
    return stage_runs.groupBy(key).agg(
        round_half_even(F.sum("duration_seconds"), 3).alias("total_processing_time_seconds"),
        F.count(F.lit(1)).alias("stages"),
        F.count_if(F.col("status") == "FAILED").alias("failed_stages"),
    )


def coverage_rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return round_half_even(ratio_or_zero(part, whole), digits)
