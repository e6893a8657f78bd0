"""Localization quality against ground truth, and gate scorecards."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captura.functions.geometry import measure_agreement
from captura.functions.rounding import ratio_or_zero, round_half_even
from captura.operators.grouping import null_safe, percentiles
from captura.operators.shared import written

OVERALL = "overall"
GOOD_IOU = 0.85
POOR_IOU = 0.60


def against_truth(detections: DataFrame, truth: DataFrame, keys=("video_id", "frame_id")) -> DataFrame:
    """Add IoU and corner errors; frames without truth or detection get IoU 0.0 and NULL errors."""
    quads = truth.select(*keys, F.col("corners").alias("__truth"))
    joined = detections.join(quads, list(keys), "left")
    usable = F.col("detected") & F.col("corners").isNotNull() & F.col("__truth").isNotNull()
    paired = joined.withColumns(
        {"__pred": F.when(usable, F.col("corners")), "__gt": F.when(usable, F.col("__truth"))}
    )
    measured = measure_agreement(paired, "__pred", "__gt", "__m")
    return measured.select(
        *detections.columns,
        F.col("__truth").isNotNull().alias("has_truth"),
        F.col("__m.iou").alias("iou"),
        F.col("__m.mean").alias("mean_corner_error"),
        F.col("__m.median").alias("median_corner_error"),
        F.col("__m.max").alias("max_corner_error"),
    )


def _with_overall(frames: DataFrame, by: str) -> DataFrame:
    """Count every row for its own group and for the overall group."""
    return frames.withColumn(by, F.explode(F.array(F.col(by), F.lit(OVERALL))))


def counted_iou(undetected: str, detected: Column, iou: Column) -> Column:
    """IoU that enters the averages: ``zero`` counts misses, ``skip`` drops them, ``positive`` drops zeros."""
    if undetected == "zero":
        return F.coalesce(iou, F.lit(0.0))
    if undetected == "skip":
        return F.when(detected, iou)
    if undetected == "positive":
        return F.when(detected & (iou > 0), iou)
    raise ValueError(f"unknown policy {undetected!r}")


def localization_metrics(
    frames: DataFrame, by: str = "mode", undetected: str = "positive", keys=(), error_scale: float = 4096.0
) -> DataFrame:
    """Detection rate, IoU and corner-error statistics per mode and overall. Frames are written once and read from there."""
    groups = [*keys, by]
    kept = written(frames.select(*groups, "detected", "iou", "mean_corner_error", "max_corner_error"), "rated-frames")
    rows = _with_overall(kept, by).withColumn("__iou", counted_iou(undetected, F.col("detected"), F.col("iou")))
    plain = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if("detected").alias("detected"),
        F.avg("__iou").alias("mean_iou"),
        F.min("__iou").alias("min_iou"),
        F.avg("mean_corner_error").alias("mean_error"),
        F.max("max_corner_error").alias("max_error"),
    )
    iou_median = percentiles(rows, groups, "__iou", {"median_iou": 0.5})
    error_median = percentiles(rows, groups, "mean_corner_error", {"median_error": 0.5}, 0.0, error_scale)
    joined = null_safe(null_safe(plain, iou_median, groups), error_median, groups)
    zero = lambda c, d: F.coalesce(round_half_even(F.col(c), d), F.lit(0.0))
    return joined.select(
        *groups,
        "frames",
        "detected",
        round_half_even(ratio_or_zero(F.col("detected"), F.col("frames"))).alias("detection_rate"),
        zero("mean_iou", 4).alias("mean_iou"),
        zero("median_iou", 4).alias("median_iou"),
        zero("min_iou", 4).alias("min_iou"),
        zero("mean_error", 2).alias("mean_corner_error"),
        zero("median_error", 2).alias("median_corner_error"),
        zero("max_error", 2).alias("max_corner_error"),
    )


def compare_methods(frames: DataFrame, baseline: str, enhanced: str, by: str = "mode", undetected: str = "positive") -> DataFrame:
    """Metrics of two methods side by side with their differences; ``method`` labels the rows."""
    kept = frames.filter(F.col("method").isin(baseline, enhanced))
    metrics = localization_metrics(kept, by, undetected, keys=("method",))
    compared = ["detection_rate", "mean_iou", "median_iou", "mean_corner_error"]
    of = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = metrics.groupBy(by).agg(
        *[of(baseline, c).alias(f"baseline_{c}") for c in compared],
        *[of(enhanced, c).alias(f"enhanced_{c}") for c in compared],
    )
    digits = {"mean_corner_error": 2}
    return wide.select(
        "*",
        *[
            round_half_even(F.col(f"enhanced_{c}") - F.col(f"baseline_{c}"), digits.get(c, 4)).alias(f"{c}_delta")
            for c in compared
        ],
    )


def gate_outcomes(decisions: DataFrame, undetected: str = "zero") -> DataFrame:
    """Per frame and gate: which tier is used, its quality and latency, and the error category.

    Rows carry ``gate, invoke_tier2, mode`` and ``t1_*`` / ``t2_*`` columns for
    ``detected, iou, error, ms``.
    """
    use2 = F.col("invoke_tier2")
    pick = lambda c: F.when(use2, F.col(f"t2_{c}")).otherwise(F.col(f"t1_{c}"))
    good = F.col("t1_detected") & (F.col("t1_iou") >= GOOD_IOU)
    poor = ~F.col("t1_detected") | (F.col("t1_iou") < POOR_IOU)
    return decisions.withColumns(
        {
            "detected": pick("detected"),
            "raw_iou": pick("iou"),
            "error": pick("error"),
            "latency_ms": F.col("t1_ms") + F.when(use2, F.col("t2_ms")).otherwise(F.lit(0.0)),
            "outcome": F.when(use2 & good, F.lit("false_trigger"))
            .when(~use2 & poor, F.lit("missed_failure"))
            .when(~use2 & good, F.lit("correct_pass"))
            .when(use2 & poor, F.lit("correct_fallback"))
            .otherwise(F.lit("neutral")),
        }
    ).withColumn("iou", counted_iou(undetected, F.col("detected"), F.col("raw_iou")))


def gate_scorecard(
    decisions: DataFrame, by: str = "mode", undetected: str = "zero", error_scale: float = 4096.0
) -> DataFrame:
    """Invocation, detection, quality, latency and error counts per gate, for each mode and overall.

    Decisions are written once, with the columns that count, and read from there.
    """
    groups = ["gate", by]
    tiers = [f"{t}_{c}" for t in ("t1", "t2") for c in ("detected", "iou", "error", "ms")]
    kept = written(decisions.select(*groups, "invoke_tier2", *tiers), "decisions")
    rows = _with_overall(gate_outcomes(kept, undetected), by)
    plain = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if("invoke_tier2").alias("invocations"),
        F.count_if("detected").alias("detected"),
        F.avg("iou").alias("mean_iou"),
        F.avg("error").alias("mean_error"),
        F.avg("latency_ms").alias("latency"),
        F.avg("t1_ms").alias("t1"),
        F.avg("t2_ms").alias("t2"),
        F.count_if(F.col("outcome") == "false_trigger").alias("false_triggers"),
        F.count_if(F.col("outcome") == "missed_failure").alias("missed_failures"),
    )
    iou_median = percentiles(rows, groups, "iou", {"median_iou": 0.5})
    error_median = percentiles(rows, groups, "error", {"median_error": 0.5}, 0.0, error_scale)
    joined = null_safe(null_safe(plain, iou_median, groups), error_median, groups)
    rate = round_half_even(ratio_or_zero(F.col("invocations"), F.col("frames")))
    zero = lambda c, d: F.coalesce(round_half_even(F.col(c), d), F.lit(0.0))
    return joined.select(
        *groups,
        "frames",
        "invocations",
        rate.alias("invocation_rate"),
        "detected",
        round_half_even(ratio_or_zero(F.col("detected"), F.col("frames"))).alias("detection_rate"),
        zero("mean_iou", 4).alias("mean_iou"),
        zero("median_iou", 4).alias("median_iou"),
        zero("mean_error", 2).alias("mean_corner_error"),
        zero("median_error", 2).alias("median_corner_error"),
        zero("latency", 1).alias("mean_latency_ms"),
        round_half_even(F.col("t1") + rate * F.col("t2"), 1).alias("modeled_latency_ms"),
        "false_triggers",
        "missed_failures",
    )


def gain_over_tiers(scorecard: DataFrame, tier1_iou: Column, tier2_iou: Column, tier2_ms: Column) -> DataFrame:
    """Share of the largest possible IoU gain and latency saved against tier 2 alone."""
    gain = F.when(tier2_iou != tier1_iou, (F.col("mean_iou") - tier1_iou) / (tier2_iou - tier1_iou) * 100.0)
    saved = F.when(tier2_ms > 0, (tier2_ms - F.col("mean_latency_ms")) / tier2_ms * 100.0)
    return scorecard.withColumns(
        {"iou_gain_pct": round_half_even(gain, 1), "latency_saved_pct": round_half_even(saved, 1)}
    )


def representatives(frames: DataFrame, by: str = "mode", worst: bool = False, order: str = "frame_idx") -> DataFrame:
    """Best (or worst) frame of every mode by IoU; the earliest frame wins ties."""
    others = [c for c in frames.columns if c != by]
    first = F.col("iou") if worst else -F.col("iou")
    keyed = frames.filter(F.col("detected") & F.col("has_truth"))
    picked = keyed.groupBy(by).agg(F.min_by(F.struct(*others), F.struct(first, F.col(order), F.col("video_id"))).alias("r"))
    return picked.select(by, "r.*")


def first_examples(outcomes: DataFrame, by=("gate", "outcome"), order=("frame_idx",)) -> DataFrame:
    """First frame of every category in frame order."""
    others = [c for c in outcomes.columns if c not in by]
    picked = outcomes.groupBy(*by).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r"))
    return picked.select(*by, "r.*")


def detection_summary(frames: DataFrame, digits: int = 3) -> DataFrame:
    """Detected and undetected frames, rate and mean confidence of the detected ones."""
    rate = ratio_or_zero(F.count_if("detected"), F.count(F.lit(1)))
    return frames.agg(
        F.count(F.lit(1)).alias("total_frames"),
        F.count_if("detected").alias("frames_detected"),
        F.count_if(~F.col("detected")).alias("frames_undetected"),
        round_half_even(rate, digits).alias("detection_rate"),
        F.coalesce(round_half_even(F.avg(F.when(F.col("detected"), F.col("confidence")))), F.lit(0.0)).alias(
            "mean_confidence"
        ),
    )


def rectification_summary(crops: DataFrame) -> DataFrame:
    """Share of crops rectified by homography, with fallback and failed counts."""
    total = F.count(F.lit(1))
    homography = F.count_if(F.col("method") == "homography")
    return crops.agg(
        total.alias("total_crops"),
        homography.alias("homography_success_count"),
        round_half_even(ratio_or_zero(homography, total), 3).alias("homography_success_rate"),
        F.count_if(F.col("method") == "fallback_resize").alias("fallback_resize_count"),
        F.count_if(F.col("method").isNull()).alias("failed_count"),
    )
