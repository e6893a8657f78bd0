"""Structured results and human-readable reports, one row per capture."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captura.functions.rounding import round_half_even
from captura.functions.scores import LOW_RISK, MEDIUM_RISK, evidence_status

# --- fixed values ---------------------------------------------------------
ADVICE = {
    "LOW": "PASS (LOW RISK): High multi-modal visual and textual consistency. Verified for low-risk automated flows.",
    "MEDIUM": "REVIEW (MEDIUM RISK): Ambiguities, partial evidence, or minor anomalies detected. Manual review advised.",
    "HIGH": "FLAG (HIGH RISK): Significant visual, temporal, or textual inconsistencies detected. "
    "Escalate for manual fraud investigation.",
}
EVIDENCE_LABELS = [
    ("Visual Document Integrity", "visual_integrity"),
    ("Temporal Consistency", "temporal_consistency"),
    ("Character OCR Confidence", "ocr_confidence"),
    ("Cross-Frame Text Consistency", "text_consistency"),
]
FIELD_LABELS = [
    ("Document Number", "document_number"),
    ("Holder Name", "name"),
    ("Date of Birth", "dob"),
    ("Address", "address"),
]
DISCLAIMER = (
    "This system performs automated document integrity screening and does not provide official government authentication."
)
# --------------------------------------------------------------------------


def percent(score: Column) -> Column:
    # format_string prints a NULL as text, so it must not see one.
    return F.when(score.isNotNull(), F.concat(F.format_string("%.1f", round_half_even(score * 100.0, 1)), F.lit("%")))


def stage_seconds(runs: DataFrame, key: str = "video_id") -> DataFrame:
    """``stage_times`` per capture: stages by name with their seconds over all runs, a few entries each."""
    per_stage = runs.groupBy(key, "stage_name").agg(F.sum("duration_seconds").alias("seconds"))
    entry = F.struct("stage_name", round_half_even(F.col("seconds"), 3).alias("seconds"))
    return per_stage.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("stage_times"))


def _seconds(value: Column) -> Column:
    return F.concat(F.format_string("%.3f", round_half_even(value, 3)), F.lit(" s"))


def _processing_lines(assessed: DataFrame, rule: str) -> list:
    lines = []
    if "frames_read" in assessed.columns:
        lines.append(F.concat(F.lit("  Frames read: "), F.coalesce(F.col("frames_read").cast("string"), F.lit("NOT AVAILABLE"))))
    if "stage_times" in assessed.columns:
        known = F.coalesce("stage_times", F.array().cast("array<struct<stage_name:string,seconds:double>>"))
        total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x["seconds"])
        each = F.transform(known, lambda x: F.concat(F.lit("    "), x["stage_name"], F.lit(": "), _seconds(x["seconds"])))
        lines += [F.concat(F.lit("  Processing time: "), _seconds(total)), F.when(F.size(known) > 0, F.array_join(each, "\n"))]
    return [F.lit(rule), *lines] if lines else []


def report_text(assessed: DataFrame, low: float = LOW_RISK, medium: float = MEDIUM_RISK) -> DataFrame:
    """Add ``report``: outcome, extracted fields, evidence and thresholds as text.

    Needs the four evidence columns, the four fields, ``integrity_score``,
    ``risk_level`` and ``evidence_coverage``. With ``stage_times`` (:func:`stage_seconds`) and ``frames_read`` the
    report also lists processing times and the frames that were read. No time stamp is printed.
    """
    bar, rule = "=" * 70, "-" * 70
    advice = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv]), F.col("risk_level")),
        F.lit(ADVICE["HIGH"]),
    )
    lines = [
        F.lit(bar),
        F.lit("DOCUMENT VERIFICATION REPORT"),
        F.lit(bar),
        F.concat(F.lit("Outcome: "), F.col("risk_level"), F.lit(" RISK (Score: "), percent(F.col("integrity_score")), F.lit(")")),
        F.concat(F.lit("Evidence coverage: "), percent(F.col("evidence_coverage"))),
        F.concat(F.lit("Recommendation: "), advice),
        F.lit(rule),
        *[
            F.concat(F.lit(f"  {label}: "), F.coalesce(F.col(field), F.lit("Not Extracted")))
            for label, field in FIELD_LABELS
        ],
        F.lit(rule),
        *[
            F.concat(
                F.lit(f"  * {label}: "),
                F.coalesce(percent(F.col(source)), F.lit("NOT AVAILABLE")),
                F.lit(" ["),
                evidence_status(F.col(source)),
                F.lit("]"),
            )
            for label, source in EVIDENCE_LABELS
        ],
        *_processing_lines(assessed, rule),
        F.lit(rule),
        F.lit(f"  Low risk: score >= {low * 100:.0f}%"),
        F.lit(f"  Medium risk: {medium * 100:.0f}% <= score < {low * 100:.0f}%"),
        F.lit(f"  High risk: score < {medium * 100:.0f}%"),
        F.lit(rule),
        F.lit(f"  {DISCLAIMER}"),
        F.lit(bar),
    ]
    return assessed.withColumn("report", F.concat_ws("\n", *lines))


def structured_result(assessed: DataFrame, key: str = "video_id") -> DataFrame:
    """Nested result document per capture, ready for a JSON sink."""
    take = lambda names: F.struct(*[F.col(c) for c in names if c in assessed.columns])
    return assessed.select(
        key,
        F.struct(
            take(["integrity_score", "risk_level", "evidence_coverage", "recommendation"]).alias("verification_result"),
            take(["visual_integrity", "temporal_consistency", "ocr_confidence", "text_consistency"]).alias("evidence"),
            take(["name", "dob", "document_number", "address"]).alias("extracted_fields"),
            take(["available_sources", "missing_sources", "evidence_breakdown"]).alias("evidence_fusion"),
            take(["frames_read", "stage_times"]).alias("processing"),
            F.lit(DISCLAIMER).alias("disclaimer"),
        ).alias("result"),
    )
