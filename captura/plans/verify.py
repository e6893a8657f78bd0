"""Composite plans: from tables of captures to consensus, evidence, risk and experiments."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.functions.rounding import mean_fixed, to_fixed
from captura.functions.scores import attack_decision, combine_visual_temporal
from captura.functions.text import KEY_FIELDS
from captura.operators.consensus import text_consistency
from captura.operators.evaluation import binary_metrics
from captura.operators.fusion import assess, fuse
from captura.operators.grouping import null_safe
from captura.operators.ocr import MIN_CONFIDENCE, frame_text, parse_fields, video_confidence
from captura.operators.shared import written
from captura.operators.temporal import CONSISTENCY_THRESHOLD, temporal_consistency


def verify_text(
    ocr_lines: DataFrame,
    frames: DataFrame,
    min_conf: float = MIN_CONFIDENCE,
    fields=KEY_FIELDS,
    patterns: dict | None = None,
    **consensus,
) -> DataFrame:
    """Text summary per capture: consensus fields, consistency and OCR confidence.

    ``frames`` lists every readable frame as ``video_id, frame_idx``; a frame
    without confident lines counts with confidence 0.0. The parsed frames are written once: consensus, similarity and
    confidence all read them, and matching the patterns is the dearest step.
    """
    texts = frame_text(ocr_lines, frames, min_conf, keys=("video_id", "frame_idx"))
    parsed = written(parse_fields(texts, "full_text", "full_text", patterns).drop("full_text", "line_count"), "parsed")
    summary = text_consistency(parsed, fields, **consensus)
    return null_safe(summary, video_confidence(parsed), ["video_id"], "inner")


def visual_scores(frame_scores: DataFrame) -> DataFrame:
    """Mean integrity score per capture, rounded; captures without scored frames have no row."""
    return frame_scores.groupBy("video_id").agg(mean_fixed(to_fixed(F.col("integrity_score"))).alias("visual_integrity"))


def capture_evidence(
    visual: DataFrame, temporal: DataFrame, text: DataFrame, missing_temporal: str = "null"
) -> DataFrame:
    """Four evidence scores per capture from the per-branch results.

    A capture with fewer than two frames has no temporal score. Live verification
    leaves it out of the weights (``null``); the experiments count it as 0.0 (``zero``).
    """
    if missing_temporal not in ("null", "zero"):
        raise ValueError(f"missing_temporal must be 'null' or 'zero', got {missing_temporal!r}")
    score = F.col("temporal_consistency_score")
    scored = F.when(F.col("status") != "insufficient_frames", score)
    if missing_temporal == "zero":
        scored = F.coalesce(scored, F.lit(0.0))
    t = temporal.select("video_id", scored.alias("temporal_consistency"))
    # A struct key also matches the capture without a name.
    keyed = [df.select(F.struct("video_id").alias("__k"), *[c for c in df.columns if c != "video_id"]) for df in (visual, t, text)]
    joined = keyed[0].join(keyed[1], "__k", "full_outer").join(keyed[2], "__k", "full_outer")
    return joined.select("__k.video_id", *[c for c in joined.columns if c != "__k"])


def verify(
    frame_scores: DataFrame,
    emb: DataFrame,
    ocr_lines: DataFrame,
    frames: DataFrame,
    threshold: float = CONSISTENCY_THRESHOLD,
    weights: dict | None = None,
    **consensus,
) -> DataFrame:
    """Risk assessment of every capture from frame scores, embeddings and recognized lines."""
    text = verify_text(ocr_lines, frames, **consensus)
    temporal = temporal_consistency(emb, threshold)
    evidence = capture_evidence(visual_scores(frame_scores), temporal, text)
    return assess(fuse(evidence, weights))


def experiment_a(frame_predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Predictions from single frames: ``doc_id, label, integrity_score``."""
    score = F.col("integrity_score")
    return frame_predictions.select(
        F.lit("experiment_a").alias("experiment_id"),
        "doc_id",
        F.col("label").alias("y_true"),
        attack_decision(score, threshold).alias("y_pred"),
        (1.0 - score).alias("y_score"),
    )


def experiment_b(sequences: DataFrame, threshold: float = 0.5, wv: float = 0.40, wt: float = 0.30) -> DataFrame:
    """Predictions from visual and temporal scores of whole sequences; a missing score counts as 0.0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    combined = combine_visual_temporal(zero("visual_integrity"), zero("temporal_consistency"), wv, wt)
    return sequences.select(
        F.lit("experiment_b").alias("experiment_id"),
        "doc_id",
        F.col("label").alias("y_true"),
        attack_decision(combined, threshold).alias("y_pred"),
        (1.0 - combined).alias("y_score"),
    )


def experiment_c(sequences: DataFrame, threshold: float = 0.5, weights: dict | None = None) -> DataFrame:
    """Predictions from all four fused sources; visual and temporal scores count as 0.0 when missing."""
    filled = sequences.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("visual_integrity", "temporal_consistency")}
    )
    fused = F.col("fused_integrity_score")
    return fuse(filled, weights).select(
        F.lit("experiment_c").alias("experiment_id"),
        "doc_id",
        F.col("label").alias("y_true"),
        attack_decision(fused, threshold).alias("y_pred"),
        (1.0 - fused).alias("y_score"),
    )


def run_experiments(frame_predictions: DataFrame, sequences: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics of experiments A, B and C, one row each, from one prediction table."""
    predictions = (
        experiment_a(frame_predictions, threshold)
        .unionByName(experiment_b(sequences, threshold))
        .unionByName(experiment_c(sequences, threshold))
    )
    return binary_metrics(predictions, ["experiment_id"])
